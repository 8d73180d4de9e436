"""Tables between the steps of an iterative job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: what follows neither repeats its work nor needs the executors that did it.

    Goes to ``spark.checkpoint.dir`` or the folder set by ``setCheckpointDir``. Only in local mode, where all are one machine, a missing setting
    is made up for by a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="tidewright-"))
    return df.checkpoint(eager=True)
