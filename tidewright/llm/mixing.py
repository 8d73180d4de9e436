"""Mixing sources to target weights with a low-discrepancy source schedule.

The words of each source, its documents in a hashed order, form one stream that is cut
into blocks of equal word counts. Slot ``i`` of the schedule owns the ``i``-th golden-ratio
point; mapped through the cumulative block targets it names a source, and its rank among
that source's slots names the block it takes (a second pass over the stream begins where
the first ends). Any stretch of the schedule therefore holds the sources in their target
shares. Everything is made of DataFrame functions.

Ranks and stream positions are prefix sums in two levels (totals of bounded chunks first,
then inside each chunk), so that a source with a third of all rows never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, staged, word_count

#: 2**31 / golden ratio, odd: its multiples modulo 2**31 visit every point once.
GOLDEN = 1327217885
POINTS = 2**31
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block. Rows in a chunk of the two-level prefix sums.
BLOCK_WORDS = 256
CHUNK_ROWS = 1 << 13


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Words to take from each source: ``source, src, weight, source_size, target, need``.

    ``sized`` has ``source`` and ``size``. Sources by code point, null last, get the weights
    in turn. ``share`` times all words are dealt by weight; a source stops at ``most`` times
    its own words and what is over is dealt again among the others by weight. With sources
    ordered by limit/weight the stopped ones are a prefix, which gives the fixed point in
    closed form. Sources without words have target 0. ``need`` is the target as whole words.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    per = per.withColumn("_limit", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_limit") / F.col("weight"), "src")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    hundredths = round(share * 100)
    per = (
        per.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_after", F.sum("weight").over(after))
        .withColumn("_level", (F.col("_total") * hundredths - F.col("_before") * 100).cast("double") / (F.col("_after") * 100))
        .withColumn("_level", F.when(F.col("_limit") > F.col("_level") * F.col("weight"), F.col("_level")))
        .withColumn("_level", F.first("_level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    per = per.withColumn("target", F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_limit").cast("double"))))
    per = per.withColumn("need", F.least(F.col("_limit"), F.floor(F.col("target") + 0.5)))
    return per.select("source", "src", "weight", "source_size", "target", "need")


def _stream(sized: DataFrame, targets: DataFrame, chunks: int) -> DataFrame:
    """Adds ``src`` and ``_off``, the document's place in its source's shuffled stream."""
    keyed = sized.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("_chunk", F.conv(F.substring("_order", 1, 6), 16, 10).cast("long") % F.lit(1 << 24) * chunks / F.lit(1 << 24))
    keyed = keyed.withColumn("_chunk", F.floor("_chunk"))
    keyed = keyed.join(targets.select(F.col("source").alias("_source"), "src", "source_size", "target"), keyed.source.eqNullSafe(F.col("_source"))).drop("_source")
    sums = keyed.groupBy("src", "_chunk").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "_chunk", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("src", "_chunk").orderBy("_order", "doc_id", "size")
    keyed = keyed.join(starts, ["src", "_chunk"])
    return keyed.withColumn("_row", F.row_number().over(inside)).withColumn(
        "_off", F.col("_start") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )


def mix_schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: ``slot, src, rank, block, epoch, lo, hi``; ``[lo, hi)`` are words of the source's stream.

    ``targets`` comes from :func:`source_targets`. Each source gets exactly the slots that its
    ``need`` asks for, the last one cut to length: golden-ratio ranks beyond that are left out,
    and the few that the points fall short of (their discrepancy, logarithmic in the number of
    slots) follow at the end. Empty when nothing is needed.
    """
    spark, size = targets.sparkSession, F.col("source_size")
    plan = (
        targets.filter("need > 0")
        .withColumn("blocks", F.ceil(size / block_words))
        .withColumn("_left", F.col("need") % size)
        .withColumn("slots", F.floor(F.col("need") / size) * F.col("blocks") + F.ceil(F.col("_left") / block_words))
    )
    head = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    total, cells = int(head["slots"]), 1 << max(0, 4 * head["n"] - 1).bit_length()
    ahead = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("_lo", F.coalesce(F.sum("slots").over(ahead), F.lit(0))).withColumn("_hi", F.col("_lo") + F.col("slots"))
    cell = lambda c: F.least(F.floor(c * cells / max(total, 1)), F.lit(cells - 1))
    spread = plan.select("src", "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    parts = max(1, min(spark.sparkContext.defaultParallelism * 4, math.ceil(total / CHUNK_ROWS)))
    points = spark.range(0, total, 1, parts).withColumnRenamed("id", "slot")
    points = points.withColumn("_at", (F.col("slot") % POINTS * GOLDEN % POINTS).cast("double") / POINTS * total).withColumn("_cell", F.least(F.floor(F.col("_at") * cells / max(total, 1)), F.lit(cells - 1)))
    drawn = points.join(spread, "_cell").filter((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).select("slot", "src", F.floor(F.col("slot") / CHUNK_ROWS).alias("_chunk"))
    counts = drawn.groupBy("src", "_chunk").agg(F.count("*").alias("_n"))
    starts = counts.select("src", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("src", "_chunk").orderBy("slot")
    ranked = drawn.join(starts, ["src", "_chunk"]).select("slot", "src", (F.col("_start") + F.row_number().over(inside)).alias("rank"))
    short = (
        plan.select("src", "slots", "_lo")
        .join(counts.groupBy("src").agg(F.sum("_n").alias("_have")), "src", "left")
        .withColumn("_have", F.coalesce("_have", F.lit(0)))
        .filter("_have < slots")
        .select((F.lit(total) + F.col("_lo")).alias("_base"), "src", F.explode(F.sequence(F.col("_have") + 1, F.col("slots"))).alias("rank"))
        .select((F.col("_base") + F.col("rank")).alias("slot"), "src", "rank")
    )
    dealt = ranked.unionByName(short).join(plan.select("src", "slots", "blocks", "source_size", "_left"), "src").filter("rank <= slots")
    dealt = dealt.withColumn("block", (F.col("rank") - 1) % F.col("blocks")).withColumn("epoch", F.floor((F.col("rank") - 1) / F.col("blocks")))
    lo = F.col("block") * block_words
    hi = F.least(lo + block_words, F.col("source_size"), F.when((F.col("rank") == F.col("slots")) & (F.col("_left") > 0), F.col("_left")).otherwise(F.col("source_size")))
    return dealt.select("slot", "src", "rank", "block", "epoch", lo.alias("lo"), hi.alias("hi"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, carry: tuple = ()) -> DataFrame:
    """Words that the mix takes of each document: ``doc_id, size, source_size, target, taken, first_slot`` and ``carry``.

    ``first_slot`` is the schedule's first slot that takes words of the document, null if none does: reading documents in its order
    is reading the mix.

    ``docs`` has ``doc_id, text, source``. A document's size is its number of words; null and
    empty texts have size 0 and are never taken. Null sources are a source of their own, the
    last. Repeated rows are kept as rows of their own; equal ids are ordered by size. An empty
    table gives an empty result. ``taken`` never exceeds ``most`` times the size, and a source's
    ``taken`` add up to its target, rounded to a whole word. Reruns agree: the shuffle is a hash
    of the id, the schedule has no random part.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry), "mix-sizes")
    targets = staged(source_targets(sized, weights, share, most), "mix-targets")
    chunks = max(1, math.ceil(sized.count() / CHUNK_ROWS)) * 4
    placed = _stream(sized, targets, chunks)
    last = F.greatest(F.col("_off"), F.col("_off") + F.col("size") - 1)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("_off") / block_words), F.floor(last / block_words))))
    slots = mix_schedule(targets, block_words).select("src", "block", "slot", "lo", "hi")
    taken = F.when(F.col("hi").isNotNull(), F.least(F.col("hi"), F.col("_off") + F.col("size")) - F.greatest(F.col("lo"), F.col("_off")))
    key = ["doc_id", "size", "source_size", "target", *carry, "src", "_chunk", "_row"]
    out = pieces.join(slots, ["src", "block"], "left").groupBy(*key).agg(F.coalesce(F.sum(F.greatest(taken, F.lit(0))), F.lit(0)).alias("taken"), F.min(F.when(taken > 0, F.col("slot"))).alias("first_slot"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", *carry)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as ``taken`` is of its size, rounded half up.

    Whole documents stay whole. Columns are those of ``docs``; rows with a taken share under
    one half (texts without words among them) go. Ids should be unique, null ids are one id; rows that share an id
    are told apart by their size only, and those of equal size are taken alike.
    """
    size, copies, key = fresh_name(docs, "mix_size"), fresh_name(docs, "mix_copies"), fresh_name(docs, "mix_id")
    took = mix_sources(docs, **how).filter("size > 0")
    took = took.groupBy(F.col("doc_id").alias(key), F.col("size").alias(size)).agg(F.min(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.greatest("size", F.lit(1))))).alias(copies))
    took = took.filter(F.col(copies) > 0)
    rows = docs.join(took, docs["doc_id"].eqNullSafe(took[key]) & (word_count(docs["text"]) == took[size]))
    return rows.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)
