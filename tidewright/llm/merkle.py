"""Merkle manifest of a corpus: a tree per source, a tree over the sources, a proof for every document.

Built bottom-up, a persisted table a level: a level's runs of ``fan`` consecutive nodes become their parents. Proofs are
pushed top-down: each run takes the path of its own node and hands it, with the siblings put before it, to its children. Nothing
but the number of levels and the root passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .ordering import numbered, only

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value, so that no two rows run together alike."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a document, with some fields replaced."""
    return digest(*(encoded(changed.get(f, F.col(f))) for f in FIELDS))


def tampered_leaf() -> Column:
    """The leaf that a document with lower-cased A-Z has, where 5 divides the CRC-32 of its id in decimal; null elsewhere."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_of(text=lower))


@dataclass
class Tree:
    """Levels of runs (tree, p, kids) from the leaves up, and the top node of each tree (tree, n, top)."""

    levels: list[DataFrame]
    tops: DataFrame


def _hashes(kids: str = "kids") -> Column:
    return F.transform(F.col(kids), lambda k: k["hash"])


def grow(nodes: DataFrame, carried: tuple[str, ...] = (), fan: int = FAN) -> Tree:
    """Trees over ``tree, n, idx, hash``: ``idx`` counts the ``n`` nodes of a tree from 0. ``carried`` columns stay beside the leaves.

    While a tree has several nodes at a level, each run of ``fan`` of them becomes the digest of their digests. A run is all that one
    group holds, so a tree of any size is dealt evenly.
    """
    levels, tops = [], [nodes.filter("n = 1").select("tree", "n", F.col("hash").alias("top"))]
    most = nodes.agg(F.max("n")).first()[0] or 0
    width, level, extra = 1, nodes, carried
    while width < most:
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash", *extra)))
        runs = level.filter(F.col("n") > width).groupBy("tree", "n", F.floor(F.col("idx") / fan).alias("p")).agg(kids.alias("kids"))
        runs = staged(runs.withColumn("hash", digest(F.array_join(_hashes(), ""))), "merkle-level")
        levels.append(runs)
        width, extra = width * fan, ()
        level = runs.select("tree", "n", F.col("p").alias("idx"), "hash")
        tops.append(level.filter(F.col("n") <= width).select("tree", "n", F.col("hash").alias("top")))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(levels, out)


def push(tree: Tree, starts: DataFrame, lone: DataFrame, carried: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """``idx, hash``, ``carried``, the columns of ``starts`` and the ``path`` of every leaf, siblings from its own run up to the path of its tree's top.

    ``starts`` has ``tree, n, path`` of the tops (and columns that all leaves of a tree get), ``lone`` the leaves that are trees by
    themselves. Paths below the top are staged for all but the leaves, whose runs unfold them on the spot.
    """
    given = [c for c in starts.columns if c not in ("tree", "n", "path")]
    names = ["tree", "n", "idx", "hash", *carried, *given, "path"]
    own = F.transform("kids", lambda k, i: F.struct(k.alias("kid"), F.array_join(F.slice(_hashes(), 1, i), "").alias("left"), F.array_join(F.slice(_hashes(), i + 2, fan), "").alias("right")))
    above, waiting = None, []
    for k in reversed(range(len(tree.levels))):
        width = fan**k
        here = starts.filter((F.col("n") > width) & (F.col("n") <= width * fan)).withColumn("idx", F.lit(0).cast("long")).drop("n")
        here = here if above is None else here.unionByName(above.drop("n", "hash"))
        runs = tree.levels[k].select("tree", "n", F.col("p").alias("idx"), "kids").join(here, ["tree", "idx"])
        runs = runs.select("tree", "n", *given, "path", F.explode(own).alias("one"))
        kid = [F.col(f"one.kid.{c}").alias(c) for c in ("idx", "hash", *(carried if k == 0 else ()))]
        path = F.concat(F.array(F.struct("one.left", "one.right")), F.col("path")).alias("path")
        above = runs.select("tree", "n", *kid, *given, path)
        if k:
            above = staged(above, "merkle-paths")
            waiting.append(above)
    single = lone.select("tree", "idx", "hash", *carried).join(starts.filter("n = 1"), "tree").select(*names)
    out = single if above is None else above.select(*names).unionByName(single)
    if len(waiting) > 1:
        discard(*waiting[:-1])
    return out


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest of ``docs``: a row per document with its leaf, its proof, and what the proof says of the (tampered) document.

    A leaf is the digest of the fields (null: ``-``); leaves of a source ascend by doc_id (null first; rows of one doc_id by leaf,
    rows alike in everything in any order, which changes no digest but which of them has which proof), sources by their UTF-8 bytes,
    null first. ``tampered`` is the leaf that a document is presented with (null: its own); ``folded_root`` is made from that leaf and
    the original siblings, ``verified`` is whether it is the root. Empty texts count as empty, texts of any length are digested whole;
    no documents give no rows. Other columns of ``docs``, whatever their names, are not read.

    Returns ``doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified``; ``path`` lists (left, right) siblings
    from the leaf to the root.
    """
    spark = docs.sparkSession
    rows = only(docs, *FIELDS).select("source", "doc_id", leaf_of().alias("hash"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    leaves = staged(rows, "merkle-leaves")
    placed = numbered(leaves, ["source"], ["doc_id", "hash"]).withColumnRenamed("group_idx", "tree")
    discard(leaves)
    carried = ("doc_id", "tampered")
    under = grow(placed, carried)
    tops = staged(under.tops, "merkle-subroots")
    n_sources = tops.count()
    over = grow(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("top").alias("hash")))
    root = over.tops.first()
    root = root["top"] if root else None
    apex = spark.range(1).select(F.col("id").alias("tree"), F.lit(n_sources).cast("long").alias("n"), F.from_json(F.lit("[]"), _PATH).alias("path"))
    lone = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("top").alias("hash"))
    proofs = push(over, apex, lone).select(F.col("idx").alias("tree"), "path")
    named = placed.filter("idx = 0").select("tree", "source")
    starts = staged(tops.join(proofs, "tree").join(named, "tree").select("tree", "n", "source", F.col("top").alias("subroot"), "path"), "merkle-proofs")
    discard(*over.levels)
    found = push(under, starts, placed.filter("n = 1"), carried)
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "hash"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))
    return found.select(
        "doc_id", "source", F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

