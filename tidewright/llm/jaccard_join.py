"""Jaccard join of documents on word shingles by T-occurrence search.

Documents with equal sets are one class and need no search. A document can only be linked if
enough of its shingles stand in another one too; how many do is counted by one shuffle of all
shingles, in which nothing is paired, and the documents with too many shingles of their own are
out. The rest are brought into blocks such that linked documents share one: of two sets that share enough, some shingle is among
the first few of both in any one order of all shingles (prefix filter). The order is by frequency,
rarest first, as counted over all documents in a table of hash buckets of fixed size, so a passage
that many documents share stands last and ties nothing together. Documents of one task with a key
in common are tied there, and only one of them sends the key on, so a key that a third of all
documents have arrives once per slice of a task.

Within a block, documents whose sizes allow a link are joined by DivideSkip: of a document's
inverted lists the longest are set aside, the short ones are merged with the lowered threshold,
survivors are probed in the long ones by binary search, and those that reach the overlap are
linked. Only links between different components are looked for and only a spanning forest leaves
a task. Blocks beyond a tile are dealt by size class into tiles and joined in two rounds. In the
first each tile meets itself and a few pivots of its own and the next class, which is linear and
leaves a cluster of near copies as one component. In the second, what is not in its block's
largest component meets everything that it may still be linked to, tile by tile.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh_name, lean, picked, staged, staged_selective
from .components import connected_components
from .shingles import mixed, shingle_sets

#: Documents, and shingles, in a tile of a block (twice that at most, as they are dealt by hash). Pivots of a size class of a block.
TILE_DOCS, TILE_SHINGLES, PIVOTS = 2000, 1_000_000, 16
#: Keys of a task that are compared with each other before they are sent on.
SLICE_KEYS = 1 << 19
#: Hash buckets in which the documents of shingles are counted, whatever their number.
BUCKETS = 1 << 16
_LOW, _MASK = np.uint64(48), np.uint64((1 << 48) - 1)
#: Up to so many list entries are merged with a heap, more with a sort.
HEAP = 2048


def least_overlap(a, b, percent: int):
    """Smallest intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many of a set's first shingles: two linked sets share one of them, whatever the order."""
    return n - -(-n * percent // 100) + 1 if n else 0


class Order:
    """An order of all shingles by the number of documents in their hash bucket, rarest first, then by hash."""

    def __init__(self, counts: np.ndarray) -> None:
        rank = np.empty(BUCKETS, np.uint64)
        rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
        self.rank = rank << _LOW

    def first(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The first shingles of a set: hashes whose leading bits, the bucket, give way to the bucket's rank."""
        k = prefix_length(len(shingles), percent)
        if not k:
            return shingles
        h = mixed(shingles)
        placed = self.rank[(h >> _LOW).astype(np.int64)] | (h & _MASK)
        return np.partition(placed, k - 1)[:k]


# ---- search within a tile --------------------------------------------------------------------------------------------------


def merge_short(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that occur in at least ``least`` of the sorted lists, and in how many."""
    if sum(map(len, lists)) > HEAP:
        ids, counts = np.unique(np.concatenate(lists), return_counts=True)
        keep = counts >= least
        return ids[keep], counts[keep]
    ids, counts = [], []
    last, n = -1, 0
    for x in heapq.merge(*(x.tolist() for x in lists)):
        if x == last:
            n += 1
            continue
        if n >= least:
            ids.append(last)
            counts.append(n)
        last, n = x, 1
    if n >= least:
        ids.append(last)
        counts.append(n)
    return np.array(ids, np.int64), np.array(counts, np.int64)


def probe_long(ids: np.ndarray, counts: np.ndarray, lists: list[np.ndarray], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add each document's occurrences in the long lists; give up those that can't reach ``need`` any more."""
    for k, long in enumerate(lists):
        at = np.searchsorted(long, ids)
        counts = counts + (long[np.minimum(at, len(long) - 1)] == ids)
        if k % 16 == 15:
            alive = counts + (len(lists) - k - 1) >= need
            ids, counts, need = ids[alive], counts[alive], need[alive]
            if not len(ids):
                break
    return ids, counts


class _Forest:
    def __init__(self, n: int) -> None:
        self.label, self.edges = np.arange(n), []

    def link(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            if self.label[a] != self.label[b]:
                self.edges.append((a, b))
                low, high = sorted((self.label[a], self.label[b]))
                self.label[self.label == high] = low


def divide_skip(sets: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links between documents (of the two sides, if ``side`` has two values; else among all).

    Documents of one ``label`` are connected already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.arange(n), size))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    both = len(set(side.tolist())) > 1
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), size[order])
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    vocabulary, begin, end = tokens[first], first, np.append(first[1:], len(tokens))
    size, side = size[order], side[order]
    forest = _Forest(n)
    if label is not None:
        forest.label = np.unique(label[order], return_inverse=True)[1]
    for q in range(n - 1):
        mine = int(size[q])
        top = int(np.searchsorted(size, mine * 100 // percent, "right"))  # documents q+1 .. top-1 are small enough
        if top <= q + 1:
            continue
        rest = np.arange(q + 1, top)
        open_ = forest.label[rest] != forest.label[q]
        if both:
            open_ &= side[rest] != side[q]
        if not open_.any():
            continue
        at = np.searchsorted(vocabulary, sets[order[q]])
        lists = [x[(x > q) & (x < top)] for x in (owner[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist(), strict=True) if e - b > 1)]
        least = least_overlap(mine, mine, percent)
        lists = sorted((x for x in lists if len(x)), key=len)
        if len(lists) < least:
            continue
        # Long lists: as many as the threshold allows, but none that is short itself.
        aside = min(least - 1, sum(len(x) > 2 for x in lists))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        ids, counts = merge_short(short, least - aside) if short else (rest, np.zeros(len(rest), np.int64))
        new = forest.label[ids] != forest.label[q]
        if both:
            new &= side[ids] != side[q]
        ids, counts = ids[new], counts[new]
        if len(ids):
            ids, counts = probe_long(ids, counts, long, least_overlap(mine, size[ids], percent))
            forest.link(q, ids[counts >= least_overlap(mine, size[ids], percent)])
    return [(int(order[a]), int(order[b])) for a, b in forest.edges]


# ---- the join --------------------------------------------------------------------------------------------------------------


def _digests(docs: DataFrame, width: int) -> DataFrame:
    """Per document its set's size and digest; per task one more row (size -1) with the documents counted in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(BUCKETS, np.int64), ["doc_id", "n", "digest"]
        for batch in batches:
            sizes, digests = [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    np.add.at(counts, (mixed(s) >> _LOW).astype(np.int64), 1)
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([-1], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, digest binary")


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Rows ``key, node, shared`` of all shingles. 0: one occurrence. Of a slice of a task, shingles with several documents are counted
    there: a positive number is that count of a node's shingles, -1 the one row that still tells the other tasks of the shingle.
    """

    def slice_rows(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        same = keys[1:] == keys[:-1]
        again, more = np.append(False, same), np.append(same, False)
        counts = np.bincount(owner[again | more], minlength=len(sets))
        node, some = np.array(nodes, np.int64), np.flatnonzero(counts)
        send = ~again
        key = np.concatenate([keys[send], mixed(node[some].astype(np.uint64))]).view(np.int64)
        shared = np.concatenate([np.where(more[send], -1, 0), counts[some]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([node[owner[send]], node[some]])), pa.array(shared)], names=["key", "node", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size, seen = [], [], 0, set()
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if not len(s) or digest in seen:  # a copy says nothing new of its class
                    continue
                seen.add(digest)
                nodes.append(node)
                sets.append(s)
                size += len(s)
                if size > SLICE_KEYS:
                    yield slice_rows(nodes, sets)
                    nodes, sets, size = [], [], 0
                    if len(seen) > 1 << 16:
                        seen = set()
        if size:
            yield slice_rows(nodes, sets)

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "key long, node long, shared int")


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: how many of a node's shingles stand in another document too, in parts that add up."""
    held: tuple | None = None  # the last row while its key may go on, and whether it is known to be shared
    for batch in _closed(batches):
        if batch is None:
            key, node, shared = (np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
        else:
            key, node, shared = (c.to_numpy() for c in batch.columns)
        counted = shared > 0
        ready = [(node[counted], shared[counted])]
        key, node, shared = key[~counted], node[~counted], shared[~counted]
        known = np.zeros(len(key), bool)
        if held is not None:
            key, node, shared, known = np.append(held[0], key), np.append(held[1], node), np.append(held[2], shared), np.append(held[3], known)
        if len(key):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))
            several = (np.diff(np.append(start, len(key))) > 1) | np.logical_or.reduceat((shared < 0) | known, start)
            # The last row waits: it may be its key's first of several.
            done = np.ones(len(key), bool)
            done[-1] = batch is None or bool(several[-1])
            take = done & (shared == 0) & several[group] & ~(known & (shared == 0) & (np.arange(len(key)) == 0))
            ready.append((node[take], np.ones(int(take.sum()), np.int32)))
            held = (key[-1], node[-1], shared[-1], bool(several[-1]))
        nodes = np.concatenate([n for n, _ in ready])
        if len(nodes):
            unique, at = np.unique(nodes, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(np.bincount(at, np.concatenate([k for _, k in ready])).astype(np.int64))], names=["node", "k"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.frombuffer(x, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["counts"])


def _order(signed: DataFrame) -> Order:
    """The order that the counts of all tasks give; sums of at most 16 partitions, half a megabyte each, come to the driver."""
    rows = signed.filter("n < 0").select("digest").repartition(16).mapInArrow(_summed, "counts binary").collect()
    return Order(sum((np.frombuffer(r.counts, "<i8") for r in rows), np.zeros(BUCKETS, np.int64)))


def combined(nodes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows ``key, node, low`` of a slice: of each key its first node; any other node of it is tied to that one, ``low``, under a key of its own."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    new = np.append(True, keys[1:] != keys[:-1])
    first = np.repeat(nodes[new], np.diff(np.append(np.flatnonzero(new), len(keys))))
    tied = ~new & (first != nodes)
    pairs = np.unique(np.stack([nodes[tied], first[tied]], axis=1), axis=0)
    spread = mixed(pairs[:, 0].astype(np.uint64))
    low = pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(pairs[:, 1])])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[new], spread]).view(np.int64)), pa.array(np.concatenate([nodes[new], pairs[:, 0]])), low], names=["key", "node", "low"])


def _keys(docs: DataFrame, width: int, percent: int, order: Order) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, size = [], [], 0

        def rows() -> pa.RecordBatch:
            return combined(np.repeat(np.array(nodes, np.int64), [len(k) for k in keys]), np.concatenate(keys))

        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                nodes.append(node)
                keys.append(order.first(s, percent))
                size += len(keys[-1])
                if size > SLICE_KEYS:
                    yield rows()
                    nodes, keys, size = [], [], 0
        if size:
            yield rows()

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "key long, node long, low long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: ties every node to the first of its key; of a key only that one is remembered. Rows with ``low`` are ties already."""
    last_key, last_first = None, 0
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        done = np.zeros((0, 2), np.int64)
        if batch.num_columns > 2:
            known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            done = np.stack([node[known], batch.column(2).drop_null().to_numpy()], axis=1)
            key, node = key[~known], node[~known]
        tied = first = np.zeros(0, bool)
        if len(key):
            new = np.append(key[0] != last_key, key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            first = np.full(len(key), last_first, np.int64)
            if len(starts):
                first[starts[0] :] = np.repeat(node[starts], np.diff(np.append(starts, len(key))))
            last_key, last_first = key[-1], int(first[-1])
            tied = first != node
        pairs = np.unique(np.concatenate([done, np.stack([node[tied], first[tied]], axis=1)]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


_UNIT = "struct<low:int,a:int,kind:int,high:int,b:int,side:int>"


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())], names=["node", "block", "label", "units", "shingles"])

    return docs.mapInArrow(lean(run), f"node long, block long, label long, units array<{_UNIT}>, shingles binary")


def _join_units(percent: int):
    """Rows sorted by unit; joins each unit when its last row has come."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        nodes, labels, sides, sets = zip(*rows, strict=True)
        edges = divide_skip([np.frombuffer(s, np.uint64) for s in sets], np.array(sides), percent, np.array(labels))
        return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in edges], pa.int64()), pa.array([nodes[b] for _, b in edges], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for *key, side, node, label, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != unit:
                    if len(rows) > 1:
                        yield solve(rows)
                    unit, rows = key, []
                rows.append((node, label, side, s))
        if len(rows) > 1:
            yield solve(rows)

    return lean(run)


def _unit(low, a, high, b, side, kind: int = 0):
    return F.struct(low.alias("low"), a.alias("a"), F.lit(kind).alias("kind"), high.alias("high"), b.alias("b"), side.alias("side"))


def _each(n, unit):
    """``unit`` of every number below ``n``; an empty array where ``n`` is null or 0."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), unit)
    return F.when(n > 0, some).otherwise(F.filter(some, lambda x: F.lit(False)))


def _linked(docs: DataFrame, members: DataFrame, width: int, percent: int, parts: int, name: str) -> DataFrame:
    """Links found in the units of ``members`` (``node, block, label, units``)."""
    wanted = picked(staged(members.select("node", "block", "label", "units"), f"{name}-units"), "block")
    sets = _sets(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node").select("node", "text", "block", "label", "units"), width)
    key = ["block", "low", "a", "kind", "high", "b"]
    rows = sets.withColumn("unit", F.explode("units")).select("block", "unit.*", "node", "label", "shingles")
    links = rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_join_units(percent), "u long, v long")
    return staged_selective(links, name)


def _tiles(count, shingles):
    return F.greatest(F.ceil(count / TILE_DOCS), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _first_round(sized: DataFrame) -> DataFrame:
    """Units of the first round: every tile, with the pivots of its size class and of the next one."""
    load = sized.groupBy("block", "level").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    below = load.select("block", (F.col("level") + 1).alias("level"), F.col("tiles").alias("below"))
    salt = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = sized.filter("large").groupBy("block", "level", salt).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("pivot")).distinct()
    rows = sized.join(load, ["block", "level"]).join(below, ["block", "level"], "left").join(pivots, "node", "left")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    zero = F.lit(0)
    own = F.array(_unit(F.col("level"), F.col("tile"), zero, zero, zero))
    everywhere = F.concat(_each(F.col("tiles"), lambda j: _unit(F.col("level"), j, zero, zero, zero)), _each(F.when(F.col("level") > 1, F.col("below")), lambda j: _unit(F.col("level") - 1, j, zero, zero, zero)))
    return rows.select("node", "block", F.col("node").alias("label"), F.when(F.col("pivot"), everywhere).otherwise(own).alias("units"))


def _second_round(sized: DataFrame, parts_of: DataFrame) -> DataFrame:
    """Units of the second round: of large blocks, the members outside the largest component (kind 0 of tiles: rest; kind 1: that
    component) with those of their own and the neighbouring size classes.
    """
    rows = sized.filter("large").join(parts_of, "node", "left").select("node", "block", "level", "n", F.coalesce("component", "node").alias("label"))
    rows = staged(rows, "block-labels")
    most = rows.groupBy("block", "label").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    rows = rows.join(most, "block").withColumn("rest", F.col("label") != F.col("main"))
    load = rows.groupBy("block", "level").agg(_tiles(F.sum(F.col("rest").cast("int")), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0))).alias("r"), _tiles(F.sum((~F.col("rest")).cast("int")), F.sum(F.when(F.col("rest"), 0).otherwise(F.col("n")))).alias("d"))
    # Level 0 has no neighbours.
    near = lambda step: load.filter("level > 0").select("block", (F.col("level") - step).alias("level"), F.col("r").alias(f"r{step}"), F.col("d").alias(f"d{step}"))
    rows = rows.join(load, ["block", "level"]).join(near(1), ["block", "level"], "left").join(near(-1), ["block", "level"], "left")
    tile = F.pmod(F.xxhash64("node", F.lit(11)), F.when(F.col("rest"), F.col("r")).otherwise(F.col("d"))).cast("int")
    rows = rows.withColumn("tile", tile)
    level, tile, zero, one = F.col("level"), F.col("tile"), F.lit(0), F.lit(1)
    main_at = lambda step: lambda j: _unit(level, tile, level + step, j, zero, 1)
    rest_at = lambda step: lambda j: _unit(level + step, j, level, tile, one, 1)
    of_rest = F.concat(
        _each(F.col("r"), lambda j: _unit(level, F.least(tile, j), level, F.greatest(tile, j), tile)),
        _each(F.col("r1"), lambda j: _unit(level, tile, level + 1, j, zero)),
        _each(F.col("r-1"), lambda j: _unit(level - 1, j, level, tile, one)),
        *(_each(F.col(f"d{step}" if step else "d"), main_at(step)) for step in (-1, 0, 1)),
    )
    of_main = F.concat(*(_each(F.col(f"r{step}" if step else "r"), rest_at(step)) for step in (-1, 0, 1)))
    return rows.select("node", "block", "label", F.when(F.col("rest"), of_rest).otherwise(of_main).alias("units")).filter(F.size("units") > 0)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles
    of ``width`` words, or all its words as one if they are fewer. Documents are linked when 100 * intersection >= percent *
    union; those without words (null and empty texts too) are linked with nothing and are components of their own. The
    component is the smallest id reachable by links. Rows that share an id are one node: links of any of them count. Whole
    texts count; there is no limit on links or candidates. Empty tables give empty results, other columns are not read.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    counted = staged(_digests(docs, width), "set-digests")
    signed = counted.filter("n >= 0")
    classes = staged(signed.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").cast("long").alias("rep")), "set-classes")
    # A linked document shares at least its percentage of shingles with one other.
    occurrences = _occurrences(docs, width).repartition(parts, "key").sortWithinPartitions("key")
    shared = occurrences.mapInArrow(lean(_shared_counts), "node long, k long").groupBy("node").agg(F.sum("k").alias("k"))
    able = signed.filter("n > 0").join(staged(shared, "shared-shingles"), F.col("doc_id").cast("long") == F.col("node")).filter(F.col("k") * 100 >= F.col("n") * percent)
    able = staged(able.join(classes, ["n", "digest"]).select(F.col("rep").alias("able")).distinct(), "able-documents")
    some = staged_selective(docs.select("doc_id", "text").join(picked(able, "able"), F.col("doc_id").cast("long") == F.col("able")).select("doc_id", "text"), "able-texts")
    keyed = _keys(some, width, percent, _order(counted)).repartition(parts, "key").sortWithinPartitions("key")
    near = staged(keyed.mapInArrow(lean(_stars), "u long, v long").distinct(), "near")
    rep_of = signed.join(classes, ["n", "digest"]).select(F.col("doc_id").cast("long").alias("node"), "rep").distinct()
    tied = near.join(rep_of.select(F.col("node").alias("u"), F.col("rep").alias("ru")), "u").join(rep_of.select(F.col("node").alias("v"), F.col("rep").alias("rv")), "v")
    blocks = connected_components(tied.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    # A block within one tile is one unit. Decided on counts, before texts move.
    sized = blocks.withColumnRenamed("component", "block").join(classes.select(F.col("rep").alias("node"), "n").groupBy("node").agg(F.max("n").alias("n"), F.min("n").alias("least")), "node")
    # Where rows share an id but not a size, the block is dealt into tiles without size classes.
    full = sized.groupBy("block").agg(((F.count("*") > TILE_DOCS) | (F.sum("n") > TILE_SHINGLES)).alias("large"), (F.max((F.col("n") != F.col("least")).cast("int")) == 0).alias("plain"))
    # A class is a little wider than linked sets can differ, so that rounding never puts two classes between them.
    level = F.when(F.col("large") & F.col("plain"), F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))) + 1).otherwise(F.lit(0)).cast("int")
    sized = staged(sized.join(full, "block").select("node", "block", "n", "large", level.alias("level")), "block-sizes")
    discard(near, blocks)
    links = _linked(some, _first_round(sized), width, percent, parts, "links")
    parts_of = connected_components(links)
    again = _second_round(sized, parts_of)
    if not again.isEmpty():
        links = links.unionByName(_linked(some, again, width, percent, parts, "more-links"))
        parts_of = connected_components(links)
    named = classes.join(parts_of, classes["rep"] == parts_of["node"], "left").select(F.col("n").alias("_n"), F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("_component"))
    joined = signed.join(named, (F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"))


def first_of_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is its component's: of linked documents the one with the smallest id stays.

    Rows with a null id stay; of repeated rows with one id all do.
    """
    parts, key = jaccard_components(docs, width, percent), fresh_name(docs, "dropped_id")
    dropped = staged(parts.filter("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct(), "dropped-ids")
    return docs.join(dropped, docs["doc_id"] == dropped[key], "left_anti")
