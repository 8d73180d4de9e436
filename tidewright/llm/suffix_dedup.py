"""Removal of repeated byte strings with sorted suffixes.

Every window of WINDOW bytes belongs to the smallest hash among its ANCHOR-byte strings, so
equal windows belong to equal anchors; a document falls into pieces, each a run of windows with
one anchor. An anchor with one piece in the whole corpus repeats nothing. Pieces with a copy are
repeated as a whole. What is left, different pieces with the same anchor, is cut into shards that
keep an anchor together, and each shard's suffixes are sorted by external induced sorting: windows
that agree over their whole length are neighbours then. An anchor with more bytes than a shard
would be one shard of any size: its windows are hashed one by one and sorted by Spark instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, picked, staged, staged_selective
from .induced_sort import sort_suffixes
from .shingles import _BYTES, _powers, mixed

WINDOW, ANCHOR = 200, 80
#: Bytes of a document hashed at a time; bytes after which a shard ends, between anchors; windows of a piece at most.
PART, SHARD, LONGEST = 4 << 20, 1 << 20, 4096

_DOC = "doc long, version int"
_PIECE = "anchor long, piece long, doc long, version int, start int, windows int, inner boolean"


def pieces_of(text: bytes, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, hash of the bytes, first window and number of windows of each piece of a text, and whether its anchor may stand in it twice."""
    for at in range(0, len(text) - window + 1, PART):
        raw = np.frombuffer(text[at : at + PART + window - 1], np.uint8)
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
        h = mixed((total[anchor:] - total[:-anchor]) * down[: len(raw) - anchor + 1])
        width, n = window - anchor + 1, len(h)
        rows = np.append(h, np.full(-n % width, 2**64 - 1, np.uint64)).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
        new = np.append(True, least[1:] != least[:-1])
        start = np.flatnonzero(new)
        if int(np.diff(np.append(start, len(least))).max()) > LONGEST:
            since = np.arange(len(least)) - np.repeat(start, np.diff(np.append(start, len(least))))
            start = np.flatnonzero(new | (since % LONGEST == 0))
        end = np.append(start[1:], len(least))
        piece = _chained(h, start, end - 1 + window, anchor)
        # An anchor's places: where a string is the smallest of some window that it lies in.
        over = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        over = np.append(over, np.zeros(-len(over) % width, np.uint64)).reshape(-1, width)
        ahead = np.maximum.accumulate(over, axis=1).ravel()
        behind = np.maximum.accumulate(over[:, ::-1], axis=1)[:, ::-1].ravel()
        places = h[np.flatnonzero(np.maximum(behind[:n], ahead[width - 1 : width - 1 + n]) == h)]
        twice = places[1:][places[1:] == places[:-1]]
        inner = np.isin(least[start], twice) if len(twice) else np.zeros(len(start), bool)
        yield least[start], piece, start + at, end - start, inner


def _chained(h: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: int) -> np.ndarray:
    """Hashes of the bytes start..stop-1: of their anchor-long strings end to end and the last one, each mixed into what came before."""
    size = stop - start
    out = mixed(size.astype(np.uint64) ^ h[stop - anchor])
    at = np.arange(len(start))
    for k in range(0, int(size.max()) - anchor + 1, anchor):
        at = at[size[at] >= k + anchor]
        out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) + h[start[at] + k])
    return out


def _cut(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list, docs: list, versions: list, counts: list) -> pa.RecordBatch:
            a, p, s, n, inner = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(p.view(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), counts)), pa.array(np.repeat(np.array(versions, np.int32), counts)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inner)],
                names=["anchor", "piece", "doc", "version", "start", "windows", "inner"],
            )

        for batch in batches:
            rows, docs, versions, counts, size = [], [], [], [], 0
            for doc, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in pieces_of(text, window, anchor):
                    rows.append(part)
                    docs.append(doc)
                    versions.append(version)
                    counts.append(len(part[0]))
                    size += counts[-1]
                if size > 1 << 18:
                    yield out(rows, docs, versions, counts)
                    rows, docs, versions, counts, size = [], [], [], [], 0
            if size:
                yield out(rows, docs, versions, counts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and piece, those whose anchor comes again, whether they have a copy and whether they are the first of it."""
    held: pa.RecordBatch | None = None  # the last row, whose successor isn't known yet
    before: tuple | None = None  # anchor and piece before it
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        known = [b for b in (held, batch) if b is not None]
        if not known:
            return
        whole = pa.Table.from_batches(known).combine_chunks().to_batches()[0]
        anchor, piece = whole.column(0).to_numpy(), whole.column(1).to_numpy()
        same_a, same_p = anchor[1:] == anchor[:-1], (anchor[1:] == anchor[:-1]) & (piece[1:] == piece[:-1])
        first_a = before is not None and before[0] == anchor[0]
        first_p = first_a and before[1] == piece[0]
        prev_a, prev_p = np.append(first_a, same_a), np.append(first_p, same_p)
        next_a, next_p = np.append(same_a, False), np.append(same_p, False)
        done = len(anchor) if batch is None else len(anchor) - 1
        take = np.flatnonzero((prev_a | next_a | (whole.column(6).to_numpy(zero_copy_only=False)))[:done])
        if len(take):
            part = whole.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array((prev_p | next_p)[take]), pa.array(~prev_p[take])], names=[*whole.schema.names, "copied", "leads"])
        if batch is not None:
            held = whole.slice(done, 1)
            before = (anchor[-2], piece[-2]) if len(anchor) > 1 else before


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the ``window`` bytes from each of ``a`` and ``b`` on are the same, eight at a time."""
    step = min(8, window)
    words = np.lib.stride_tricks.sliding_window_view(raw, step).view(f"V{step}")[:, 0] if step < 8 else np.ndarray(max(0, len(raw) - 7), "<u8", raw, 0, (1,))
    out = np.ones(len(a), bool)
    left = np.arange(len(a))
    for k in [*range(0, window - step + 1, step), window - step]:
        equal = words[a[left] + k] == words[b[left] + k]
        if not equal.all():
            out[left[~equal]] = False
            left = left[equal]
    return out


def repeated_windows(pieces: list[tuple[bytes, int]], window: int = WINDOW) -> list[np.ndarray]:
    """Of each piece (bytes, windows), which windows stand in another place of these pieces too.

    Suffixes that share a window are neighbours in their order. A fingerprint picks the neighbours whose common prefix may be that
    long, their bytes decide.
    """
    size = sum(len(t) + 1 for t, _ in pieces) + 1
    text = np.zeros(size, np.int64)
    is_window, at, starts = np.zeros(size, bool), 0, []
    for t, n in pieces:
        text[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int64) + 2
        text[at + len(t)] = 1
        is_window[at : at + n] = True
        starts.append(at)
        at += len(t) + 1
    order = sort_suffixes(text, 258)
    order = order[is_window[order]]
    up, down = _powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(mixed(text.astype(np.uint64)) * up[:size], out=total[1:])
    prefix = (total[order + window] - total[order]) * down[order]
    same = prefix[1:] == prefix[:-1]
    maybe = np.flatnonzero(same)
    same[maybe] = same_bytes((text - 2).astype(np.uint8), order[maybe], order[maybe + 1], window)
    found = np.zeros(size, bool)
    found[order[:-1][same]] = found[order[1:][same]] = True
    return [found[a : a + n] for a, (_, n) in zip(starts, pieces, strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def _sort_shards(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def solve() -> pa.RecordBatch:
            doc, version, lo, hi = [], [], [], []
            for (_, d, v, s, _, copied, _), flags in zip(rows, repeated_windows([(r[6], r[4]) for r in rows], window), strict=True):
                if not copied:
                    for a, b in zip(*_runs(flags), strict=True):
                        doc.append(d)
                        version.append(v)
                        lo.append(s + int(a))
                        hi.append(s + int(b))
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(version, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["doc", "version", "lo", "hi"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and rows and rows[-1][0] != row[0]:
                    yield solve()
                    rows.clear()
                    size = 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield solve()

    return run


def _hash_windows(window: int):
    """Anchor, hash and place of every window of the wanted pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple], places: list, hashes: list) -> pa.RecordBatch:
            counts = [len(h) for h in hashes]
            fixed = [pa.array(np.repeat(np.array(c, t), counts)) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.int32, bool), strict=True)]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64))], names=["anchor", "doc", "version", "copied", "at", "h"])

        for batch in batches:
            rows, places, hashes, size = [], [], [], 0
            for doc, version, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    s, n = w["start"], w["windows"]
                    raw = np.frombuffer(text[s : s + n + window - 1], np.uint8)
                    up, down = _powers(len(raw) + 1)
                    total = np.zeros(len(raw) + 1, np.uint64)
                    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
                    rows.append((w["anchor"], doc, version, w["copied"]))
                    places.append(np.arange(s, s + n))
                    hashes.append(mixed((total[window:] - total[:-window]) * down[:n]))
                    size += n
                    if size > 1 << 18:
                        yield out(rows, places, hashes)
                        rows, places, hashes, size = [], [], [], 0
            if rows:
                yield out(rows, places, hashes)

    return run


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and anchor, those that equal a neighbour and aren't of copied pieces."""
    held: pa.RecordBatch | None = None  # the last row, whose successor isn't known yet
    before = False  # whether it equals the row before it
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        known = [b for b in (held, batch) if b is not None]
        if not known:
            return
        whole = pa.Table.from_batches(known).combine_chunks().to_batches()[0]
        anchor, h = whole.column(0).to_numpy(), whole.column(5).to_numpy()
        same = (anchor[1:] == anchor[:-1]) & (h[1:] == h[:-1])
        back, ahead = np.append(before, same), np.append(same, False)
        done = len(h) if batch is None else len(h) - 1
        take = np.flatnonzero(((back | ahead) & ~whole.column(3).to_numpy(zero_copy_only=False))[:done])
        if len(take):
            part = whole.take(pa.array(take))
            lo = part.column(4)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lo, pa.array(lo.to_numpy() + 1, pa.int32())], names=["doc", "version", "lo", "hi"])
        if batch is not None:
            held, before = whole.slice(done, 1), bool(back[-1])


def _fetch(window: int):
    """Bytes of the wanted pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "doc", "version", "start", "windows", "copied", "bytes"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            rows, size = [], 0
            for doc, version, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in wanted:
                    s, n = w["start"], w["windows"]
                    rows.append((w["anchor"], doc, version, s, n, w["copied"], text[s : s + n + window - 1]))
                    size += n + window
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return run


def _strip(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, gone, runs, at = [], 0, 0, 0
                end = -1
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
                    hi += window - 1
                    if lo > end:
                        kept.append(text[at:lo])
                        runs += 1
                        gone += hi - lo
                        end = at = hi
                    elif hi > end:
                        gone += hi - end
                        end = at = hi
                kept.append(text[at:])
                rest = b"".join(kept)
                sizes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest if with_text else None)
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the remaining bytes ``kept`` with ``with_text``.

    A text is its UTF-8 bytes, null is empty. Every byte that lies in a ``window``-byte string that also starts anywhere else, in
    any document, is removed; strings are those of the input and never cross documents. ``n_spans`` counts maximal removed runs.
    Shorter texts stay whole. Rows that share an id are documents of their own if their texts differ; a repeated row repeats its
    whole text. Empty tables give empty results; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    text = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.hash("text").alias("version"), text.alias("text"))
    pieces = keyed.select("doc", "version", "text").filter(F.length("text") >= window).mapInArrow(lean(_cut(window, anchor)), _PIECE)
    pieces = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "piece")
    repeated = staged(pieces.mapInArrow(lean(_repeated), _PIECE + ", copied boolean, leads boolean"), "repeated-pieces")
    leads = repeated.filter("leads")
    several = leads.groupBy("anchor").agg(F.count("*").alias("pieces"), F.max("inner").alias("inner"), (F.sum(F.col("windows") + (window - 1)) > SHARD).alias("hot")).filter("pieces > 1 or inner").select("anchor", "hot")
    wanted = leads.join(several, "anchor").groupBy("hot", "doc", "version").agg(F.collect_list(F.struct("anchor", "start", "windows", "copied")).alias("wanted"))
    every = staged(wanted, "wanted-pieces")
    wanted = picked(every.filter("not hot").drop("hot"), "doc")
    # A repeated row's piece is wanted of one of the rows only; more would do no harm.
    sources = keyed.select("doc", "version", "text").join(wanted, ["doc", "version"])
    fetched = sources.mapInArrow(lean(_fetch(window)), "anchor long, doc long, version int, start int, windows int, copied boolean, bytes binary")
    shards = fetched.repartition(parts, "anchor").sortWithinPartitions("anchor")
    sorted_ = staged_selective(shards.mapInArrow(lean(_sort_shards(window)), _DOC + ", lo int, hi int"), "repeated-windows")
    hot, found = every.filter("hot").drop("hot"), [sorted_]
    if not hot.isEmpty():
        texts = keyed.select("doc", "version", "text").join(picked(hot, "doc"), ["doc", "version"])
        places = texts.mapInArrow(lean(_hash_windows(window)), "anchor long, doc long, version int, copied boolean, at int, h long")
        places = places.repartition(parts, "h", "anchor").sortWithinPartitions("h", "anchor")
        equal = staged_selective(places.mapInArrow(lean(_equal_windows), _DOC + ", lo int, hi int"), "equal-windows")
        found, sorted_ = [*found, equal], sorted_.unionByName(equal)
    whole = repeated.filter("copied").select("doc", "version", F.col("start").alias("lo"), (F.col("start") + F.col("windows")).alias("hi"))
    ranges = whole.unionByName(sorted_).groupBy("doc", "version").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = staged(ranges, "ranges")
    discard(repeated, every, *found)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = keyed.join(picked(ranges, "doc"), ["doc", "version"]).select("doc_id", "text", "ranges").mapInArrow(lean(_strip(window, with_text)), schema)
    cut = staged_selective(cut, "cut-documents")
    # Texts that stay whole need no shuffle, only their digests do.
    whole_text = F.col("text") if with_text else F.lit(None).cast("binary")
    same = keyed.select("doc", "version", "doc_id", F.length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), whole_text.alias("kept"))
    out = same.join(ranges, ["doc", "version"], "left_anti").drop("doc", "version").unionByName(cut)
    return out if with_text else out.drop("kept")
