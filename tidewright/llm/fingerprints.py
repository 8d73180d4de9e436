"""Document fingerprints by winnowing, and how much of them outlives an edit.

Every ``GRAM`` consecutive code points have a rolling hash; of every ``WINDOW`` consecutive hashes the smallest is chosen, of equal
ones the rightmost. Two texts that share a passage of ``GRAM + WINDOW - 1`` code points share a chosen hash, whatever stands around
it; positions are kept, so that what is shared can be found again.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, discard, lean, staged
from .ordering import only
from .shingles import mixed

GRAM = 16
WINDOW = 48
#: Hashes made at a time; a text of any length needs the memory of one slice beside its own code points.
SLICE = 1 << 16
#: Two prime moduli with a base each: rolling sums stay exact in 64 bits, and no text makes them collide by construction.
_MODULI = ((2147483647, 1103515245), (2147483629, 1664525))
_ITEM = np.dtype([("step", "u1"), ("hash", "<u8")])
#: Gram and window together stay below this.
_MARGIN = 1024
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(modulus: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to the longest slice."""
    n = SLICE + _MARGIN
    if modulus not in _POWERS:
        made = []
        for b in (base, pow(base, -1, modulus)):
            up = np.ones(n, np.uint64)
            done = 1
            while done < n:
                more = min(done, n - done)
                up[done : done + more] = up[:more] * np.uint64(pow(b, done, modulus)) % np.uint64(modulus)
                done += more
            made.append(up)
        _POWERS[modulus] = (made[0], made[1])
    return _POWERS[modulus]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of every ``gram`` consecutive code points of a slice."""
    n = len(codes) - gram + 1
    value = codes.astype(np.uint64) + np.uint64(1)
    both = np.zeros(n, np.uint64)
    for modulus, base in _MODULI:
        up, down = _powers(modulus, base)
        m = np.uint64(modulus)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value * up[: len(codes)] % m, out=total[1:])
        both = (both << np.uint64(32)) | ((total[gram:] - total[:n]) % m * down[:n] % m)
    return mixed(both)


def rightmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For every ``window`` consecutive values, the place of the smallest, of equal ones the last. Blocks of one window's length are
    run through from both ends; a window is the end of one and the beginning of the next.
    """
    n = len(h) - window + 1
    rows = -(-len(h) // window)
    grid = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(h)] = h
    grid = grid.reshape(rows, window)
    place = np.arange(rows * window).reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1)
    ahead_at = np.maximum.accumulate(np.where(grid == ahead, place, -1), axis=1)
    turned = grid[:, ::-1]
    back = np.minimum.accumulate(turned, axis=1)
    fresh = np.ones(turned.shape, bool)
    fresh[:, 1:] = turned[:, 1:] < back[:, :-1]
    back_at = np.minimum.accumulate(np.where(fresh, place[:, ::-1], rows * window), axis=1)[:, ::-1]
    back = back[:, ::-1]
    first, last = back.ravel()[:n], ahead.ravel()[window - 1 : window - 1 + n]
    return np.where(last <= first, ahead_at.ravel()[window - 1 : window - 1 + n], back_at.ravel()[:n])


def winnow(codes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen grams, in order.

    A text with fewer grams than a window is one window; one with fewer code points than a gram is one gram; an empty one has none.
    """
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = min(gram, len(codes))
    grams = len(codes) - gram + 1
    window = min(window, grams)
    places, hashes = [], []
    for at in range(0, grams - window + 1, SLICE):
        stop = min(at + SLICE, grams - window + 1) + window - 1
        h = gram_hashes(codes[at : stop + gram - 1], gram)
        p = rightmost_minima(h, window)
        p = p[np.r_[True, p[1:] != p[:-1]]]
        places.append(p + at)
        hashes.append(h[p])
    place, hash_ = np.concatenate(places), np.concatenate(hashes)
    keep = np.r_[True, place[1:] != place[:-1]]
    return place[keep], hash_[keep]


def rewinnow(codes: np.ndarray, old: tuple[np.ndarray, np.ndarray], same: int, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """:func:`winnow` of ``codes``, whose first ``same`` code points begin the text that ``old`` was made of.

    Windows that lie within what is the same choose what they chose before; only from the last of them on the text is read again.
    """
    last = same - gram - window + 1
    if last <= 0 or len(codes) - gram + 1 < window:
        return winnow(codes, gram, window)
    place, hash_ = winnow(codes[last:], gram, window)
    keep = np.searchsorted(old[0], place[0] + last)
    return np.concatenate([old[0][:keep], place + last]), np.concatenate([old[1][:keep], hash_])


def packed(place: np.ndarray, hash_: np.ndarray) -> str:
    """A fingerprint as text: base64 of (step from the place before, 1 byte; hash, 8 bytes) in order of places."""
    items = np.empty(len(place), _ITEM)
    items["step"], items["hash"] = np.diff(place, prepend=0), hash_
    return base64.b64encode(items.tobytes()).decode("ascii")


def unpacked(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    items = np.frombuffer(base64.b64decode(fingerprint), _ITEM)
    return np.cumsum(items["step"].astype(np.int64)), items["hash"].astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


class _Read:
    """A text with its fingerprint."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.codes = code_points(text)
        self.chosen = winnow(self.codes)
        self.hashes = np.unique(self.chosen[1])

    def row(self, after: _Read) -> tuple:
        n = len(self.text)
        cut = n // 4
        edited = self.text[: n - cut] + after.text[:cut]
        chosen = rewinnow(np.concatenate([self.codes[: n - cut], after.codes[:cut]]), self.chosen, n - cut)
        return (
            self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(*self.chosen), packed(*chosen), likeness(self.hashes, np.unique(chosen[1])), likeness(self.hashes, after.hashes),
        )


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _split_points(keys: DataFrame) -> list[tuple]:
    """The first (doc_id, hash) of each of four times as many ranges as there are shuffle partitions, few enough for the driver."""
    parts = 4 * max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = keys.repartitionByRange(parts, "doc_id", "hash").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    return [_key(r["first"]["doc_id"], r["first"]["hash"]) for r in ranged.orderBy("part").collect()]


def _key(doc_id, h) -> tuple:
    return (doc_id is not None, doc_id if doc_id is not None else 0, h)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text of ``docs``, of its edited text, and their likeness.

    The edited text has its last quarter of code points (rounded down) replaced by as many of the next document, or all that it has;
    the next document is the next by ascending doc_id (null first; rows of one doc_id by a hash of their text), after the last one the
    first. Null text counts as empty; an empty text has an empty fingerprint, whose likeness is 1 to an empty one and 0 to others.
    Repeated rows are documents of their own, each other's next. A single document is its own next. No documents give no rows; other
    columns, whatever their names, are not read.

    Texts move once, dealt by ranges of doc_id and sorted within them; the first document of a range is sent to the range before it
    as well. A task holds two texts at a time.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; fingerprints as :func:`packed`.
    """
    bounded_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    keys = staged(rows.select("doc_id", "hash"), "document-keys")
    points = _split_points(keys)
    discard(keys)
    dealt = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("extra", T.BooleanType()), *rows.schema])
    out = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(_OUT)])
    dealt_arrow, out_arrow = to_arrow_schema(dealt), to_arrow_schema(out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_ = [_key(*k) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            bucket = [bisect_right(points, k) - 1 for k in keys_]
            heads = [i for i, (k, b) in enumerate(zip(keys_, bucket, strict=True)) if points[b] == k]
            for which, numbers, extra in ((None, bucket, False), (heads, [(bucket[i] - 1) % len(points) for i in heads], True)):
                part = batch if which is None else batch.take(pa.array(which, pa.int64()))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([extra] * part.num_rows), *part.columns], schema=dealt_arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found, size = None, [], 0
        for batch in batches:
            for extra, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                if extra and before is None:  # a repeated row of the document that has come already
                    continue
                now = _Read(doc_id, text.as_py())
                if before is not None:
                    found.append(before.row(now))
                    size += len(found[-1][3]) + len(found[-1][4]) + 200
                before = None if extra else now
                if size > 1 << 22:
                    yield _batch(found, out_arrow)
                    found, size = [], 0
        if found:
            yield _batch(found, out_arrow)

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moved = rows.mapInArrow(lean(deal), dealt).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "hash")
    return moved.mapInArrow(lean(scan), out)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
