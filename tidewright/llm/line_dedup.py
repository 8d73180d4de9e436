"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are sequences of words; two lines are alike when at most one word has to be inserted,
deleted or replaced. Distinct lines come first, each with its earliest place. Two lines one edit
apart share a variant: one of them with a word left out is the other, or both are the same with
the word at one place left out. Variants are hashed keys with that place; of each key and place
the earliest line is tied to the others, of each key the whole line to all. Nothing else is
paired, so a template with thousands of fillings costs no more than its lines, and of a slice of
a task only the earliest line of a key and place is sent on. The edit distance of what is tied
is verified on the word hashes; a line with an earlier line alike goes.

Only lines that can have a partner emit variants: lines one edit apart agree in their first or in
their last half, so lines that share no half with another are ruled out exactly. Lines are
numbered in order of their places, so that a variant is a key, a place and one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, fresh_name, lean, picked, staged, staged_selective
from .jaccard_join import SLICE_KEYS, _stars, combined
from .shingles import Sequences, mixed, slices, word_hashes

#: Lines of fewer words go only as exact copies; with one edit allowed, five words are a similarity of 0.8.
MIN_WORDS = 5

_SALT = np.uint64(0xE7037ED1A0B428DB)
_NULL_ID = 2**63 - 1


def line_hashes(texts: list[str | None], min_words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Slice by slice, of every line with a word: text, line number, two hashes, whether it has ``min_words`` words, hashes of four halves of those that have; then the lines of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for part in slices([len(t) for t in raw]):
        some = raw[part]
        words, start, _, _ = word_hashes(some, lower=False)
        joined = np.frombuffer(b"\n".join([*some, b""]), np.uint8)
        ends = np.flatnonzero(joined == 10)  # each text ends with one
        begins = np.cumsum(np.array([0, *(len(t) + 1 for t in some)], np.int64))
        owner = np.searchsorted(begins, ends, "right") - 1
        number = np.arange(len(ends)) - np.searchsorted(ends, begins[:-1])[owner]
        to = np.searchsorted(start, ends)
        at = np.append(0, to[:-1])
        n = to - at
        whole, other = Sequences(words), Sequences(mixed(words ^ _SALT), 1)
        keep = np.flatnonzero(n)
        a, b, n = at[keep], to[keep], n[keep].astype(np.uint64)
        first, second = whole.of(a, b, n), other.of(a, b, n)
        long = n >= min_words
        a, b, n, halves = a[long], b[long], n[long], []
        for m in (n, n - np.uint64(1)):  # as the line is, and as the longer of two lines
            half = (m >> np.uint64(1)).astype(np.int64)
            rest = m.astype(np.int64) - half
            halves.append(whole.of(a, a + half, m << np.uint64(1)))
            halves.append(whole.of(b - rest, b, (m << np.uint64(1)) + np.uint64(1)))
        yield owner[keep] + part.start, number[keep], first, second, long, halves, np.bincount(owner, minlength=len(some))


def _scan(min_words: int):
    """Place and two hashes of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = batch.column(0), batch.column(1)
            for owner, number, first, second, *_ in line_hashes(batch.column(2).to_pylist(), min_words):
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays([doc.take(rows), version.take(rows), pa.array(number.astype(np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], names=["doc", "version", "no", "h1", "h2"])

    return lean(run)


def _halves(min_words: int):
    """Halves of the lines of ``min_words`` words, as keys, with the first hash of the line; equal ones of a slice are tied there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, size = [], [], 0
        for batch in batches:
            for _, _, first, _, long, halves, _ in line_hashes(batch.column(0).to_pylist(), min_words):
                nodes.append(np.tile(first[long], 4))
                keys.append(np.concatenate(halves))
                size += len(keys[-1])
                if size > SLICE_KEYS:
                    yield combined(np.concatenate(nodes).view(np.int64), np.concatenate(keys))
                    nodes, keys, size = [], [], 0
        if size:
            yield combined(np.concatenate(nodes).view(np.int64), np.concatenate(keys))

    return lean(run)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of wanted lines."""
    for batch in batches:
        line, words_out = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = text.split("\n")
            words, _, _, first = word_hashes([lines[w["no"]].encode("utf-8", "surrogatepass") for w in wanted], lower=False)
            for k, w in enumerate(wanted):
                line.append(w["line"])
                words_out.append(words[first[k] : first[k + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(words_out, pa.binary())], names=["line", "words"])


def variant_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line and of the line without each of its words, and the places left out (-1: none)."""
    n = len(words)
    sums = Sequences(words)
    whole = sums.of(np.zeros(1, np.int64), np.full(1, n), np.full(1, n, np.uint64))
    return np.append(whole, sums.without_each(np.full(1, n - 1, np.uint64))), np.arange(-1, n)


def _group_starts(new: np.ndarray) -> np.ndarray:
    """Of every row, the first row of its group; -1 where that lies before the first row."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, place, line, low``: of each key and place of a slice the earliest line; the others are tied to it, ``low``."""

    def out(keys: list, places: list, lines: list) -> pa.RecordBatch:
        key, place, line = np.concatenate(keys).view(np.int64), np.concatenate(places).astype(np.int32), np.repeat(np.array(lines, np.int64), [len(k) for k in keys])
        order = np.lexsort((line, place, key))
        key, place, line = key[order], place[order], line[order]
        new = np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))
        low = line[_group_starts(new)]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(line), pa.array(low, mask=new)], names=["key", "place", "line", "low"])

    keys, places, lines, size = [], [], [], 0
    for batch in batches:
        for line, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            k, p = variant_keys(np.frombuffer(words, np.uint64))
            keys.append(k)
            places.append(p)
            lines.append(line)
            size += len(k)
            if size > SLICE_KEYS:
                yield out(keys, places, lines)
                keys, places, lines, size = [], [], [], 0
    if size:
        yield out(keys, places, lines)


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, place and line: lines, each with an earlier one that shares a variant.

    What is remembered from batch to batch: the whole line of the key (-1: none), the earliest of its key and place.
    """
    last_key = last_place = last_whole = last_best = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tied = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
        late, early = [batch.column(2).to_numpy()[tied]], [batch.column(3).drop_null().to_numpy()]
        key, place, line = (batch.column(k).to_numpy()[~tied] for k in range(3))
        if len(key):
            new_key = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
            new_place = new_key | np.append(place[0] != last_place, place[1:] != place[:-1])
            k, p = _group_starts(new_key), _group_starts(new_place)
            whole = np.where(k >= 0, np.where(place[k] < 0, line[k], -1), -1 if last_whole is None else last_whole)
            best = np.where(p >= 0, line[p], -1 if last_best is None else last_best)
            part = place >= 0
            for mask, a, b in ((part & (best != line), line, best), (part & (whole >= 0) & (whole < line), line, whole), (part & (whole > line) & new_place, whole, line)):
                late.append(a[mask])
                early.append(b[mask])
            last_key, last_place, last_whole, last_best = key[-1], place[-1], whole[-1], best[-1]
        pairs = np.unique(np.stack([np.concatenate(late), np.concatenate(early)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["line", "partner"])


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether word sequences are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    m = min(len(a), len(b))
    differs = np.flatnonzero(a[:m] != b[:m])
    k = int(differs[0]) if len(differs) else m
    i, j = k + (len(a) >= len(b)), k + (len(b) >= len(a))
    return np.array_equal(a[i:], b[j:])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines whose partner is at most one edit away."""
    for batch in batches:
        good = [one_edit(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield batch.filter(pa.array(good, pa.bool_())).select(["line"])


def _place(docs: DataFrame) -> tuple[Column, Column]:
    """A row's place among all: its id (null ids last), rows that share one by a hash of their text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)), F.xxhash64(docs["text"])


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc, version, dropped``: the numbers of the lines to drop, for each document that has any.

    A line goes when an earlier line anywhere is alike: equal, or one word inserted, deleted or replaced. Earlier means a smaller
    id (null ids last, rows that share an id by a hash of their text), then a smaller line number. Lines of fewer than
    ``min_words`` words go only when equal, lines without words stay. A repeated row is its own twin, not an earlier one: all its
    copies are treated alike. An empty table has no lines to drop. Words, halves and variants are compared by 64-bit hashes, equal
    lines by two hashes over other fields and bases, near ones by their words. A line without blanks is one word, so scripts that are
    written without them have exact copies only.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    doc, version = _place(docs)
    keyed = docs.select(doc.alias("doc"), version.alias("version"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    seen = staged(keyed.mapInArrow(_scan(min_words), "doc long, version long, no int, h1 long, h2 long"), "lines")
    place = F.struct("doc", "version", "no")
    lines = staged(seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "distinct-lines")
    halves = keyed.select("text").mapInArrow(_halves(min_words), "key long, node long, low long").repartition(parts, "key").sortWithinPartitions("key")
    able = staged(halves.mapInArrow(lean(_stars), "u long, v long").select(F.explode(F.array("u", "v")).alias("h1")).distinct(), "able-lines")
    # In order of their places: the smaller number is the earlier line.
    numbered = lines.join(able, "h1").select("h1", "h2", "first").orderBy("first").select(F.monotonically_increasing_id().alias("line"), "h1", "h2", "first.*")
    numbered = staged(numbered, "numbered-lines")
    wanted = staged(numbered.groupBy("doc", "version").agg(F.collect_list(F.struct("no", "line")).alias("wanted")), "wanted-lines")
    # One row per document, were it repeated, is enough.
    words = keyed.join(picked(wanted, "doc"), ["doc", "version"]).select("text", "wanted").mapInArrow(lean(_words_of), "line long, words binary").dropDuplicates(["line"])
    words = staged_selective(words, "line-words")
    variants = words.mapInArrow(lean(_variants), "key long, place int, line long, low long").repartition(parts, "key").sortWithinPartitions("key", "place", "line")
    pairs = staged(variants.mapInArrow(lean(_ties), "line long, partner long").distinct(), "tied-lines")
    sides = pairs.join(words.select("line", F.col("words").alias("a")), "line").join(words.select(F.col("line").alias("partner"), F.col("words").alias("b")), "partner")
    near = sides.select("line", "a", "b").mapInArrow(lean(_verify), "line long").distinct()
    near = staged(near.join(numbered, "line").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.lit(True).alias("near")), "near-lines")
    again = lines.join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left").filter("copies > 1 OR near")
    again = staged(again.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "repeated-lines")
    late = seen.join(picked(again, "h1"), ["h1", "h2"]).filter(F.col("near") | (place > F.col("first")))
    dropped = staged_selective(late.groupBy("doc", "version").agg(F.array_sort(F.collect_set("no")).alias("dropped")), "dropped-lines")
    discard(seen, lines, able, numbered, wanted, words, pairs, near, again)
    return dropped


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, dropped_lines`` (numbers from 0, ascending, joined by commas; empty if none).

    Lines end at line feeds; null and empty texts have one line. An empty table gives an empty result.
    """
    dropped = dropped_lines(docs, min_words)
    doc, version = _place(docs)
    rows = docs.select("doc_id", doc.alias("doc"), version.alias("version"), (F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1).cast("long").alias("n_lines"))
    joined = rows.join(dropped, ["doc", "version"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"))


def drop_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines of :func:`dropped_lines` taken out of ``text``; all rows and columns stay, texts may become empty."""
    names = [fresh_name(docs, x) for x in ("line_doc", "line_version", "line_dropped")]
    dropped = dropped_lines(docs, min_words).toDF(*names)
    doc, version = _place(docs)
    joined = docs.join(dropped, (doc == dropped[names[0]]) & (version == dropped[names[1]]), "left")
    index = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, numbers in zip(batch.column(index).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if numbers:
                    out = set(numbers)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[index] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.select(*[docs[c] for c in docs.columns], names[2]).mapInArrow(lean(run), T.StructType(docs.schema.fields))
