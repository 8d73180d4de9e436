"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Documents are cut so that every piece but the shortest fills a reciprocal of the capacity: the
longest of C, C/2, C/3, ... that fits is cut off until fewer than SMALL tokens are left, which
stay one piece. Pieces of one length form a class; a bin of class j takes exactly j of them,
whoever made them, so bins fill without any search: a piece's rank in its class gives its bin
and its place. Ranks are prefix sums in two levels. What is left of the classes (fewer than j
pieces in class j, some ten thousand short pieces at most, whatever the corpus) is packed
best-fit in one small task.
"""

from __future__ import annotations

import bisect
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name, lean, staged

CAPACITY = 4096
END_ID = 2
#: Text that is tokenised at a time, in bytes. Words that a worker remembers.
SLICE_BYTES, CACHE_WORDS = 4 << 20, 300_000
CHUNK_ROWS = 1 << 15
#: How tokenizers are set up that lower-case and cut between letters or digits and what is neither.
_LOWER = {"type": "Lowercase"}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
#: ASCII punctuation but the apostrophe, at a word's end, behind an ASCII or Latin-1 letter or a digit.
_TAIL = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)$"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    small = math.isqrt(capacity)
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest >= small:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    if rest:
        out.append(rest)
    return out


def cuts_at_punctuation(tokenizer_json: str) -> bool:
    """Whether the tokenizer lower-cases a word and treats what :data:`_TAIL` finds apart from what is before it."""
    told = json.loads(tokenizer_json)
    normal, before = (told.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps, cuts = normal.get("normalizers", []), before.get("pretokenizers", [])
    return (
        normal.get("type") == before.get("type") == "Sequence" and _LOWER in steps and all(x in ({"type": "NFC"}, _SPACES, _LOWER) for x in steps)
        and len(cuts) == 2 and cuts[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        and cuts[1].get("type") == "ByteLevel" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex", True)
    )


class WordIds:
    """Token ids of texts, word by word: the tokenizer never joins across ASCII white space.

    Where the tokenizer lower-cases and cuts at punctuation, a word is looked up in lower case and the punctuation at its end apart, as
    most words that are new in that they have a capital or a full stop are known without. Words with an added token stay as they are.
    """

    def __init__(self, tokenizer_json: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.apart = cuts_at_punctuation(tokenizer_json)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # Remembered words by number; number 0 is the end of a text, number 1 no word.
        self.known: dict[str, int] = {"": 1}
        self.flat, self.size = np.array([end_id], np.uint32), np.array([1, 0])

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word without the punctuation at its end, and that."""
        if not self.apart:
            return words, pa.nulls(len(words), words.type).fill_null("")
        same = pa.repeat(False, len(words))
        for token in self.added:
            same = pc.or_(same, pc.match_substring(words, token, ignore_case=True))
        lower = pc.if_else(same, words, pc.ascii_lower(words))
        cut = pc.and_(pc.match_substring_regex(lower, _TAIL), pc.invert(same))
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ended = lower.take(pa.array(at))
        bare = pc.replace_substring_regex(ended, _TAIL, r"\1")
        behind = pc.struct_field(pc.extract_regex(ended, _TAIL.replace("([", "(?P<last>[", 1).replace(")([", ")(?P<tail>[", 1)), "tail")
        return pc.replace_with_mask(lower, cut, bare), pc.replace_with_mask(pa.nulls(len(words), words.type).fill_null(""), cut, behind)

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct words, and the ids and sizes by number that they stand for."""
        unique = words.to_pylist()
        known = self.known.get
        number = np.fromiter((known(w, -1) for w in unique), np.int64, len(unique))
        flat, size = self.flat, self.size
        if len(new := np.nonzero(number < 0)[0]):
            fresh = [unique[k] for k in new.tolist()]
            coding = self.tok.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            number[new] = np.arange(len(size), len(size) + len(new))
            flat = np.concatenate([flat, np.array(coding.ids, np.uint32)])
            size = np.concatenate([size, np.bincount(np.array(coding.word_ids, np.int64), minlength=len(new))])
            if len(size) <= CACHE_WORDS:
                self.known.update(zip(fresh, number[new].tolist(), strict=True))
                self.flat, self.size = flat, size
        return number, flat, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and the number of ids of each."""
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy()[1:].astype(np.int64)
        coded = words.flatten().dictionary_encode()
        parts = pa.concat_arrays(self._parts(coded.dictionary)).dictionary_encode()
        number, flat, size = self._numbers(parts.dictionary)
        pair = number[parts.indices.to_numpy()].reshape(2, -1)
        index = np.insert(pair.T[coded.indices.to_numpy()].ravel(), 2 * ends, 0)
        first = np.cumsum(size) - size
        length = size[index]
        stop = np.cumsum(length)
        ids = flat[np.repeat(first[index] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.diff(stop[2 * ends + np.arange(len(ends))], prepend=0)


def _cut(tokenizer, end_id: int, capacity: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or WordIds(tokenizer.value, end_id)
            text = pc.fill_null(batch.column(batch.num_columns - 1), "").cast(pa.large_string())
            weight = np.cumsum(pc.binary_length(text).to_numpy() + 1)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + SLICE_BYTES, "right")))
                ids, sizes = encode(text.slice(at, to - at))
                ids, base = ids.astype("<u4", copy=False), 0
                row, start, length, crc, total = [], [], [], [], []
                for k, n in enumerate(sizes.tolist()):
                    done = 0
                    for piece in cut_lengths(n, capacity):
                        row.append(at + k)
                        start.append(done)
                        length.append(piece)
                        crc.append(zlib.crc32(ids[base + done : base + done + piece]))
                        total.append(n)
                        done += piece
                    base += n
                kept = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=[*names, "start", "length", "ids_crc32", "doc_tokens"])
                at = to

    return run


def _best_fit(capacity: int, schema: pa.Schema):
    def run(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("length", "descending"), ("rank", "ascending")])
        group = group.take(order)
        room: list[tuple[int, int]] = []  # free tokens and bin, sorted
        bins, offsets, n = [], [], 0
        for length in group["length"].to_pylist():
            k = bisect.bisect_left(room, (length, -1))
            if k < len(room):
                free, b = room.pop(k)
            else:
                free, b, n = capacity, n, n + 1
            bins.append(b)
            offsets.append(capacity - free)
            if free > length:
                bisect.insort(room, (free - length, b))
        base = np.asarray(group["bins_before"].to_numpy(), np.int64)
        group = group.drop_columns(["rank", "bins_before"]).append_column("sequence_id", pa.array(base + np.array(bins, np.int64))).append_column("offset", pa.array(offsets, pa.int64()))
        return group.select(schema.names).cast(schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: tuple = ()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``carry``.

    ``tokenizer_json`` is the text of a tokenizer file whose words end at white space. Each document's ids are closed by
    ``end_id``, so that null and empty texts are one piece of one id. Pieces lie in their sequence without gaps from offset 0.
    Documents never merge: repeated rows are packed as often as they come, in the order of id and start among themselves. An
    empty table gives an empty result. Beyond the last sequence, padding is what ``capacity mod j`` leaves in a bin of class j.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = ["doc_id", *carry]
    schema = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    shared = spark.sparkContext.broadcast(tokenizer_json)
    pieces = staged(docs.select(*names, "text").mapInArrow(lean(_cut(shared, end_id, capacity, names)), schema), "pieces")
    chunks = max(1, math.ceil(pieces.count() / CHUNK_ROWS)) * 4
    chunk, rank = fresh_name(pieces, "chunk"), fresh_name(pieces, "rank")
    keyed = pieces.withColumn(chunk, F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    counts = keyed.groupBy("length", chunk).agg(F.count("*").alias("n"))
    along = Window.partitionBy("length").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", chunk, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    # At most CAPACITY classes, 127 for 4096.
    classes = counts.groupBy("length").agg(F.sum("n").alias("pieces")).withColumn("each", F.floor(F.lit(capacity) / F.col("length"))).withColumn("full", F.floor(F.col("pieces") / F.col("each")))
    classes = classes.withColumn("bins_before", F.coalesce(F.sum("full").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    classes = classes.withColumn("all_bins", F.sum("full").over(Window.partitionBy()))
    inside = Window.partitionBy("length", chunk).orderBy("doc_id", "start")
    ranked = keyed.join(starts, ["length", chunk]).withColumn(rank, F.col("before") + F.row_number().over(inside) - 1).join(classes, "length")
    ranked = staged(ranked.select(*schema.names, rank, "each", "full", "bins_before", "all_bins"), "ranked-pieces")
    place = F.col(rank) % F.col("each")
    filled = ranked.filter(F.col(rank) < F.col("full") * F.col("each")).select(
        *schema.names, (F.col("bins_before") + F.floor(F.col(rank) / F.col("each"))).alias("sequence_id"), (place * F.col("length")).alias("offset")
    )
    left = ranked.filter(F.col(rank) >= F.col("full") * F.col("each")).select(*schema.names, F.col(rank).alias("rank"), F.col("all_bins").alias("bins_before"))
    from pyspark.sql.pandas.types import to_arrow_schema

    return filled.unionByName(left.groupBy().applyInArrow(_best_fit(capacity, to_arrow_schema(filled.schema)), filled.schema))
