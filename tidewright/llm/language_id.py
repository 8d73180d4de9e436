"""Language identification by interpolated Kneser-Ney models of characters.

One model per language, all over the same n-grams: for each order a sorted array of 64-bit
hashes and beside it a row of log-probabilities, one per language; a directory of the leading
bits makes a look-up one or two probes. An n-gram that no language has seen falls back to the
next lower order with each language's back-off weight for the context. The language with the
lowest cross-entropy per character wins; on training documents that were left out of the counts
a temperature turns cross-entropies into a score between 0 and 1, and a limit per language is
set beyond which a text is rejected as none of the languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, staged

ORDER = 4
#: The training sample: documents of each language (those with the smallest hashed ids), and the characters counted of them.
SAMPLE_DOCS, SAMPLE_CHARS = 500, 2_000_000
#: Characters counted of all languages together: with many languages, each has its share.
SAMPLE_TOTAL = 64_000_000
#: A table of up to so many languages is sent to the executors.
MANY = 10_000
#: One in so many sampled documents calibrates score and rejection instead of being counted.
CALIBRATION = 5
#: A text is rejected above the largest calibrated cross-entropy of its language times this.
MARGIN = 1.5
#: Short texts get more room: the limit of n characters is 1 + SHORT / n times that.
SHORT = 20
#: Characters scored at a time.
SLICE = 1 << 19
UNKNOWN = "und"

_SEEDS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(16)], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each BMP code point, whether it is a letter or a mark; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)), bool, 0x10000))
    return _LETTERS[0]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts, every run of other characters as one 0, and the start of each text; each begins with a 0."""
    low = [t.lower() for t in texts]
    joined = " " + " ".join(low)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    keep = table[np.minimum(raw, 0xFFFF)]
    for c in np.unique(raw[raw > 0xFFFF]):
        keep[raw == c] = chr(c).isalpha()
    codes = np.where(keep, raw, 0)
    starts = np.cumsum(np.array([0, *(len(t) + 1 for t in low)], np.int64))[:-1]
    solid = np.ones(len(codes), bool)
    solid[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    solid[starts] = True
    return codes[solid].astype(np.uint64) + np.uint64(1), (np.cumsum(solid) - 1)[starts]


def _mixed(acc: np.ndarray) -> np.ndarray:
    acc = (acc ^ (acc >> np.uint64(31))) * _MIX
    return acc ^ (acc >> np.uint64(29))


def gram_sums(codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, unmixed hashes of the n-grams that end at every character; and which characters are not a text's first.

    What lies before a text counts as blanks, so a text's n-grams don't depend on its neighbours.
    """
    index = np.arange(len(codes))
    place = index - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    acc, sums = codes * _SEEDS[0], []
    sums.append(acc)
    for s in range(1, order):
        shifted = np.ones(len(codes), np.uint64)
        shifted[s:] = codes[:-s]
        shifted[place < s] = 1
        acc = acc + shifted * _SEEDS[s]
        sums.append(acc)
    return sums, place > 0


class HashTable:
    """Sorted hashes with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        bits = max(1, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.where((at < end) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys), at, -1)
        todo = np.nonzero((out < 0) & (at + 1 < end))[0]
        step = 1
        while len(todo):
            where = at[todo] + step
            hit = self.keys[where] == keys[todo]
            out[todo[hit]] = where[hit]
            step += 1
            todo = todo[~hit & (where + 1 < end[todo])]
        return out


def count_grams(texts: list[str], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order, of each n-gram (n codes, last character first) the number of times it was seen; lower orders count distinct left neighbours."""
    codes, starts = codes_of(texts)
    index = np.arange(len(codes))
    place = index - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    grams = np.ones((len(codes), order), np.uint32)
    for s in range(order):
        grams[s:, s] = codes[: len(codes) - s]
        grams[place < s, s] = 1
    grams = grams[place > 0]
    rows, counts = np.unique(grams, axis=0, return_counts=True) if len(grams) else (grams, np.zeros(0, np.int64))
    out = [(rows, counts)]
    for k in range(order - 1, 0, -1):
        rows, counts = np.unique(out[-1][0][:, :k], axis=0, return_counts=True) if len(grams) else (rows[:, :k], counts)
        out.append((rows, counts))
    return out[::-1]


def _sums(rows: np.ndarray, context: bool = False) -> np.ndarray:
    """Unmixed hashes of n-grams, or of their contexts (all but the last character)."""
    acc = np.zeros(len(rows), np.uint64)
    for s in range(int(context), rows.shape[1]):
        acc += rows[:, s].astype(np.uint64) * _SEEDS[s]
    return acc


class CharModel:
    """All languages' models; ``languages`` in code point order."""

    def __init__(self, counted: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(counted), order
        n = len(self.languages)
        self.grams: list[tuple[HashTable, np.ndarray]] = []
        self.contexts: list[tuple[HashTable, np.ndarray]] = []
        letters = {int(c) for rows in counted.values() for c in rows[0][0][:, 0]}
        self.floor = np.float32(-np.log(len(letters) + 1))
        lower_table, lower_logp = None, None
        for k in range(order):
            keys = [_mixed(_sums(counted[x][k][0])) for x in self.languages]
            heads = [_mixed(_sums(counted[x][k][0], context=True)) for x in self.languages]
            table, head_table = HashTable(np.unique(np.concatenate(keys))), HashTable(np.unique(np.concatenate(heads)))
            some = np.zeros((len(table.keys), k + 1), np.uint32)
            for x, key in zip(self.languages, keys, strict=True):
                some[table.find(key)] = counted[x][k][0]
            head_of = head_table.find(_mixed(_sums(some, context=True)))
            below = np.exp(lower_logp[lower_table.find(_mixed(_sums(some[:, :k])))]) if k else np.full((len(some), n), np.exp(self.floor))
            prob, back = np.zeros((len(some), n)), np.ones((len(head_table.keys), n))
            for j, x in enumerate(self.languages):
                counts = counted[x][k][1].astype(float)
                once, twice = (counts == 1).sum(), (counts == 2).sum()
                discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
                head = head_table.find(heads[j])
                total, kinds = np.bincount(head, counts, len(back)), np.bincount(head, minlength=len(back))
                seen = total > 0
                back[seen, j] = discount * kinds[seen] / total[seen]
                prob[table.find(keys[j]), j] = np.maximum(counts - discount, 0) / total[head]
            logp = np.log(prob + back[head_of] * below).astype(np.float32)
            self.grams.append((table, logp))
            self.contexts.append((head_table, np.log(back).astype(np.float32)))
            lower_table, lower_logp = table, logp
        self.temperature, self.limits = 1.0, np.full(n, np.inf)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text in each language, and the number of characters scored (0: the text has no letter)."""
        codes, starts = codes_of(texts)
        sums, scored = gram_sums(codes, starts, self.order)
        logp = np.zeros((len(codes), len(self.languages)), np.float32)
        rest = np.nonzero(scored)[0]
        for k in range(self.order - 1, -1, -1):
            acc = sums[k][rest]
            table, values = self.grams[k]
            at = table.find(_mixed(acc))
            hit = at >= 0
            logp[rest[hit]] += values[at[hit]]
            rest, acc = rest[~hit], acc[~hit]
            if not len(rest):
                break
            heads, weights = self.contexts[k]
            head = heads.find(_mixed(acc - codes[rest] * _SEEDS[0]))
            known = head >= 0
            logp[rest[known]] += weights[head[known]]
        logp[rest] += self.floor
        n = np.add.reduceat(scored.astype(np.int64), starts)
        letters = np.add.reduceat((codes > 1).astype(np.int64), starts)
        return -np.add.reduceat(logp.astype(np.float64), starts, axis=0) / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        """Share of the best language; of the others, by how far they are behind."""
        behind = entropy - entropy.min(axis=1, keepdims=True)
        return 1.0 / np.exp(-behind / self.temperature).sum(axis=1)

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        entropy, n = self.cross_entropies(texts) if texts else (np.zeros((0, len(self.languages))), np.zeros(0))
        truth = np.array([self.languages.index(x) for x in languages], int)
        use = n > 0
        entropy, truth = entropy[use], truth[use]
        if not len(truth):
            return
        behind = entropy - entropy.min(axis=1, keepdims=True)

        def loss(t: float) -> float:
            shares = np.exp(-behind / t)
            return -np.log(np.maximum(shares[np.arange(len(truth)), truth] / shares.sum(axis=1), 1e-12)).mean()

        self.temperature = min(np.geomspace(0.02, 2.0, 25), key=loss)
        for j in range(len(self.languages)):
            if (own := entropy[truth == j, j]).size:
                self.limits[j] = MARGIN * own.max()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> CharModel | None:
    """Fit on a bounded sample of the labelled rows that are not held out; None if there are none.

    The sample holds at most ``sample_docs`` documents of each language, those with the smallest hashed ids, whole, until
    ``sample_chars`` characters are reached, or the language's share of ``SAMPLE_TOTAL``. Only their n-gram counts come to the
    driver, whose size that bounds. An empty table, or one without labels, has no model.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = staged(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    # Its size is checked; beyond that, rows are shuffled by language instead.
    kinds = share.count()
    sample_chars = min(sample_chars, max(1, SAMPLE_TOTAL // max(kinds, 1)))
    share = F.broadcast(share) if kinds <= MANY else share
    near = rows.join(share, "lang").select("lang", "text", spread.alias("at"), "rows").filter(F.col("at") * F.col("rows") <= F.lit(2.0 * sample_docs) * (1 << 30))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("text", "ascending")]).slice(0, sample_docs)
        lang = group["lang"][0].as_py()
        texts = group["text"].to_pylist()
        fit, held, size = [], [], 0
        for k, t in enumerate(texts):
            if size >= sample_chars:
                break
            size += len(t)
            (held if k % CALIBRATION == CALIBRATION - 1 else fit).append(t)
        out = {"lang": [], "k": [], "grams": [], "counts": [], "held": []}
        for k, (grams, counts) in enumerate(count_grams(fit, order)):
            for key, value in (("lang", lang), ("k", k), ("grams", grams.astype("<u4").tobytes()), ("counts", counts.astype("<i8").tobytes()), ("held", held if k == 0 else [])):
                out[key].append(value)
        return pa.Table.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("k", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("held", pa.list_(pa.string()))]))

    # A group is a sample: about twice sample_docs rows of one language.
    counted = near.groupBy("lang").applyInArrow(run, "lang string, k int, grams binary, counts binary, held array<string>").toArrow().to_pylist()
    by: dict[str, list] = {}
    texts, labels = [], []
    for r in sorted(counted, key=lambda r: (r["lang"], r["k"])):
        by.setdefault(r["lang"], []).append((np.frombuffer(r["grams"], "<u4").reshape(-1, r["k"] + 1), np.frombuffer(r["counts"], "<i8")))
        texts += r["held"]
        labels += [r["lang"]] * len(r["held"])
    by = {x: t for x, t in by.items() if len(t[0][0])}
    if not by:
        return None
    model = CharModel(by, order)
    pairs = [(t, x) for t, x in zip(texts, labels, strict=True) if x in by]
    model.calibrate([t for t, _ in pairs], [x for _, x in pairs])
    return model


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLICE or k == len(texts) - 1:
            yield at, [x or "" for x in texts[at : k + 1]]
            at, size = k + 1, 0


def predict(docs: DataFrame, model: CharModel | None, names: tuple[str, str, str, str] = ("lang_pred", "score", "cross_entropy", "accepted")) -> DataFrame:
    """Adds the predicted language, its score, its cross-entropy per character and whether it is accepted, to all columns.

    Null texts and texts without a letter are ``und`` with score 0, not accepted, and so is everything if there is no model.
    Columns of those names are replaced. Rows are scored whole, one by one, whatever their neighbours; ties go to the language
    that comes first.
    """
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cloudpickle.loads(shared.value)
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            lang, score, entropy, good = [], [], [], []
            for _, part in _slices(texts):
                if m is None:
                    best, share, low, n = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part))
                else:
                    h, n = m.cross_entropies(part)
                    best = h.argmin(axis=1)
                    share, low = m.scores(h), h.min(axis=1)
                for b, s, e, k in zip(best, share, low, n, strict=True):
                    lang.append(m.languages[b] if k else UNKNOWN)
                    score.append(float(s) if k else 0.0)
                    entropy.append(float(e) if k else None)
                    good.append(bool(k and e <= m.limits[b] * (1 + SHORT / k)))
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *new], names=[*columns, *names])

    return docs.select(*[docs[c] for c in columns], docs["text"].alias("__text")).mapInArrow(lean(run), schema)
