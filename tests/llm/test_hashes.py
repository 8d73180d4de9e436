"""Sequences that sums modulo a power of two can't tell apart: Thue and Morse's, and its complement."""

import hashlib
import random

import numpy as np

from tidewright.llm import jaccard_join, line_dedup, shingles, suffix_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int, zero: str, one: str) -> tuple[list[str], list[str]]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(zero, one)[b] for b in bits], [(one, zero)[b] for b in bits]


def test_lines_that_differ_in_every_word_stay(spark):
    for n in (1024, 4096):
        a, b = thue_morse(n, "0", "1")
        got = line_dedup.line_report(spark.createDataFrame([(1, " ".join(a), None, None, None), (2, " ".join(b), None, None, None)], DOC)).collect()
        assert [r["n_dropped"] for r in got] == [0, 0]


def test_texts_without_a_common_shingle_are_not_linked(spark):
    a, b = thue_morse(1024, "0", "1")
    rows = [(1, "".join(a) + " x y", None, None, None), (2, "".join(b) + " x y", None, None, None), (3, " ".join(a), None, None, None), (4, " ".join(b), None, None, None)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows[:2], DOC), width=3, percent=90).collect()}
    assert got == {1: 1, 2: 2}


def test_words_sequences_and_pieces_differ():
    a, b = thue_morse(4096, "0", "1")
    h, *_ = shingles.word_hashes([" ".join(["".join(a), "".join(b)]).encode()])
    assert h[0] != h[1]
    for which in (0, 1):
        x, y = (shingles.Sequences(shingles.word_hashes([" ".join(t).encode()])[0], which) for t in (a, b))
        for n in (1024, 2048, 4096):
            one = (np.zeros(1, np.int64), np.full(1, n), np.full(1, n, np.uint64))
            assert x.of(*one)[0] != y.of(*one)[0]


def test_word_hashes_are_of_their_bytes():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in list(range(1, 80)) * 5 + [200, 5000]]
    h, start, end, first = shingles.word_hashes([" ".join(words).encode(), b"", b"  AB ab\tzz"])
    by = {}
    for w, x in zip([*words, "ab", "ab", "zz"], h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by) and first.tolist() == [0, len(words), len(words), len(words) + 3]
    assert shingles.word_hashes([b"AB ab"], lower=False)[0][0] != shingles.word_hashes([b"AB ab"], lower=False)[0][1]


def test_sequences_by_definition():
    words = shingles.word_hashes([" ".join(f"w{i % 7}" for i in range(60)).encode()])[0]
    s = shingles.Sequences(words)
    key = lambda part, tag: int(shingles.Sequences(np.array(part, np.uint64)).of(np.zeros(1, np.int64), np.full(1, len(part)), np.full(1, tag, np.uint64))[0])
    for a, b in ((0, 60), (3, 10), (10, 17), (59, 60), (7, 7)):
        assert int(s.of(np.array([a]), np.array([b]), np.array([5], np.uint64))[0]) == key(words[a:b].tolist(), 5)
    assert [int(x) for x in s.without_each(np.full(1, 59, np.uint64))] == [key([*words[:i], *words[i + 1 :]], 59) for i in range(60)]


def test_pieces_of_equal_bytes_are_equal_and_of_others_not():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    texts = [("".join(rng.choice("ghij ") for _ in range(k)) + passage + "zz" * k).encode() for k in (0, 33, 160)]
    seen = {}
    for t in texts:
        for anchor, piece, start, n, _ in suffix_dedup.pieces_of(t):
            for a, p, s, m in zip(anchor.tolist(), piece.tolist(), start.tolist(), n.tolist(), strict=True):
                whole = hashlib.sha1(t[s : s + m + suffix_dedup.WINDOW - 1]).digest()
                assert seen.setdefault((a, p), whole) == whole
    assert len({p for _, p in seen}) == len(set(seen.values()))
