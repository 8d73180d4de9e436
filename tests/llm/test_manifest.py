"""Merkle manifest, winnowing fingerprints and whitening against brute force, and with nulls, empty tables, repeated rows and clashing names."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidewright.llm import fingerprints, merkle, ordering, queries, whitening

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- places in an order ----------------------------------------------------------------------------------------------------


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b", "b", "z", "é"]), rng.choice([None, *range(40)]), i) for i in range(500)]
    got = ordering.numbered(spark.createDataFrame(rows, "g string, k long, row long").repartition(7), ["g"], ["k", "row"]).collect()
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [r[2] for r in order] == [r["row"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["idx"])]
    assert all(r["group_idx"] == groups.index(r["g"]) and r["n"] == sum(x[0] == r["g"] for x in rows) for r in got) and len(got) == len(rows)


def test_numbered_without_group_and_empty(spark):
    assert [r["idx"] for r in ordering.numbered(spark.range(50).toDF("k"), [], ["k"]).orderBy("k").collect()] == list(range(50))
    assert ordering.numbered(spark.range(0).toDF("k"), [], ["k"]).count() == 0


# ---- 11 --------------------------------------------------------------------------------------------------------------------


def manifest(rows: list[tuple]) -> dict:
    """Row number -> (leaf, subroot, root, proof, folded root, verified), by definition."""

    def leaf(doc_id, text, lang, source, n_chars):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def climb(hashes):
        """Levels of one tree from the leaves to the top."""
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            a = i // 16 * 16
            yield level[a:i], level[i + 1 : a + 16]
            i //= 16

    trees = {}
    for source in sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        trees[source] = sorted((i for i, r in enumerate(rows) if r[3] == source), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(*rows[i])))
    grown = {s: climb([leaf(*rows[i]) for i in order]) for s, order in trees.items()}
    over = climb([grown[s][-1][0] for s in trees])
    out = {}
    for place, (source, order) in enumerate(trees.items()):
        for k, i in enumerate(order):
            path = [*siblings(grown[source], k), *siblings(over, place)]
            doc_id, text, lang, _, n_chars = rows[i]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            fold = leaf(doc_id, text, lang, source, n_chars)
            for left, right in path:
                fold = h("".join([*left, fold, *right]))
            out[i] = (leaf(*rows[i]), grown[source][-1][0], over[-1][0], h("".join("".join([*a, *b]) for a, b in path)), fold, fold == over[-1][0])
    return out


FIELDS = "leaf subroot root proof_sha256 folded_root verified".split()


@pytest.mark.parametrize("sources", [["one"], ["a", None, "b", "Ü", ""], [f"s{i % 40}" for i in range(70)] + [None]])
def test_manifest_by_definition(spark, sources):
    rng = random.Random(len(sources))
    rows = [(i, rng.choice(["Some Text", "lower only", "", None, "Ünï ÀB " * 30, f"Text {i}"]), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 7])) for i in range(700)]
    rows += [(10_000 + i, "AB", None, f"lone{i}", 1) for i in range(3)] + [(None, "Null Id", "en", sources[0], 1), (None, None, None, sources[0], None), (5, "Twice", None, sources[0], None)]
    want = sorted((rows[i][0] is not None, rows[i][0] or 0, *v) for i, v in manifest(rows).items())
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOC + ", TEXT string, Leaf string").repartition(5)
    got = merkle.merkle_manifest(df, merkle.tampered_leaf()).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[f] for f in FIELDS)) for r in got) == want
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_levels_of_one_tree(spark):
    """Sizes at and around powers of the fan, and a lone document."""
    for n in (1, 2, 16, 17, 256, 257):
        rows = [(i, f"D{i}", None, "s", None) for i in range(n)]
        got = merkle.merkle_manifest(spark.createDataFrame(rows, DOC)).collect()
        want = manifest(rows)
        assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got} == {i: v[:4] for i, v in want.items()}
        assert all(r["verified"] for r in got)


def test_manifest_repeated_rows_and_none(spark):
    rows = [(1, "A", "en", "s", 1)] * 40 + [(None, None, None, None, None)] * 3
    got = merkle.merkle_manifest(spark.createDataFrame(rows, DOC), merkle.tampered_leaf()).collect()
    want = manifest(rows)
    assert sorted(tuple(r[f] for f in FIELDS) for r in got) == sorted(want.values())
    assert merkle.merkle_manifest(spark.createDataFrame([], DOC)).count() == 0


def test_manifest_query_and_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLES["op11_merkle_manifest"]).df()
    got = queries.op11_merkle_manifest(spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


# ---- 12 --------------------------------------------------------------------------------------------------------------------


def chosen_by_definition(text: str, gram: int, window: int) -> list[tuple[int, int]]:
    if not text:
        return []
    gram = min(gram, len(text))
    codes = fingerprints.code_points(text)
    hashes = [int(fingerprints.gram_hashes(codes[i : i + gram], gram)[0]) for i in range(len(text) - gram + 1)]
    window = min(window, len(hashes))
    out = set()
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        out.add(i + max(j for j, x in enumerate(part) if x == min(part)))
    return [(i, hashes[i]) for i in sorted(out)]


def texts(rng, n):
    kinds = ["ab", "abcdefgh ", "äö漢字🙂x "]
    return ["".join(rng.choice(kinds[i % 3]) for _ in range(rng.choice([0, 1, 2, 15, 16, 17, 40, 62, 63, 64, 65, 200, 500]))) for i in range(n)] + ["a" * 300, "ab" * 200, "abc " * 90]


def test_winnowing_by_definition():
    rng = random.Random(1)
    for t in texts(rng, 60):
        for gram, window in ((16, 48), (5, 4), (3, 1), (1, 7)):
            place, hash_ = fingerprints.winnow(fingerprints.code_points(t), gram, window)
            assert list(zip(place.tolist(), hash_.tolist(), strict=True)) == chosen_by_definition(t, gram, window)


def test_gram_hash_is_its_polynomial():
    """Rolled sums equal the sum of powers modulo the primes; equal grams have equal hashes wherever they stand."""
    text = "the same words, and then the same words again"
    codes = fingerprints.code_points(text)
    got = fingerprints.gram_hashes(codes, 9)
    for i in range(len(text) - 8):
        lanes = [sum((ord(c) + 1) * pow(b, j, m) for j, c in enumerate(text[i : i + 9])) % m for m, b in fingerprints._MODULI]
        assert int(got[i]) == int(fingerprints.mixed(np.array([lanes[0] << 32 | lanes[1]], np.uint64))[0])
    grams = {}
    for i in range(len(text) - 8):
        grams.setdefault(text[i : i + 9], set()).add(int(got[i]))
    assert all(len(v) == 1 for v in grams.values()) and len(set(got.tolist())) == len(grams)


def test_long_text_in_slices(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    want = fingerprints.winnow(fingerprints.code_points(text))
    monkeypatch.setattr(fingerprints, "SLICE", 777)
    got = fingerprints.winnow(fingerprints.code_points(text))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))


def test_shared_passage_is_found():
    """Any passage of gram + window - 1 code points gives a common hash at matching positions."""
    rng = random.Random(4)
    for _ in range(200):
        passage = "".join(rng.choice("abcdef ") for _ in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
        a, b = ("".join(rng.choice("ghijkl ") for _ in range(rng.randrange(120))) + passage + "".join(rng.choice("mnop ") for _ in range(rng.randrange(120))) for _ in range(2))
        pa_, ha = fingerprints.winnow(fingerprints.code_points(a))
        pb, hb = fingerprints.winnow(fingerprints.code_points(b))
        at = {(int(x), int(p) - a.index(passage)) for p, x in zip(pa_, ha, strict=True)} & {(int(x), int(p) - b.index(passage)) for p, x in zip(pb, hb, strict=True)}
        assert at


def test_rewinnow_equals_winnow():
    rng = random.Random(6)
    for t in texts(rng, 200):
        same = len(t) - len(t) // 4 if rng.random() < 0.5 else rng.randrange(len(t) + 1)
        new = t[:same] + "".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 20, 100])))
        codes = fingerprints.code_points(new)
        got = fingerprints.rewinnow(codes, fingerprints.winnow(fingerprints.code_points(t)), same)
        assert all(np.array_equal(a, b) for a, b in zip(got, fingerprints.winnow(codes), strict=True))


def test_fingerprint_text_comes_back():
    place, hash_ = fingerprints.winnow(fingerprints.code_points("some text that is long enough to have several windows of grams, as most texts are " * 4))
    again = fingerprints.unpacked(fingerprints.packed(place, hash_))
    assert np.array_equal(again[0], place) and np.array_equal(again[1], hash_) and len(place) > 3


def edits(rows: list[tuple]) -> list[tuple]:
    """Rows by definition; those of one id and text can't be told apart."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        sets = [{x for _, x in chosen_by_definition(t, fingerprints.GRAM, fingerprints.WINDOW)} for t in (text, edited, after)]
        like = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        prints = [fingerprints.packed(*(np.array(x, np.uint64) for x in zip(*c, strict=True))) if (c := chosen_by_definition(t, fingerprints.GRAM, fingerprints.WINDOW)) else "" for t in (text, edited)]
        out.append((doc_id, len(text), h(edited), *prints, *like))
    return out


@pytest.mark.parametrize("n, parts", [(1, 3), (2, 4), (150, 1), (150, 6)])
def test_edits_by_definition(spark, n, parts):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(texts(rng, 20))) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(i, t if t or i % 2 else None, "x") for i, t in rows], "doc_id long, text string, TEXT string").repartition(4)
        got = sorted(map(tuple, fingerprints.fingerprint_edits(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == edits(rows)


def test_edits_repeated_null_and_none(spark):
    rows = [(None, "null id, long enough to have a gram"), (1, "x" * 100), (1, "x" * 100), (1, "x" * 100), (2, "")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((v is not None, v) if not isinstance(v, bool) else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(edits(rows), key=key)
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_of_a_long_text_and_equal_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200_000))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame([(1, long), (2, "short"), (3, long)], "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[3]["fingerprint"] and got[3]["near_next"] == 1.0 and got[1]["near_next"] == 0.0
    assert got[3]["edited_sha256"] == h(long[:150_000] + long[:50_000])
    assert 0.5 < got[1]["near_edited"] <= 0.8
    assert np.array_equal(fingerprints.unpacked(got[1]["fingerprint"])[0], fingerprints.winnow(fingerprints.code_points(long))[0])
    assert len(base64.b64decode(got[1]["fingerprint"])) % 9 == 0


# ---- 13 --------------------------------------------------------------------------------------------------------------------

EMB = "vec_id long, embedding array<float>, label int"


def check_whitening(got, vectors, k=16):
    """Against eigenvectors of the covariance of distinct whole vectors. ``vectors``: id -> vector that counts."""
    whole = {i: tuple(int(math.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v) for i, v in vectors.items()}
    fit = sorted(set(whole.values()))
    n, x = len(fit), np.array(fit)
    total = [sum(col) for col in zip(*fit, strict=True)]
    c = np.array([[(n * v - t) / n for v, t in zip(row, total, strict=True)] for row in fit])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-10 * e[0]).sum()))
    assert len(got) == k * len(vectors)
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["deviation"] == sum((n * a - t) ** 2 for a, t in zip(whole[r["vec_id"]], total, strict=True))
        assert r["identity_error"] < 1e-9 and abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-10
    assert sorted(by) == list(range(1, k + 1))
    gaps = np.diff(e)
    for j, rows in by.items():
        apart = min(abs(gaps[j - 2]) if j > 1 else np.inf, abs(gaps[j - 1]) if j < len(e) else np.inf)
        if apart < 1e-3 * e[0]:  # near a double eigenvalue any rotation will do
            continue
        want = {i: float((np.array([(n * a - t) / n for a, t in zip(w, total, strict=True)])) @ v[:, j - 1] / math.sqrt(e[j - 1])) for i, w in whole.items()}
        sign = np.sign(sum(r["whitened"] * want[r["vec_id"]] for r in rows))
        assert max(abs(sign * r["whitened"] - want[r["vec_id"]]) for r in rows) < 1e-9
    return x


@pytest.mark.parametrize("d, n", [(1, 10), (3, 50), (24, 300), (40, 30)])
def test_whitening_by_definition(spark, d, n):
    rng = np.random.default_rng(d)
    scale = 2.0 ** -np.arange(d).clip(max=6)
    vectors = {i: (rng.standard_normal(d) * 3 * scale).astype(np.float32).tolist() for i in range(n)}
    vectors[n], vectors[n + 1] = vectors[0], vectors[0]
    rows = [(i, v, None) for i, v in vectors.items()]
    rows += [(-1, None, 1), (-2, [float("nan")] * d, 1), (-3, [float("inf"), *[0.0] * (d - 1)], 1), (-4, [None, *[0.0] * (d - 1)], 1), (-5, [], 1), (-6, [0.5] * (d + 1), 1), (-7, [1e30] * d, 1)]
    df = spark.createDataFrame([(*r, [1.0]) for r in rows], EMB + ", EMBEDDING array<float>").repartition(4)
    check_whitening(whitening.whiten(df).collect(), vectors)


def test_whitening_nothing_varies(spark):
    for rows in ([], [(1, [0.5, 0.25], 0)] * 5, [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, EMB)).count() == 0


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = queries.op13_embedding_whitening(spark, SF).collect()
    check_whitening(got, {r["vec_id"]: r["embedding"] for r in rows})


def test_whole_vectors_are_packed_exactly():
    for x in ([0], [-128, 127], [128, 0], [-40_000, 1], [2**40, -(2**45)]):
        a = np.array(x, np.int64)
        assert whitening.from_code(whitening.to_code(a)).tolist() == x
    assert whitening.to_code(np.array([1, 2])) != whitening.to_code(np.array([1, 2, 0]))


def test_exact_centre_beyond_64_bits():
    n, total = 3_000_000_019, [17, -(2**52) + 1, 5 * 10**18]
    centre = whitening.Centre(n, total)
    x = np.array([[2**45, -(2**45), 0], [1, 2, 3]], np.int64)
    want = [[n * int(v) - t for v, t in zip(row, total, strict=True)] for row in x]
    assert [[int(v) for v in row] for row in centre.scaled(x)] == want
    assert centre.deviations(x) == [sum(v * v for v in row) for row in want]
    assert np.allclose(centre.centred(x), [[v / n for v in row] for row in want], rtol=1e-15)


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 100, 200),  # no gaps to speak of
        np.r_[np.full(40, 5.0), np.linspace(0, 1, 160)],  # a multiple eigenvalue, more of it than a block has columns
        np.r_[100.0, 1.0, np.zeros(198)],  # the block breaks down at once
        1.5 ** -np.arange(300.0),
        np.ones(30),
    ],
)
def test_block_lanczos(values):
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = turn * values @ turn.T
    theta, vectors, residual, passes, _ = whitening.block_lanczos(lambda b: matrix @ b, len(values), block=8, basis=64)
    want = np.sort(values)[::-1][:16]
    assert np.abs(theta - want).max() < 1e-12 * want[0]
    assert np.abs(matrix @ vectors - vectors * theta).max() < 1e-12 * want[0] and residual < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert passes <= whitening.STEPS


def test_edited_query_on_the_table(spark):
    got = queries.op12_winnowing_fingerprints(spark, SF).orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for k in range(0, len(rows), 17):
        text, after = rows[k][1], rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        assert got[k]["edited_sha256"] == h(text[: len(text) - q] + after[:q]) and got[k]["n_chars"] == len(text)
        assert fingerprints.unpacked(got[k]["fingerprint"])[0].tolist() == [p for p, _ in chosen_by_definition(text, fingerprints.GRAM, fingerprints.WINDOW)]
