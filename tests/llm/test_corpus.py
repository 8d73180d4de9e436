"""Corpus operators on small tables: against brute force, and with nulls, empty tables, repeated rows and clashing names."""

import hashlib
import json
import math
import random
import re
import string
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import shingles as shingle_hashes
from tidewright.llm import components, embedding_dedup, html_text, induced_sort, jaccard_join, language_id, line_dedup, mixing, packing, queries, shingles, stream_dedup, suffix_dedup, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, short, empty and null texts, one long text."""
    rng = random.Random(5)
    texts = ["\n".join(words(rng, rng.randrange(6, 40), 5000) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    passage = words(rng, 80, 5000)
    texts += [t for t in texts[:10]]
    for t in texts[10:20]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [words(rng, 30, 5000) + "\n" + passage + "\n" + words(rng, 30, 5000) for _ in range(5)]
    texts += ["", None, "  \n\t", "one", "one two", "One  TWO", "a b c", words(rng, 4000, 5000), "ab" * 300, "ünïcödé " * 60]
    return [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, an extra column whose name clashes with the operators' own."""
    rows = [(1, "one two three four five six", "en", "s", 1, "x"), (1, "one two three four five six", "en", "s", 1, "x"), (None, None, None, None, None, "y"), (None, "seven eight nine ten eleven", "fr", None, None, "z"), (2, "", "en", "s", 0, None)]
    return spark.createDataFrame(rows, DOC + ", block string")


# ---- 1 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just  text\n here", "just text here"),
        ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>menu</a></nav><header>site</header><article><h1>Head &amp; line</h1><p>One\n two<p>Three<br>four</article><aside>side</aside><footer>foot</footer></body>", "Head & line\nOne two\nThree four"),
        ("<body><div class='cookie-notice'>We use cookies on this site for many reasons.</div><div id='content'><p>The first long paragraph of the text, with words.</p><p>The second long paragraph of the text, with words.</p></div><div id='comments'><p>A comment of a reader that is not short at all, really.</p></div></body>", "The first long paragraph of the text, with words.\nThe second long paragraph of the text, with words."),
        ("<article>a<script>if (a < b) {}</script>b<form>c<input></form><!-- d > --></article>", "ab"),
        ("<article><p title=\"x > y\">q &lt;b&gt; &nbsp; &#233;</p><ul><li>i<li>j</ul><table><tr><td>1<td>2</table></article>", "q <b> é\ni\nj\n1\n2"),
        ("<nav>only a menu</nav>", ""),
        ("<article><p>unclosed", "unclosed"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PROSE = "The long prose of the text goes on and on, with many words in it. " * 6


@pytest.mark.parametrize(
    "page, text",
    [
        # Names that only contain a word of furniture, or that stand on wrappers.
        (f"<body><div class='social-history'><p>{PROSE}</p></div></body>", PROSE.strip()),
        (f"<body class='has-nav'><div class='content sidebar-right'><article><p>{PROSE}</p><p>short</p></article></div><div class='sidebar-box'>Some side things</div></body>", f"{PROSE.strip()}\nshort"),
        (f"<body><div class='ad'>Buy now this thing that is good.</div><article><h1>Hi.</h1></article></body>", "Hi."),
        # No article: density and threshold decide.
        (f"<body><div id=wrap><h1>Title of it</h1><div class=text><p>{PROSE}</p><p>{PROSE}</p></div></div><div class='x'><a href=1>one</a> <a href=2>two</a></div></body>", f"Title of it\n{PROSE.strip()}\n{PROSE.strip()}"),
        (f"<body><div class='ad'>Buy now this thing.</div><div id=main-content><h1>Head</h1><p>{PROSE}</p><p>ok</p></div><div class='related'><p>See also</p><a href=3>this</a></div></body>", f"Head\n{PROSE.strip()}\nok"),
        # An article that is only a card beside the text.
        (f"<body><article><a href=1>A card</a></article><div><p>{PROSE}</p><p>{PROSE}</p></div></body>", f"{PROSE.strip()}\n{PROSE.strip()}"),
        # Reader comments: by another name, without a telling name, under a heading.
        (f"<article><h1>T</h1><p>{PROSE}</p><div class='response-list'><p>Nice text, I like it very much.</p></div></article>", f"T\n{PROSE.strip()}"),
        (f"<article><h1>T</h1><p>{PROSE}</p><div class='xyz'><div class='r'><span class='author'>Bob</span><p>Nice text, I like it.</p></div><div class='r'><span class='author'>Al</span><p>Me too.</p></div></div></article>", f"T\n{PROSE.strip()}"),
        (f"<article><h1>T</h1><p>{PROSE}</p><section><h3>3 Comments</h3><p>Nice text, I like it very much.</p><p>other</p></section><p>z</p></article>", f"T\n{PROSE.strip()}\nz"),
        (f"<body><div id=c><h1>Head</h1><p>{PROSE}</p><h2>Comments</h2><ol><li>I say</li></ol></div></body>", f"Head\n{PROSE.strip()}"),
    ],
)
def test_main_text_evidence(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part, n", [("<b>", 150_000), ("<a ", 300_000), ("<!", 400_000), ("<i><div>", 100_000), ("<li>", 150_000), ("<table><tr><td>", 60_000), ('<a x="', 150_000), ("<h2>Comments</h2>", 50_000), ("<div class=r><i class=by></i>", 30_000)])
def test_main_text_is_linear(part, n):
    """Pages of about a megabyte of unclosed or hostile tags."""
    import time

    began = time.process_time()
    html_text.main_text(part * n + "</i>" * n)
    assert time.process_time() - began < 20


def brute_template(page):
    """Main text of the pages of the tables, by their template: what stands in their one article, block by block."""
    import html
    import re

    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", re.sub(r"<(script|style)>.*?</\1>|<!--.*?-->", "", page, flags=re.S), re.S)[1]
    blocks = re.split(r"</?(?:h1|p|ul|ol|li|div|table|tr|td|blockquote|h2|h3|pre)\b[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_main_text_of_every_page(spark):
    got = queries.op1_html_main_text(spark, SF).toPandas()
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    assert [r.page_id for r in got.itertuples() if r.text != brute_template(pages.html[r.page_id])] == []


def test_extraction_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "mine"), (1, "u", "<p>x</p>", "mine"), (2, None, None, None)], "page_id long, url string, html string, text2 string")
    out = html_text.extract_main_text(pages)
    assert out.columns == ["page_id", "url", "text2", "text", "n_chars"] and sorted((r.page_id, r.text, r.n_chars) for r in out.collect()) == [(1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0
    big = "<article>" + "<p>word " * 20000 + "</article>"
    assert html_text.main_text(big).count("\n") == 19999


# ---- 2 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("few", [1, 1024])
@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_suffix_order(block, few, monkeypatch):
    monkeypatch.setattr(induced_sort, "FEW", few)
    rng = np.random.default_rng(block)
    for _ in range(60):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0)
        order = induced_sort.sort_suffixes(t, 6, memory=8, block=block)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute_repeats(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("window, anchor", [(200, 80), (30, 12)])
def test_repeats(docs, corpus, window, anchor):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, window, anchor).collect()}
    want = brute_repeats([(t or "").encode() for _, t, *_ in corpus], window)
    assert got == dict(zip(range(len(corpus)), want, strict=True))


def test_repeats_hot_anchor(spark, monkeypatch):
    rng = random.Random(4)
    passage = words(rng, 12, 5000)
    texts = [f"{words(rng, 8, 5000)} {passage} {words(rng, 8, 5000)}" for _ in range(150)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC).repartition(3)
    sort = suffix_dedup._sort_shards

    def bounded(window):
        def run(batches):
            size = Counter()
            held = list(batches)
            for b in held:
                for anchor, piece in zip(b.column(0).to_pylist(), b.column(6).to_pylist()):
                    size[anchor] += len(piece)
            assert max(size.values(), default=0) <= 2000
            yield from sort(window)(iter(held))

        return run

    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    monkeypatch.setattr(suffix_dedup, "_sort_shards", bounded)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, 30, 12).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], 30)))


def test_suffixes_of_a_shard_stay_in_memory(monkeypatch):
    """A queue of the default size holds half a shard's tuples; symbols of any size sort stably."""
    spilled = []
    spill = induced_sort.BulkQueue._spill
    monkeypatch.setattr(induced_sort.BulkQueue, "_spill", lambda self: (spilled.append(self.held), spill(self)))
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 9, 1 << 20), 0)
    t[1:-1:2] += 100  # every other suffix waits in the queue
    order = induced_sort.sort_suffixes(t, 109)
    assert sorted(order.tolist()) == list(range(len(t))) and (np.diff(t[order]) >= 0).all() and not spilled
    for top in (5, 1 << 16, 1 << 40, 1 << 61):
        x = rng.integers(0, 50, 3000) * (top // 50 + 1)
        assert induced_sort._by(x).tolist() == sorted(range(len(x)), key=lambda i: x[i])


def test_repeats_spill(docs, corpus, monkeypatch):
    """Shards whose queues hold more tuples than memory may: their runs go to disk, the result stays."""
    spilled = []
    spill = induced_sort.BulkQueue._spill
    monkeypatch.setattr(induced_sort.BulkQueue, "_spill", lambda self: (spilled.append(self.held), spill(self)))
    texts = [(t or "").encode() for _, t, *_ in corpus]
    pieces = [(t, max(0, len(t) - 29)) for t in texts]
    sort = induced_sort.suffix_order
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda text, size: _sorted(sort, text, size))
    flags = suffix_dedup.repeated_windows(pieces, 30)
    seen = Counter(t[i : i + 30] for t in texts for i in range(len(t) - 29))
    assert spilled and all(f.tolist() == [seen[t[i : i + 30]] > 1 for i in range(max(0, len(t) - 29))] for f, t in zip(flags, texts, strict=True))


def _sorted(sort, text, size):
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        return sort(text, size, folder, memory=2000, block=256)


def test_repeats_long_text(spark, monkeypatch):
    """Texts beyond the bytes hashed at a time, and pieces beyond the longest, lose nothing at the seams."""
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    monkeypatch.setattr(suffix_dedup, "LONGEST", 64)
    rng = random.Random(8)
    shared = words(rng, 60, 5000)
    texts = [words(rng, 200, 5000) + shared + words(rng, 90, 5000), words(rng, 10, 5000) + shared, "z" * 900]
    for t, want in zip(texts, brute_repeats([t.encode() for t in texts], 30), strict=True):
        parts = [p for part in suffix_dedup.pieces_of(t.encode(), 30, 12) for p in zip(part[2].tolist(), part[3].tolist(), strict=True)]
        assert sorted(k for a, n in parts for k in range(a, a + n)) == list(range(len(t) - 29)) and want[0] == len(t)
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC), 30, 12).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == dict(enumerate(brute_repeats([t.encode() for t in texts], 30)))


def test_repeats_odd(odd):
    out = suffix_dedup.remove_repeats(odd, 10, 4, with_text=True).collect()
    assert len(out) == 5 and sorted(r.n_removed for r in out) == [0, 0, 0, 27, 27]
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------------------------------------


def test_mix(docs, corpus):
    out = mixing.mix_sources(docs, block_words=7, carry=("lang",)).drop("lang").join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(out) == len(corpus) and (out.taken <= 2 * out["size"]).all()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    targets = out.groupby("source", dropna=False)["target"].first()
    taken = out.groupby("source", dropna=False)["taken"].sum()
    weight = dict(zip(sorted(s for s in sizes.index if isinstance(s, str)), (3, 1, 2), strict=True))
    left, open_, goal = 1.5 * sizes.sum(), list(sizes.index), {}
    while open_:
        share = {s: left * weight.get(s, 3) / sum(weight.get(x, 3) for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        goal |= {s: 2.0 * sizes[s] for s in over} or share
        left -= sum(2.0 * sizes[s] for s in over)
        open_ = [s for s in open_ if s in share and s in over and False or (over and s not in over)]
    for s in sizes.index:
        assert math.isclose(targets[s], goal[s], rel_tol=1e-9) and abs(taken[s] - targets[s]) <= 0.5
    again = mixing.mix_sources(docs.repartition(3), block_words=7).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == out.sort_values("doc_id").taken.tolist()


def test_schedule_is_even(spark):
    sized = spark.createDataFrame([("a", 30000), ("b", 30000), ("c", 30000)], "source string, size long")
    slots = mixing.mix_schedule(mixing.source_targets(sized), 10).orderBy("slot").toPandas()
    share = slots.groupby("src").size() / len(slots)
    for at in range(0, len(slots) - 600, 600):
        part = slots.iloc[at : at + 600].groupby("src").size() / 600
        assert (part - share).abs().max() < 0.02
    assert (slots.groupby("src")["rank"].max() == slots.groupby("src").size()).all()


def test_mix_odd(odd):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == 5 and sum(r.size for r in out) == 17
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    # Every source stops at twice its words here, or takes its target: rows without an id are taken as any other.
    took = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(odd).collect()}
    kept = Counter((r.doc_id, len((r.text or "").split())) for r in mixing.mixed_documents(odd).collect())
    assert kept[None, 5] == (2 * took[None, 5] + 5) // 10 > 0


def test_mix_hot_source_and_long_text(spark):
    """A source with most rows and a text longer than many blocks: targets are met, no document exceeds twice its size."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 9)), None, "hot" if i % 8 else "b", None) for i in range(400)] + [(1000, words(rng, 9000), None, "c", None), (1001, None, None, None, None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).toPandas().merge(spark.createDataFrame(rows, DOC).select("doc_id", "source").toPandas(), on="doc_id")
    assert (out.taken <= 2 * out["size"]).all() and out.first_slot.notna().sum() == (out.taken > 0).sum()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5


# ---- 4 ---------------------------------------------------------------------------------------------------------------------


def brute_components(sets, percent):
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def shingle_set(text, width):
    w = "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(docs, corpus, width, percent):
    out = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, width, percent).collect()}
    sets = [shingle_set(t, width) for _, t, *_ in corpus]
    want = brute_components(sets, percent)
    assert [out[i].n_shingles for i in range(len(corpus))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(corpus))] == want
    kept = jaccard_join.first_of_components(docs, width, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_jaccard_tiles(spark, monkeypatch):
    """A block of many tiles links what one tile would."""
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 3)
    rng = random.Random(1)
    base = words(rng, 100, 9000).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    got = [r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOC), 3, 80).orderBy("doc_id").collect()]
    assert got == brute_components([shingle_set(r[1], 3) for r in rows], 80)


def test_jaccard_pivots_and_rest(spark, monkeypatch):
    """Large blocks of several clusters in neighbouring size classes, tied by shared keys: both rounds find what brute force does."""
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = random.Random(12)
    base = words(rng, 60, 9000).split()
    rows = []
    for i in range(70):
        w = list(base[: rng.choice([40, 46, 52, 60])])
        for _ in range(rng.choice([0, 1, 3, 9])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, None))
    frame = spark.createDataFrame(rows, DOC)
    for width, percent in ((3, 80), (2, 60)):
        got = [r.component_id for r in jaccard_join.jaccard_components(frame, width, percent).orderBy("doc_id").collect()]
        assert got == brute_components([shingle_set(r[1], width) for r in rows], percent)


def test_jaccard_hot_copies(spark):
    """A third of the rows are copies, a third near copies: ties within a slice and across slices meet."""
    rng = random.Random(2)
    base = words(rng, 120, 9000).split()
    texts = [" ".join(base)] * 60 + [" ".join([*base[:k], f"z{k}", *base[k + 1 :]]) for k in range(60)] + [words(rng, 50, 9000) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC).repartition(7)
    got = [r.component_id for r in jaccard_join.jaccard_components(frame).orderBy("doc_id").collect()]
    assert got == [0] * 120 + list(range(120, 180)) and jaccard_join.first_of_components(frame).count() == 61


def test_divide_skip_and_prefixes():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        sets = []
        for _ in range(30):
            keep = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])))
        linked = {(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        want = components.local_labels(np.array([i for i, _ in linked] or [0]), np.array([j for _, j in linked] or [0]), 30)
        edges = jaccard_join.divide_skip(sets, np.zeros(30, int), percent)
        assert all((max(e), min(e)) in linked for e in edges)
        got = components.local_labels(np.array([a for a, _ in edges] or [0]), np.array([b for _, b in edges] or [0]), 30)
        assert got.tolist() == want.tolist()
        for counts in (np.zeros(jaccard_join.BUCKETS), rng.integers(0, 9, jaccard_join.BUCKETS)):
            order = jaccard_join.Order(counts)
            keys = [set(order.first(s, percent).tolist()) for s in sets]
            assert all(keys[i] & keys[j] for i, j in linked) and all(len(k) == jaccard_join.prefix_length(len(s), percent) for k, s in zip(keys, sets, strict=True))


def test_common_shingles_stand_last():
    rng = np.random.default_rng(1)
    shingles = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    counts = np.ones(jaccard_join.BUCKETS, np.int64)
    common = shingles[::3]
    counts[(shingle_hashes.mixed(common) >> np.uint64(48)).astype(np.int64)] = 1000
    order = jaccard_join.Order(counts)
    first, rare = set(order.first(shingles, 80).tolist()), np.setdiff1d(shingles, common)
    assert len(first) == 101 and not first & set(order.first(common, 1).tolist()) and first <= set(order.first(rare, 1).tolist())


def test_jaccard_odd(odd):
    out = jaccard_join.jaccard_components(odd, 5, 80).collect()
    assert len(out) == 5 and jaccard_join.jaccard_components(odd.limit(0), 5, 80).count() == 0
    assert jaccard_join.first_of_components(odd, 5, 80).count() == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (102, 100), (100, 102)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 5 ---------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base, base[:4] + 0.15 * rng.normal(size=(4, 16)), base[:3], 2.5 * base[:2]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("nan")] + [1.0] * 15, 1), (93, [], 1), (94, [1.0, None], 1), (95, [1.0, 2.0], 1), (96, [2.0, 4.0], 1), (97, [-2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = components.local_labels(*np.nonzero(link), len(x))
    for tile in (4, 4096):
        got = {r.vec_id: r for r in embedding_dedup.embedding_near_dups(frame, tile=tile).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), label[i], label[i] == i)
        assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(90, 95))
        assert [(got[i].n_links, got[i].component_id) for i in (95, 96, 97)] == [(1, 95), (1, 95), (0, 97)]
    assert embedding_dedup.embedding_near_dups(frame.limit(0)).count() == 0


def test_embeddings_odd(spark):
    """Repeated and null ids, extra columns whose names clash with the operator's own; a hot group of near copies over many tiles."""
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (None, [0.0, 1.0], "z"), (2, [0.9, 0.1], None)]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string")).collect())
    assert out == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((90, 12)) + 0.02 * rng.normal(size=(90, 12)), rng.normal(size=(30, 12))])
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_dups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), tile=9).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert [got[i].n_links for i in range(120)] == ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(approx - x @ x.T) <= e[:, None] + (1 + e[:, None]) * e[None]).all()


# ---- 6 ---------------------------------------------------------------------------------------------------------------------


def test_stream_dedup(spark, docs, corpus, tmp_path):
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    out = {r.doc_id: r for r in stream_dedup.dedup_exact(spark, str(tmp_path / "docs"), files_per_batch=2).collect()}
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in corpus]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (out[i].keep_id, out[i].group_size, out[i].kept, out[i].text_sha256) == (same[0], len(same), same[0] == i, hashlib.sha256(t.encode()).hexdigest())


def test_stream_dedup_goes_on_and_checks_bytes(spark, odd, tmp_path, monkeypatch):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    odd.write.parquet(path)
    first = stream_dedup.dedup_exact(spark, path, state).collect()
    assert len(first) == 5 and sum(r.kept for r in first) == 3
    odd.limit(1).write.mode("append").parquet(path)
    assert {r.group_size for r in stream_dedup.dedup_exact(spark, path, state).collect() if r.doc_id == 1} == {3}
    # Digests that clash: texts are told apart by their bytes.
    monkeypatch.setattr(stream_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    clash = stream_dedup.dedup_exact(spark, path).collect()
    assert sorted(r.group_size for r in clash) == [1, 2, 2, 3, 3, 3]


# ---- 7 ---------------------------------------------------------------------------------------------------------------------


def check_packing(out, ids, capacity):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, want in ids.items():
        at = 0
        for start, length, crc, total in sorted(by_doc[i]):
            assert start == at and total == len(want) and crc == zlib.crc32(np.array(want[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(want)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    tok = Tokenizer.from_str(text)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in corpus}
    for capacity in (4096, 64):
        sequences = check_packing(packing.pack_documents(docs, text, capacity).collect(), ids, capacity)
        assert sequences <= sum(map(len, ids.values())) / capacity * 1.05 + 1


def test_words_are_known_without_their_punctuation():
    """Ids of texts of odd words are the tokenizer's own; capitals and punctuation at the end make no new words."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    text = queries.tokenizer_json()
    plain = json.loads(text)
    plain["normalizer"]["normalizers"] = [x for x in plain["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    rng = random.Random(8)
    odd = [*"aZé9ß'.,;|#!~`<>-", "İ", "Σ", "\u0301", "\u0338", "\x1c", "\xa0", "٣", "’", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "Don", "É", "E\u0301", "\x00", " "]
    texts = ["", " ", *("".join(rng.choice(odd) for _ in range(rng.randrange(1, 9))) for _ in range(6000)), *(a + b for a in odd for b in ".;'")]
    for setup in (text, json.dumps(plain)):
        tok, words = Tokenizer.from_str(setup), packing.WordIds(setup, 2)
        assert words.apart == (setup == text)
        ids, sizes = words(pa.array(texts, pa.large_string()))
        at = 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*(i for w in packing_words(t) for i in tok.encode(w, add_special_tokens=False).ids), 2], repr(t)
            at += n
    words = packing.WordIds(text, 2)
    words(pa.array(["Word word. WORD, word; Other other!"], pa.large_string()))
    assert set(words.known) == {"", "word", "other", ".", ",", ";", "!"}
    assert words(pa.array([], pa.large_string()))[0].tolist() == []


def packing_words(text):
    return [w for w in re.split("[ \t-\r]+", text) if w]


def test_packing_odd(odd):
    out = packing.pack_documents(odd, queries.tokenizer_json(), carry=("block",)).collect()
    assert sum(r.start == 0 for r in out) == 5 and packing.pack_documents(odd.limit(0), queries.tokenizer_json()).count() == 0


def test_cut_lengths():
    for n in [0, 1, 63, 64, 65, 4095, 4096, 4097, 10000]:
        cut = packing.cut_lengths(n)
        assert sum(cut) == n and all(c <= 4096 for c in cut)


# ---- 8 ---------------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(i, f"http://x/{i} y", h) for i, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 50000, "<p>a</p>"])] + [(None, None, "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(out) == 8 and out[0].record_type == "response" and (out[2].refers_to, out[6].refers_to, out[4].refers_to, out[None].refers_to) == (0, 0, 3, 1)
    assert out[5].payload_bytes == 100000 and out[2].payload_bytes == 8
    assert all(r.payload_digest == warc.sha1_base32((h or "").encode()) for i, _, h in rows for r in [out[i]])
    small = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, revisit_bytes=9).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_archives_of_any_address(spark):
    """Page records are responses or revisits whatever their address; rows that share an id are records of their own."""
    rows = [(1, "ftp://x/a", "<p>a</p>"), (2, "http://x/b", "<p>a</p>"), (3, "/rel", "<p>a</p>"), (4, None, "<p>b</p>"), (4, "", "<p>b</p>")]
    out = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out == [(1, "response", 0), (2, "revisit", 1), (3, "revisit", 1), (4, "response", 0), (4, "revisit", 4)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parsing(version):
    name = "f.arc"
    data = warc.arc_version_block(version, name) + b"\n" + warc.arc_record(version, name, 9, "http://a/b c", b"HTTP/1.1 200 OK\r\n\r\nbody\n\nhttp://x 1 2 text 3\n") + warc.arc_record(version, name, 99, "dns:a", b"1.2.3.4", "text/dns")
    records = list(warc.parse_arc(BytesIO(data)))
    assert [n for n, _, _ in records] == [0, 1, 2] and records[1][2].endswith(b"text 3\n") and records[2][1]["Content-type"] == "text/dns" and records[0][1]["version"] == str(version)
    cut = list(warc.parse_arc(BytesIO(data[:-4])))
    assert cut[2][1]["truncated"] == "length"
    with pytest.raises(ValueError):
        list(warc.parse_arc(BytesIO(b"http://a 1 2 text/html 3\nabc\n")))
    assert (warc._warc_date("20240203040506"), warc._warc_date("199901"), warc._warc_date("x")) == ("2024-02-03T04:05:06Z", "1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z")
    assert warc._warc_type("dns:a") == "resource" and warc._warc_type("HTTPS://a") == "response"


# ---- 9 ---------------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    assert set(out.doc_id) == {i for i in docs.toPandas().doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def brute_kneser_ney(texts, order=4):
    """Probability of a character after a context, by the definition, over dictionaries."""

    def letters(t):
        out = " "
        for ch in t.lower():
            ch = ch if ch.isalpha() else " "
            out += ch if ch != " " or out[-1] != " " else ""
        return "   " + out

    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = letters(t)
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discount = [0.0]
    for k in range(1, order + 1):
        once, twice = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        discount.append(min(max(once / max(once + 2 * twice, 1), 0.1), 0.95))

    def p(context, ch, floor):
        k = len(context) + 1
        below = p(context[1:], ch, floor) if context else floor
        same = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not same:
            return below
        total = sum(same.values())
        return max(same.get(context + ch, 0) - discount[k], 0) / total + discount[k] * len(same) / total * below

    return letters, p, {g for g in counts[1]}


def test_language_models_by_definition():
    texts = {"x": ["abc abd abe, cab", "bad cab aéb"], "y": ["xyz zyx xxz", "yyz a"]}
    model = language_id.CharModel({k: language_id.count_grams(v) for k, v in texts.items()})
    brute = {k: brute_kneser_ney(v) for k, v in texts.items()}
    floor = 1 / (len(set().union(*(b[2] for b in brute.values()))) + 1)
    for text in ("abc", "zzz ab", "a", "Bad, cab! xyz", "qqq", "b  c"):
        h, n = model.cross_entropies([text])
        for j, lang in enumerate(model.languages):
            letters, p, _ = brute[lang]
            s = letters(text)
            want = -sum(math.log(p(s[i - 3 : i], s[i], floor)) for i in range(4, len(s))) / (len(s) - 4)
            assert n[0] == len(s) - 4 and math.isclose(h[0, j], want, rel_tol=1e-4), (text, lang)


def test_language_ties_long_texts_and_rejection(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    long = " ".join(r.text for r in docs.filter("lang = 'en' and text is not null").limit(20).collect())
    odd = [(1, long), (2, "zqxj vkw qqpz xkcd wvz qjxz kkzq vwxq zzkq jjqx " * 20), (3, "1234 %% 99"), (4, long[:400])]
    frame = spark.createDataFrame(odd, "doc_id long, text string")
    whole = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert whole[1].lang_pred == whole[4].lang_pred == "en" and whole[1].accepted and not whole[2].accepted and not whole[3].accepted and whole[3].lang_pred == "und"
    monkeypatch.setattr(language_id, "SLICE", 50)  # texts beyond a slice are still whole
    cut = {r.doc_id: r for r in language_id.predict(frame, model).collect()}
    assert all(math.isclose(cut[k].cross_entropy or 0, whole[k].cross_entropy or 0, rel_tol=1e-6) for k in whole)
    same = language_id.CharModel({k: language_id.count_grams(["abc abc"]) for k in ("a", "b")})
    assert {r.lang_pred for r in language_id.predict(frame, same).filter("doc_id <> 3").collect()} == {"a"}
    kept = docs.filter("lang is not null and length(text) > 40").count()
    assert language_id.predict(docs.filter("lang is not null and length(text) > 40"), model).filter("accepted").count() >= 0.99 * kept


def test_language_probabilities_add_up():
    model = language_id.CharModel({"x": language_id.count_grams(["abc abd abe cab", "bad cab"]), "y": language_id.count_grams(["xyz zyx xxz yyz"])})
    for prefix in ("", "a", "ab", "zz", "bad c"):
        letters = "abcdexyz "
        total = np.zeros(2)
        for ch in letters:
            with_, without = (model.cross_entropies([prefix + t]) for t in (ch + "|", "|"))
            del without
            h, n = model.cross_entropies([prefix + ch]) if ch != " " else model.cross_entropies([prefix + " |"])
            h0, n0 = model.cross_entropies([prefix]) if prefix.strip() else (np.zeros((1, 2)), np.zeros(1))
            if ch == " " and not prefix.strip():
                continue
            total += np.exp(-(h[0] * max(n[0], 1) - h0[0] * n0[0]))
            del with_
        assert (total <= 1.0001).all() and (total > 0.2).all()


def test_language_odd(spark, odd):
    model = language_id.train(odd)
    out = language_id.predict(odd, model).collect()
    assert len(out) == 5 and {r.lang_pred for r in out if not r.text} == {"und"} and all(r.block or r.doc_id == 2 for r in out)
    assert language_id.train(odd.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    alone = language_id.predict(odd.filter("doc_id is null and text is not null"), model).first()
    assert alone.cross_entropy == next(r.cross_entropy for r in out if r.doc_id is None and r.text)


# ---- 10 --------------------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_lines(spark, corpus):
    rng = random.Random(9)
    rows = list(corpus)
    for i in range(20):
        line = words(rng, 9, 5000).split()
        variants = [line, line[:4] + line[5:], line[:4] + ["new"] + line[5:], [*line[:2], "more", *line[2:]], line[2:], ["z", *line[1:-1], "q"]]
        rows += [(1000 + 10 * i + k, " ".join(v), None, None, None) for k, v in enumerate(variants)]
    docs = spark.createDataFrame(rows, DOC)
    lines = [(i, k, line.split()) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= 5]
    want = Counter()
    for p, (i, _, w) in enumerate(lines):
        want[i] += any(abs(len(w) - len(v)) <= 1 and edit_distance(w, v) <= 1 for _, _, v in lines[:p])
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert {i: r.n_dropped for i, r in got.items()} == {i: want[i] for i, *_ in rows}
    assert all(r.n_dropped == len([x for x in r.dropped_lines.split(",") if x]) for r in got.values())
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    for i, t, *_ in rows:
        gone = {int(x) for x in got[i].dropped_lines.split(",") if x}
        assert kept[i] == (t if t is None or not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))


def test_lines_odd(odd):
    assert sorted(r.n_dropped for r in line_dedup.line_report(odd).collect()) == [0, 0, 0, 0, 0]
    assert line_dedup.line_report(odd.limit(0)).count() == 0 and line_dedup.drop_lines(odd).columns == odd.columns


def test_short_lines_equal(spark):
    texts = ["All rights reserved.\n\none two three\n版权所有", "\nAll  rights reserved.\nAll rights\none two four\n版权所有\n ", "one two three\none two three\nAll rights Reserved."]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id: r.dropped_lines for r in line_dedup.line_report(docs).collect()} == {0: "", 1: "1,4", 2: "0,1"}
    assert {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()} == {0: texts[0], 1: "\nAll rights\none two four\n ", 2: "All rights Reserved."}


def test_lines_hot_keys(spark):
    """A template with many fillings, one very frequent line, and lines whose first partner in a key is itself late."""
    rng = random.Random(21)
    template = words(rng, 8, 5000).split()
    texts = ["\n".join(" ".join([*template[:4], f"f{rng.randrange(10**6)}", *template[4:]]) for _ in range(3)) + "\nthe same line stands in every text" for _ in range(60)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC).repartition(5)
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(frame).collect()}
    assert got == {0: 2, **{i: 4 for i in range(1, 60)}}
    assert line_dedup.drop_lines(frame.limit(0)).count() == 0


def test_one_edit():
    a = np.array([1, 2, 3, 4], np.uint64)
    for b, yes in (([1, 2, 3, 4], 1), ([1, 2, 4], 1), ([2, 3, 4], 1), ([1, 2, 3], 1), ([1, 9, 3, 4], 1), ([1, 2, 3, 4, 5], 1), ([0, 1, 2, 3, 4], 1), ([1, 3, 2, 4], 0), ([1, 2], 0), ([2, 3, 4, 5], 0)):
        assert line_dedup.one_edit(a, np.array(b, np.uint64)) == bool(yes)


# ---- words, pipeline -------------------------------------------------------------------------------------------------------


def test_word_hashes():
    texts = [b"a bb\tccc", b"", b" \n ", "é bb".encode(), b"A BB"]
    h, start, end, first = shingles.word_hashes(texts)
    joined = b"\n".join([*texts, b""])
    assert [joined[a:b] for a, b in zip(start, end, strict=True)] == joined.split() and first.tolist() == [0, 3, 3, 3, 5, 7]
    assert h[1] == h[4] == h[6] and h[0] == h[5] and len({*h.tolist()}) == 4


def near_lines(docs):
    """Numbers of the lines to drop, by comparing every line with every earlier one."""
    lines = [(i, k, tuple(line.split())) for i, t in docs for k, line in enumerate((t or "").split("\n")) if line.split()]
    first, gone, by_size = {}, {}, {}
    for i, k, w in lines:
        seen = w in first
        first.setdefault(w, (i, k))
        if not seen and len(w) >= 5:
            a = np.array([hash(x) for x in w], np.int64)
            near = any(line_dedup.one_edit(a, b) for n in (len(w) - 1, len(w), len(w) + 1) if n >= 5 for b in by_size.get(n, ()))
            by_size.setdefault(len(w), []).append(a)
            first[w] = None if near else first[w]
        if first[w] != (i, k):
            gone.setdefault(i, set()).add(k)
    return gone


def test_pipeline(spark):
    """Every stage on what the one before it kept, against brute force on the same rows; run() gives the last stage's rows."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)

    def step(name, df):
        out = stages[name](spark, df, SF)
        assert out.columns == docs.columns, name
        return spark.createDataFrame(out.toPandas(), docs.schema)

    known = step("language_id", docs)
    model = language_id.train(docs)
    h, n = model.cross_entropies([r.text or "" for r in docs.collect()])
    best, low = h.argmin(axis=1), h.min(axis=1)
    good = [bool(k and e <= model.limits[b] * (1 + language_id.SHORT / k)) for b, e, k in zip(best, low, n, strict=True)]
    assert rows(known) == sorted(((r.doc_id, r.text, r.lang, r.source) for r, g in zip(docs.collect(), good, strict=True) if g), key=str)

    fresh = step("line_dedup", known)
    gone = near_lines(sorted((r.doc_id, r.text) for r in known.collect()))
    cut = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if i in gone else t
    assert rows(fresh) == sorted(((r.doc_id, cut(r.doc_id, r.text), r.lang, r.source) for r in known.collect()), key=str)

    apart = step("ngram_jaccard", fresh)
    own = sorted(fresh.collect(), key=lambda r: r.doc_id)
    label = brute_components([shingle_set(r.text, 5) for r in own], 80)
    assert rows(apart) == sorted(((r.doc_id, r.text, r.lang, r.source) for k, r in enumerate(own) if label[k] == k), key=str)

    mixed = step("mixing", apart)
    own, want = apart.collect(), Counter()
    size = {r.doc_id: len((r.text or "").split()) for r in own}
    goal = {(r.doc_id): r.target for r in mixing.mix_sources(apart).collect()}
    for source in {r.source for r in own}:
        mine = sorted((r for r in own if r.source == source), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
        whole, at = sum(size[r.doc_id] for r in mine), 0
        need = min(2 * whole, math.floor(goal[mine[0].doc_id] + 0.5))
        for r in mine:
            n = size[r.doc_id]
            taken = max(min(at + n, need) - at, 0) + max(min(at + n, need - whole) - at, 0)
            want[r.doc_id] += (2 * taken + n) // (2 * n) if n else 0
            at += n
    assert Counter(r.doc_id for r in mixed.collect()) == +want

    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(queries.tokenizer_json())
    packed = stages["packing"](spark, mixed, SF).collect()
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in mixed.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, Counter())[r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for i, pieces in by_doc.items():
        assert set(pieces.values()) == {copies[i]} and sum(length for _, length, _, _ in pieces) == len(ids[i])
        assert all(crc == zlib.crc32(np.array(ids[i][a : a + n], "<u4").tobytes()) for a, n, crc, _ in pieces)
    assert set(by_doc) == set(ids)
    columns = packed[0].__fields__
    assert corpus_pipeline.run(spark, SF).toPandas()[columns].sort_values(columns).values.tolist() == sorted([list(r) for r in packed])


def test_pipeline_odd(spark, odd):
    """Nulls in every column, empty tables, repeated rows, a column whose name clashes: every stage gives rows of its input's columns."""
    import corpus_pipeline

    for frame in (odd, odd.limit(0), spark.createDataFrame([(None,) * 5], DOC)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == frame.columns and out.count() <= 2 * frame.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).filter("start = 0").count() == frame.count()
