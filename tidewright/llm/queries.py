"""Queries and oracle SQL of the corpus operators, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import embedding_dedup, fingerprints, html_text, jaccard_join, language_id, line_dedup, merkle, mixing, packing, stream_dedup, suffix_dedup, warc, whitening
from .common import WORD, table


def op1_html_main_text(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


#: Every 200-byte string by its hash (bytes as two hexadecimal digits); starts of repeated ones give the removed runs.
OP2_SQL = """
WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS d, hex(encode(coalesce(text, ''))) AS x FROM documents),
spots AS (SELECT d, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM t WHERE length(x) >= 400),
hashed AS MATERIALIZED (SELECT d, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM spots),
again AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
hits AS (SELECT d, i, lag(i) OVER (PARTITION BY d ORDER BY i) AS before FROM hashed SEMI JOIN again USING (h)),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS run FROM hits),
runs AS MATERIALIZED (SELECT d, run, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY d, run),
gaps AS (SELECT d, lo, coalesce(lag(hi) OVER (PARTITION BY d ORDER BY lo), 0) AS from_ FROM runs),
heads AS (SELECT t.d, string_agg(substr(x, 2 * from_ + 1, 2 * (lo - from_)), '' ORDER BY lo) AS kept FROM gaps g JOIN t ON t.d = g.d GROUP BY t.d),
ends AS (SELECT d, max(hi) AS hi, sum(hi - lo) AS gone, count(*) AS n FROM runs GROUP BY d)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(e.gone, 0)::BIGINT AS n_removed, coalesce(e.n, 0) AS n_spans, sha256(unhex(CASE WHEN e.d IS NULL THEN x ELSE h.kept || substr(x, 2 * e.hi + 1) END)) AS kept_sha256
FROM t LEFT JOIN ends e ON e.d = t.d LEFT JOIN heads h ON h.d = t.d
"""


def op3_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS src FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM per
), levels AS (
  SELECT *, ((sum(source_size) OVER () * 150 - coalesce(sum(most) OVER (ORDER BY most / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100)::DOUBLE
     / (sum(weight) OVER (ORDER BY most / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * 100)::DOUBLE) AS level FROM weighted
), level AS (
  SELECT arg_min(level, most / weight) AS level FROM levels WHERE most > level * weight
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(l.level * weight, most::DOUBLE)) AS target, most FROM weighted, level l
), needs AS (
  SELECT *, least(most, floor(target + 0.5)::BIGINT) AS need FROM targets
), placed AS (
  SELECT doc_id, size, source_size, target, need, coalesce(sum(size) OVER (PARTITION BY n.source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  , n.source FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
), taken AS (
  SELECT doc_id, size::BIGINT AS size, source_size, target, off, source, need,
    (greatest(least(off + size, need) - off, 0) + greatest(least(off + size, need - source_size) - off, 0))::BIGINT AS taken FROM placed
), plan AS (
  SELECT *, sum(slots) OVER (ORDER BY src) - slots AS first, sum(slots) OVER () AS total FROM (
    SELECT n.source, w.src, n.source_size, need % n.source_size AS rest, ceil(n.source_size / 256.0)::BIGINT AS blocks,
      (need // n.source_size * ceil(n.source_size / 256.0) + ceil(need % n.source_size / 256.0))::BIGINT AS slots
    FROM needs n JOIN weighted w ON w.source IS NOT DISTINCT FROM n.source WHERE need > 0)
), points AS (
  SELECT slot, (slot * 1327217885 % 2147483648)::DOUBLE / 2147483648 * total AS point FROM (SELECT max(total)::BIGINT AS total FROM plan) t, unnest(range(total)) AS u(slot)
), drawn AS (
  SELECT p.src, slot, row_number() OVER (PARTITION BY p.src ORDER BY slot) AS rank FROM points q JOIN plan p ON point >= first AND point < first + slots
), have AS (SELECT src, count(*) AS n FROM drawn GROUP BY src),
dealt AS (
  SELECT d.src, slot, rank FROM drawn d JOIN plan p ON p.src = d.src WHERE rank <= slots
  UNION ALL SELECT src, (total + first + rank)::BIGINT, rank FROM (SELECT p.*, unnest(range(coalesce(h.n, 0) + 1, slots + 1)) AS rank FROM plan p LEFT JOIN have h ON h.src = p.src) z
), pieces AS (
  SELECT p.source, d.slot, (rank - 1) % blocks * 256 AS lo, least((rank - 1) % blocks * 256 + 256, source_size, CASE WHEN rank = slots AND rest > 0 THEN rest ELSE source_size END) AS hi FROM dealt d JOIN plan p ON p.src = d.src
)
SELECT t.doc_id, size, source_size, target, taken, min(slot) AS first_slot FROM taken t LEFT JOIN pieces p ON p.source IS NOT DISTINCT FROM t.source AND size > 0 AND p.lo < off + size AND p.hi > off
GROUP BY t.doc_id, size, source_size, target, taken, off
"""


def op4_jaccard_divide_skip(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP4_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id != b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS MATERIALIZED (SELECT u, v FROM shared WHERE 100 * k >= 90 * (nu + nv - k)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
parts AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, len(s.s) AS n_shingles, p.component_id FROM sets s JOIN parts p ON p.u = s.doc_id
"""


def op5_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.embedding_near_dups(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), counts AS (SELECT u, count(*) AS n FROM links GROUP BY u), parts AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.u = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""


def op6_stream_exact_dedup(spark, sf_dir):
    return stream_dedup.dedup_exact(spark, f"{sf_dir}/documents.parquet")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""

def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_harmonic_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_json())


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text", language_id.held_out(F.col("doc_id")).alias("held_out")), language_id.train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_warc_from_arc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_line_neighbourhood_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM split),
lines AS MATERIALIZED (SELECT doc_id, no, doc_id * 1000000 + no AS spot, regexp_extract_all(line, '{WORD}') AS w FROM numbered),
firsts AS MATERIALIZED (SELECT w, len(w) AS n, array_to_string(w, ' ') AS k, min(spot) AS first FROM lines WHERE len(w) > 0 GROUP BY w),
places AS (SELECT *, unnest(range(1, n + 1)) AS p FROM firsts WHERE n >= 5),
variants AS MATERIALIZED (SELECT k, n, first, p, md5(array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ')) AS v FROM places),
replaced AS (SELECT k, min(first) OVER (PARTITION BY v, p, n) AS e FROM variants),
inserted AS (SELECT v.k AS k1, f.k AS k2, v.first AS f1, f.first AS f2 FROM variants v JOIN firsts f ON v.v = md5(f.k) AND f.n = v.n - 1 AND f.n >= 5),
earliest AS (
  SELECT k, min(e) AS e FROM (SELECT k, first AS e FROM firsts UNION ALL SELECT k, e FROM replaced UNION ALL SELECT k1, f2 FROM inserted UNION ALL SELECT k2, f1 FROM inserted) GROUP BY k
),
late AS (SELECT l.doc_id, l.no FROM lines l JOIN earliest e ON e.k = array_to_string(l.w, ' ') WHERE l.spot > e.e),
gone AS (SELECT doc_id, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS nos FROM late GROUP BY doc_id)
SELECT s.doc_id, len(l) AS n_lines, coalesce(g.n, 0) AS n_dropped, coalesce(g.nos, '') AS dropped_lines FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to
FROM p
"""


def op11_merkle_manifest(spark, sf_dir):
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), merkle.tampered_leaf()).drop("source", "path")


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384::BIGINT * (h & 1)) END), 4294967295)"""
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(octet_length(encode(text)) || ':' || {0}, '-'))"

#: Nodes of all trees level by level (the sources' tree counts from level 100), then each document's way up through them.
OP11_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents
), leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source COLLATE "binary" NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM rows_
), nodes(tree, lvl, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 16, n
), under AS MATERIALIZED (SELECT * FROM nodes),
tops AS MATERIALIZED (SELECT tree, lvl, h, count(*) OVER () AS s FROM under WHERE n = 1),
over_(lvl, idx, n, h) AS (
  SELECT 100, tree, s, h FROM tops UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM over_ WHERE n > 1 GROUP BY lvl, idx // 16, n
), all_ AS MATERIALIZED (SELECT tree, lvl, idx, n, h FROM under WHERE n > 1 UNION ALL SELECT -1, lvl, idx, n, h FROM over_ WHERE n > 1),
runs AS MATERIALIZED (SELECT tree, lvl, idx // 16 AS p, list(h ORDER BY idx) AS kids FROM all_ GROUP BY tree, lvl, idx // 16),
sides AS MATERIALIZED (SELECT a.tree, a.lvl, a.idx, array_to_string(kids[:a.idx % 16], '') AS lft, array_to_string(kids[a.idx % 16 + 2:], '') AS rgt FROM all_ a JOIN runs r ON r.tree = a.tree AND r.lvl = a.lvl AND r.p = a.idx // 16),
starts AS (SELECT row_number() OVER () AS doc, l.*, t.lvl AS height, t.h AS subroot FROM leaves l JOIN tops t ON t.tree = l.tree),
ways(doc, own, height, tree, lvl, idx, proof, fold) AS (
  SELECT doc, tree, height, CASE WHEN height = 0 THEN -1 ELSE tree END, CASE WHEN height = 0 THEN 100 ELSE 0 END, CASE WHEN height = 0 THEN tree ELSE idx END, '', coalesce(other, leaf) FROM starts
  UNION ALL
  SELECT w.doc, own, height, CASE WHEN w.lvl + 1 = height THEN -1 ELSE w.tree END, CASE WHEN w.lvl + 1 = height THEN 100 ELSE w.lvl + 1 END, CASE WHEN w.lvl + 1 = height THEN own ELSE w.idx // 16 END, proof || lft || rgt, sha256(lft || fold || rgt)
  FROM ways w JOIN sides s ON s.tree = w.tree AND s.lvl = w.lvl AND s.idx = w.idx
), ends AS (SELECT doc, arg_max(proof, lvl) AS proof, arg_max(fold, lvl) AS fold FROM ways WHERE lvl >= 100 GROUP BY doc)
SELECT doc_id, leaf, subroot, (SELECT h FROM over_ WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM over_ WHERE n = 1) AS verified
FROM starts s JOIN ends e ON e.doc = s.doc
"""


def op12_winnowing_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_jaccard_divide_skip": op4_jaccard_divide_skip,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_stream_exact_dedup": op6_stream_exact_dedup,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_warc_from_arc": op8_warc_from_arc,
    "op9_language_id": op9_language_id,
    "op10_line_neighbourhood_dedup": op10_line_neighbourhood_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_winnowing_fingerprints": op12_winnowing_fingerprints,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_jaccard_divide_skip": OP4_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op6_stream_exact_dedup": OP6_SQL,
    "op8_warc_from_arc": OP8_SQL,
    "op10_line_neighbourhood_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
}
