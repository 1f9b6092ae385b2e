"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crossparse, fertility, packing, pii, resample, runs, spotsigs, tagpaths, toxicity, unigram, warc, wordbpe
from .minhash import near_duplicates


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4, limit=(4, 5))


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(documents(spark, sf_dir))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity join of op1's fingerprints: classes of equal ones and their links."""
    return spotsigs.near_classes(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(documents(spark, sf_dir))


def op4_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.held_out_languages(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.main_text(pages(spark, sf_dir))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encoded(documents(spark, sf_dir))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapsed(documents(spark, sf_dir), planted=True)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "spotsigs_classes": spotsigs_classes,
    "op2_packing": op2_packing,
    "op3_unigram": op3_unigram,
    "op4_cross_parse": op4_cross_parse,
    "op5_fertility": op5_fertility,
    "op6_minhash": op6_minhash,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_disclosure": op9_disclosure,
    "op10_tag_paths": op10_tag_paths,
    "op11_tree_bpe": op11_tree_bpe,
    "op12_runs": op12_runs,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op6_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.v""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS f FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f IS NULL OR f = d.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> d.page_id THEN f END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100""",
    "op9_disclosure": r"""
WITH d AS (SELECT min(doc_id) AS doc_id, coalesce(text, '') AS t FROM documents GROUP BY t),
pat AS (SELECT * FROM (VALUES (1, 'email'), (2, 'ip'), (3, 'card'), (4, 'phone')) p(k, kind)),
m AS (
  SELECT doc_id, 1 AS k, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS f, regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS g FROM d
  UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), regexp_split_to_array(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), regexp_split_to_array(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, 4, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
x AS (SELECT doc_id, k, unnest(f) AS v, unnest(g[:len(f)]) AS gap, unnest(range(len(f))) AS i FROM m),
y AS (SELECT doc_id, k, v, regexp_replace(v, '[^0-9]', '', 'g') AS n, sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i) AS z FROM x),
luhn AS (SELECT doc_id, z, sum(CASE WHEN j % 2 = 0 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END) % 10 = 0 AS ok
  FROM (SELECT doc_id, z, j, CAST(substr(n, length(n) - j, 1) AS INTEGER) AS c FROM (SELECT doc_id, z, n, unnest(range(length(n))) AS j FROM y WHERE k = 3 AND length(n) BETWEEN 16 AND 19)) GROUP BY doc_id, z),
base AS (SELECT y.doc_id, k, kind, v, y.z - length(v) AS a, y.z, kind || ':' || CASE WHEN k > 2 THEN n ELSE lower(v) END AS entity
  FROM y JOIN pat USING (k) LEFT JOIN luhn ON k = 3 AND luhn.doc_id = y.doc_id AND luhn.z = y.z
  WHERE k = 1 OR k = 3 AND luhn.ok OR k = 4 AND length(n) BETWEEN 8 AND 15
    OR k = 2 AND len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0),
total AS (SELECT count(DISTINCT text) AS docs FROM documents),
holds AS (SELECT DISTINCT doc_id, entity FROM base),
freq AS (SELECT entity, held, docs FROM (SELECT entity, count(*) AS held FROM holds GROUP BY entity), total WHERE held < docs),
kept AS (SELECT doc_id, entity FROM holds SEMI JOIN freq USING (entity)),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '\p{L}{3,}') AS w FROM d),
near AS (SELECT doc_id, w[i] AS term, coalesce(w[nullif(i - 1, 0)], '') AS before, coalesce(w[i + 1], '') AS after FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w SEMI JOIN kept USING (doc_id))),
seen AS (SELECT entity, term, doc_id, before, after FROM near JOIN kept USING (doc_id)),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS together, count(DISTINCT (before, after)) AS contexts FROM seen GROUP BY entity, term HAVING contexts >= 3),
spread AS (SELECT term, count(*) AS spread FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(w) AS term FROM w) SEMI JOIN pairs USING (term)) GROUP BY term),
terms AS (SELECT entity, term FROM pairs JOIN spread USING (term) JOIN freq USING (entity) WHERE log2(together * docs / (spread * held)) / log2(docs / held) >= 0.8),
named AS (SELECT DISTINCT doc_id, term FROM holds JOIN terms USING (entity)),
cut AS (SELECT doc_id, unnest(f) AS v, unnest(g[:len(f)]) AS gap, unnest(range(len(f))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\p{L}{3,}') AS f, regexp_split_to_array(t, '\p{L}{3,}') AS g FROM d SEMI JOIN named USING (doc_id))),
found AS (SELECT doc_id, v, sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM cut),
spans AS (SELECT doc_id, k, kind, a, z FROM base UNION ALL SELECT doc_id, 5, 'term', z - length(v), z FROM found SEMI JOIN named ON named.doc_id = found.doc_id AND named.term = lower(v)),
rows AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (k < 5) AS b, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS s FROM spans GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents x JOIN d ON coalesce(x.text, '') = d.t LEFT JOIN rows ON rows.doc_id = d.doc_id""",
    "op13_resample": r"""
WITH texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, doc_id, unnest(w) AS f FROM w UNION ALL SELECT side, doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT side, doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
n AS (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
known AS (SELECT f, hex(encode(f)) AS h FROM n GROUP BY f),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known, crc),
sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM n JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s, coalesce(sum(t), 0)::BIGINT AS t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(b.t, 0)::DOUBLE + 1) * (a.s + 10000)::DOUBLE / ((coalesce(b.s, 0)::DOUBLE + 1) * (a.t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums b, totals a),
sizes AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('7:' || w.doc_id), 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN sizes USING (doc_id) WHERE side = 0),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)""",
}
