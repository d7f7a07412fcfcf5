"""Thin queries over the operators, with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, mixing, neargraph, recompression, secrets, simhash, spotsigs, warc
from .common import WORD, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree source/language/thousand. One whose first 200 characters speak of licensing
    stands as a licence file; the first digit of its id's digest says how high up."""
    docs = table(spark, sf_dir, "documents")
    top = F.coalesce("source", F.lit("none"))
    lang = F.coalesce("lang", F.lit("none"))
    number = F.col("doc_id").cast("string")
    leaf = F.concat_ws("/", top, lang, F.floor(F.col("doc_id") / 1000).cast("string"))
    digit = F.substring(F.md5(number), 1, 1)
    above = F.when(digit < "2", top).when(digit < "6", F.concat_ws("/", top, lang)).otherwise(leaf)
    stands = F.coalesce(F.substring("text", 1, 200).rlike(licenses.TRIGGER), F.lit(False))
    path = F.when(stands, F.concat(above, F.lit("/LICENSE."), number)).otherwise(F.concat(leaf, F.lit("/"), number, F.lit(".txt")))
    return licenses.scan(docs.select(path.alias("path"), "text")).withColumn("doc_id", F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).cast("long"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.allot(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "html")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_bpe_round_trip, op4_embedding_near_dedup, op5_spotsigs, op6_secret_scan, op7_substring_dedup, op8_warc_round_trip, op9_language_id, op10_simhash_near_dedup)}


def _license_sql() -> str:
    idf, unseen, rows = licenses.weights()
    words = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in sorted(idf.items()))
    vectors = ", ".join(f"('{t}', {k}, '{name}', {w!r}::DOUBLE)" for t, k, name, w in rows)
    return rf"""
WITH idf(term, idf) AS (VALUES {words}), vectors(term, template, licence, weight) AS (VALUES {vectors}),
placed AS (
  SELECT doc_id, text, coalesce(source, 'none') AS top, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS two, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id // 1000 AS leaf,
    substr(md5(doc_id::VARCHAR), 1, 1) AS digit, coalesce(regexp_matches(substr(text, 1, 200), '{licenses.TRIGGER}'), false) AS stands
  FROM documents),
files AS (SELECT doc_id, text, CASE WHEN NOT stands THEN leaf || '/' || doc_id || '.txt' WHEN digit < '2' THEN top || '/LICENSE.' || doc_id WHEN digit < '6' THEN two || '/LICENSE.' || doc_id ELSE leaf || '/LICENSE.' || doc_id END AS path FROM placed),
lines AS (
  SELECT path, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{licenses.TRIGGER}')) AS ls,
    array_to_string(list_filter(regexp_split_to_array(text, '\n(?:[^\p{{L}}\p{{N}}\n]*\n)+'), lambda x: regexp_matches(x, '{licenses.STRETCH}')), ' ') AS block
  FROM files WHERE regexp_matches(text, '{licenses.TRIGGER}')),
wholes AS (SELECT path, ls, CASE WHEN regexp_matches(regexp_replace(path, '^.*/', ''), '{licenses.LICENCE_FILE}') THEN [block, text] ELSE [block] END AS blocks FROM lines),
units AS (SELECT path, unnest(range(len(blocks) + len(ls))) - len(blocks) AS unit, unnest(list_concat(blocks, ls)) AS text FROM wholes),
counted AS (SELECT path, unit, term, count(*) AS tf FROM (SELECT path, unit, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM units) GROUP BY ALL),
tfidf AS (SELECT path, unit, term, tf * coalesce(idf, {unseen!r}::DOUBLE) AS v FROM counted LEFT JOIN idf USING (term)),
norms AS (SELECT path, unit, sqrt(sum(v * v)) AS norm FROM tfidf GROUP BY ALL),
dots AS (SELECT path, unit, template, licence, sum(v * weight) AS dot FROM tfidf JOIN vectors USING (term) GROUP BY ALL),
scored AS (SELECT path, unit >= 0 AS line, licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (path, unit)),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, score DESC, licence) AS k FROM scored WHERE score >= {licenses.LEAST}),
own AS (SELECT path, licence, score FROM best WHERE k = 1),
declared AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, licence AS inherited,
         row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, licence) AS k
  FROM own WHERE regexp_matches(regexp_replace(path, '^.*/', ''), '{licenses.LICENCE_FILE}')),
climbs AS (SELECT path, above, inherited, row_number() OVER (PARTITION BY path ORDER BY length(above) DESC) AS k
  FROM files JOIN declared ON declared.k = 1 AND starts_with(path, above || '/')),
nearest AS (SELECT path, above, inherited FROM climbs WHERE k = 1)
SELECT files.doc_id, files.path, licence, score, CASE WHEN licence IS NULL THEN inherited END AS inherited, CASE WHEN licence IS NULL THEN above END AS from_dir, coalesce(licence, inherited) AS effective
FROM files LEFT JOIN own USING (path) LEFT JOIN nearest USING (path)
"""


SQL = {
    "op1_license_scan": _license_sql(),
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM src),
weighted AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM placed),
levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
           - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER ()
           - coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM weighted),
marked AS (SELECT *, left_words * weight >= 2 * source_size * left_weight AS capped FROM levels),
water AS (SELECT left_words / left_weight AS water FROM marked WHERE NOT capped ORDER BY source_size / weight, place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE weight * (SELECT water FROM water) END AS target,
         (('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT >> 8) AS start
  FROM marked),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size = 0 THEN 0 ELSE round(t.target / t.source_size * 16777216) END::BIGINT AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((((start + rate * (place + 1)) >> 24) - ((start + rate * place) >> 24)) * size)::BIGINT AS taken,
       (((start + rate * (place + 1)) >> 24) - ((start + rate * place) >> 24))::INTEGER AS copies
FROM rated
""",
    "op4_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON low.x = vec_id LEFT JOIN deg ON deg.x = vec_id
""",
    "op5_spotsigs": rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS after, first(coalesce(text, '')) OVER (ORDER BY doc_id) AS top FROM documents),
edits AS (SELECT doc_id, length(text) AS n, text, coalesce(after, top) AS following, left(text, (length(text) - length(text) // 4)::INT) || left(coalesce(after, top), (length(text) // 4)::INT) AS edited FROM base),
texts AS (SELECT doc_id, 0 AS kind, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits UNION ALL SELECT doc_id, 2, following FROM edits),
words AS (SELECT doc_id, kind, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM texts),
content AS (SELECT *, list_transform(w, lambda x: CASE WHEN x IN ({spotsigs._STOP}) THEN NULL ELSE x END) AS z FROM words),
spots AS (
  SELECT doc_id, kind, list_filter([left(md5(CASE WHEN z[i] IS NULL THEN
      CASE WHEN i = len(w) THEN w[i] WHEN z[i + 1] IS NOT NULL THEN concat_ws(' ', w[i], z[i + 1], coalesce({", ".join(f"z[i + {k}]" for k in range(2, spotsigs.REACH + 2))})) END
    WHEN (i = 1 OR z[i - 1] IS NOT NULL) AND (i < 3 OR z[i - 2] IS NOT NULL) THEN concat_ws(' ', w[i], w[i + 1]) END), {spotsigs.DIGITS}) FOR i IN range(1, len(w) + 1)], lambda x: x IS NOT NULL) AS g
  FROM content),
sets AS (SELECT doc_id, kind, list_sort(list_distinct(g)) AS s FROM spots),
wide AS (SELECT doc_id, max(s) FILTER (kind = 0) AS a, max(s) FILTER (kind = 1) AS b, max(s) FILTER (kind = 2) AS c FROM sets GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN a = b THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END::DOUBLE AS near_edited,
       CASE WHEN a = c THEN 1.0 WHEN len(a) = 0 OR len(c) = 0 THEN 0.0 ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END::DOUBLE AS near_next
FROM edits JOIN wide USING (doc_id)
""",
    "op7_substring_dedup": r"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS name FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)),
firsts AS (SELECT name, min(doc_id) AS first FROM windows GROUP BY name),
hits AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (name) WHERE doc_id > first),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM hits),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
""",
    "op8_warc_round_trip": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
""",
}
