"""The queries of the corpus operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exactdedup, jaccard, linededup, packing, quality, secretscan, sharding, tokenbin, toxicity
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, min_share=20)
    spans = F.transform("contaminated_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return marked.select("doc_id", *decontam.MADE, F.array_join(spans, ",").alias("hit_spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels)
    rows = docs.select("doc_id", "text", toxicity.held_out().alias("held_out"))
    return toxicity.score_toxicity(rows, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted", "n_matches")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(table(spark, sf_dir, "documents"), end_id=1)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secretscan.scan_secrets(docs).select("doc_id", *secretscan.MADE)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"), words=4, similarity=(85, 100))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    rows = docs.select("doc_id", "text", quality.held_out().alias("held_out"))
    return quality.score_quality(rows, model, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sharding, op3_toxicity, op4_best_fit_packing, op5_token_files, op6_secret_scan,
        op7_line_dedup, op8_ngram_jaccard, op9_quality, op10_exact_dedup,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM b WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n)),
hits AS (SELECT doc_id, item_id, r.n, i FROM runs r JOIN windows w ON r.w = w.w AND r.n = w.n),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY 1),
pieces AS (
  SELECT doc_id, k, ps[k] AS piece FROM (
    SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ps
      FROM documents WHERE doc_id IN (SELECT doc_id FROM places)))),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM pieces),
word_places AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p, b - length(piece) AS a, b FROM placed
  WHERE regexp_matches(piece, '^[^\x00-\x2F\x3A-\x60\x7B-\x7F]')),
hit_runs AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM (
    SELECT doc_id, a, b, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM word_places JOIN places USING (doc_id, p))
  GROUP BY doc_id, g),
hit_spans AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a) AS hit_spans FROM hit_runs GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN hit_spans USING (doc_id)
""",
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, trim({_LOWER.replace("coalesce(text, '')", "line")}, {_BLANKS}) AS key FROM l),
frequent AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(frequent.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE frequent.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN frequent USING (key) GROUP BY doc_id
""",
    "op8_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
g AS (SELECT x, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id LEFT JOIN g ON g.x = d.doc_id
""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
}
