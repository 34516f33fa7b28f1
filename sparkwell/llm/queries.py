"""Queries of the corpus operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    html_text,
    license_scan,
    line_dedup,
    packing,
    quality_rules,
    rans_tokens,
    simhash_dedup,
    source_divergence,
    suffix_dedup,
    toxicity,
    warc_audit,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which some records are damaged: a byte
    more (page_id mod 97 = 5), lost (mod 193 = 7) or new (negative ids)."""
    pages = _table(spark, sf_dir, "pages")
    key = F.col("page_id")
    primary = pages.select(key.alias("record_id"), warc_audit.warc_record(key, F.col("url"), F.col("html")).alias("record"))
    damaged = F.when(F.pmod("record_id", F.lit(97)) == 5, F.concat("record", F.lit(b"!"))).otherwise(F.col("record"))
    replica = primary.where(F.pmod("record_id", F.lit(193)) != 7).select("record_id", damaged.alias("record"))
    new = pages.where(F.pmod(key, F.lit(389)) == 11)
    new = new.select((-key).alias("record_id"), warc_audit.warc_record(-key, F.col("url"), F.lit("")).alias("record"))
    return warc_audit.audit(primary, replica.unionByName(new))


def op3_rans_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.token_digest(rans_tokens.round_trip(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack(_table(spark, sf_dir, "documents")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digest(suffix_dedup.without_repeats(_table(spark, sf_dir, "documents")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "window_start")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree: each block of 50 ids is a
    directory, below its thousand; the first of a block is a licence file, of
    the block or, where it begins a thousand, of the whole thousand."""
    key = F.col("doc_id")
    thousand, block = F.floor(key / 1000).cast("string"), F.floor(key / 50).cast("string")
    path = (
        F.when(F.pmod(key, F.lit(1000)) == 0, F.concat(thousand, F.lit("/LICENSE")))
        .when(F.pmod(key, F.lit(50)) == 0, F.concat(thousand, F.lit("/"), block, F.lit("/LICENSE")))
        .otherwise(F.concat(thousand, F.lit("/"), block, F.lit("/"), key.cast("string"), F.lit(".txt")))
    )
    files = _table(spark, sf_dir, "documents").select(key.alias("file_id"), path.alias("path"), "text")
    return license_scan.licences(files).withColumnRenamed("file_id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(line_dedup.dedup(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_warc_fixity_audit": op2_warc_fixity_audit,
    "op3_rans_token_blocks": op3_rans_token_blocks,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_main_text": op6_html_main_text,
    "op7_sum_of_squares_packing": op7_sum_of_squares_packing,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_fixity_audit": """
WITH rec AS (
  SELECT page_id AS record_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT record_id, record, strlen(record)::BIGINT AS length,
    coalesce(sum(strlen(record)) OVER (ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM rec)
SELECT record_id, "offset", length, CASE WHEN record_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS fault,
  sha256(record) AS digest, CASE WHEN record_id % 193 = 7 THEN NULL ELSE sha256(record || '!') END AS replica_digest, 1::BIGINT AS copies
FROM placed WHERE record_id % 97 = 5 OR record_id % 193 = 7
UNION ALL
SELECT -page_id, NULL, NULL, 'extra', NULL, sha256(
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || (-page_id) || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: 0' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)), 1
FROM pages WHERE page_id % 389 = 11
""",
    # All pages of the tables mark their article and hold only these tags in it.
    "op6_html_main_text": r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
""",
    # Every window of 200 bytes, compared by its MD5 digest.
    "op8_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) x, strlen(coalesce(text, '')) n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) h FROM d, unnest(range(0, greatest(0, n - 199))) r(i)),
m AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END new FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM g),
s AS (SELECT doc_id, run, min(i) a, max(i) + 200 e FROM k GROUP BY 1, 2),
p AS (SELECT doc_id, run, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) f FROM s),
c AS (SELECT doc_id, sum(e - a) gone, count(*) spans, max(e) last, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) kept FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
""",
    # All windows of all documents that share a shingle with an item.
    "op10_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t-\r]+'), lambda x: x <> '') v FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t-\r]+'), lambda x: x <> '') v FROM benchmark),
t AS (SELECT doc_id, len(v) n_words, i - 1 pos, array_to_string(v[i:i + 4], ' ') s FROM d, unnest(range(1, len(v) - 3)) r(i)),
u AS (SELECT item_id, len(v) n, array_to_string(v[i:i + 4], ' ') s FROM b, unnest(range(1, len(v) - 3)) r(i)),
c AS (SELECT item_id, n, s, count(*) c FROM u GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, n_words, item_id, n, pos, s, c FROM t JOIN c USING (s)),
win AS (SELECT doc_id, item_id, st FROM (SELECT DISTINCT doc_id, item_id, n_words, n FROM hit), unnest(range(0, greatest(0, n_words - n) + 1)) r(st)),
shared AS (SELECT doc_id, item_id, st, s, any_value(n_words) n_words, any_value(n) n, least(count(*), any_value(c)) k FROM win JOIN hit USING (doc_id, item_id) WHERE pos BETWEEN st AND st + n - 5 GROUP BY 1, 2, 3, 4),
sim AS (SELECT doc_id, item_id, st, sum(k) / (least(any_value(n_words), any_value(n)) - 4 + any_value(n) - 4 - sum(k)) j FROM shared GROUP BY 1, 2, 3)
SELECT doc_id, item_id, j AS similarity, st::INT AS window_start FROM sim WHERE j >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY j DESC, st) = 1
""",
    # Every term with every group of its language.
    "op11_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, row_number() OVER () r,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT c FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) c FROM g JOIN k USING (lang) LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) p FROM f JOIN v USING (lang)),
lf AS (SELECT lang, term, sum(c)::HUGEINT c FROM f GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 5)) // (sum(c) OVER (PARTITION BY lang)::HUGEINT + 5 * v) q FROM lf JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' part, term item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr) QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM l),
c AS (SELECT k, max(doc_id) last FROM k WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, i, line, coalesce(last <> doc_id, false) gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1
""",
}
