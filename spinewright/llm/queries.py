"""The operators' queries, each over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinewright.core import read, shared_root
from spinewright.llm import alignment, decontaminate, fim, html_text, imatch, mixing, pii, quality, sharding, simhash, token_counts, toxicity, warc


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.with_score(docs.select("doc_id", "text"), toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.apply_edits(token_counts.sample_edits(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op7_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_root(spark)}/spinewright/warc-{uuid.uuid4().hex}"
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.against_edits(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_divergence, op3_string_kernel, op4_kd_sharding, op5_edit_counts, op6_weak_supervision,
        op7_simhash_variants, op8_consensus_paths, op9_winnowing, op10_warc_store, op11_imatch, op12_alignment,
        op13_fill_in_middle,
    )
}
_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
r AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER u, 0) AS left2, sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS weight_left
      FROM w WINDOW u AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * left2 >= 4 * source_size * weight_left AS clamped FROM r),
g AS (SELECT *, max(CASE WHEN NOT clamped THEN left2 END) OVER () AS open2, max(CASE WHEN NOT clamped THEN weight_left END) OVER () AS open_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN clamped THEN (2 * source_size)::DOUBLE ELSE (weight * open2)::DOUBLE / (2 * open_weight)::DOUBLE END AS target FROM g),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
q AS (SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN words // p.source_size ELSE 0 END AS whole, words,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, words - whole * source_size - before)))::BIGINT AS taken FROM q
"""

_WINDOW_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dw AS (SELECT k, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT dw.k, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
c AS (SELECT k, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT k, unnest(generate_series(p, p + n - 1)) AS x FROM h) GROUP BY k),
m AS (SELECT k, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN m USING (k)
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS kept FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN kept IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to FROM f
"""

_COMMON = sorted({w for words in quality.COMMON.values() for w in words.split()})
_COMMON_ROWS = ", ".join(f"('{w}', {i})" for i, w in enumerate(_COMMON, 1))
_QUALITY_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce('l' || lang, 'none') AS key, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM (SELECT k, unnest(generate_series(1, len(w) - 2)) AS i, unnest(list_transform(generate_series(1, len(w) - 2), lambda y: w[y] || ' ' || w[y + 1] || ' ' || w[y + 2])) AS g FROM d)),
r AS (SELECT k, count(DISTINCT x) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS x FROM g WHERE n > 1) GROUP BY 1),
b AS MATERIALIZED (SELECT d.k, doc_id, key, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (k)),
f AS MATERIALIZED (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM b),
c0 AS (SELECT k, greatest(1, length(t)) AS n, [length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')),
  length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')), length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))] AS c, length(t) AS whole FROM d),
shares AS MATERIALIZED (
  SELECT 'class' AS kind, k, i, list_append(c, whole - list_sum(c)::BIGINT)[i]::DOUBLE / n AS p FROM c0, generate_series(1, 7) AS s(i)
  UNION ALL SELECT 'common', f.k, i, coalesce(m.n, 0)::DOUBLE / greatest(1, n_words) FROM f CROSS JOIN generate_series(0, {len(_COMMON)}) AS s(i)
  LEFT JOIN (SELECT k, coalesce(v.i, 0) AS i, sum(n) AS n FROM (SELECT k, lower(trim(x, '.,;:!?"''()[]')) AS x, count(*) AS n FROM (SELECT k, unnest(w) AS x FROM d) GROUP BY 1, 2) LEFT JOIN (VALUES {_COMMON_ROWS}) AS v(word, i) ON word = x GROUP BY 1, 2) m USING (k, i)),
j AS (SELECT kind, k, i, p, key, n_words >= CASE kind WHEN 'class' THEN {quality.MIN_CLASS_WORDS} ELSE {quality.MIN_COMMON_WORDS} END AS enough, base_failed FROM shares JOIN f USING (k)),
q AS (SELECT kind, key, i, avg(p) AS q FROM j WHERE enough AND NOT base_failed GROUP BY 1, 2, 3 HAVING count(*) >= {quality.MIN_REFERENCE_TEXTS}),
x AS MATERIALIZED (SELECT kind, k, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM j JOIN q USING (kind, key, i) WHERE enough GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(a.x, 6) AS class_distance, round(o.x, 6) AS common_distance,
  NOT base_failed AND NOT coalesce(a.x > {quality.CLASS_LIMIT}::DOUBLE, false) AND NOT coalesce(o.x > {quality.COMMON_LIMIT}::DOUBLE + 0.6::DOUBLE / sqrt(greatest(1, n_words)), false) AS kept
FROM f LEFT JOIN x a ON a.k = f.k AND a.kind = 'class' LEFT JOIN x o ON o.k = f.k AND o.kind = 'common'
"""

_FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
h AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d),
k AS (SELECT doc_id, t, u, h, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM h),
c AS (SELECT doc_id, t, len(u)::BIGINT AS n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM c
"""

ORACLES: dict[str, str] = {
    "op2_divergence": _QUALITY_SQL, "op1_mixing": _MIX_SQL, "op9_winnowing": _WINDOW_SQL, "op10_warc_store": _WARC_SQL,
    "op13_fill_in_middle": _FIM_SQL,
}
