"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Each query reads whole tables of ``sf_dir`` and gets its rows through its operator.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, embedding_dedup, importance, language_id, minhash_dedup, packing, quality, secret_scan, substring_dedup, token_shards, toxicity, url_filter
from .url_filter import DEFAULT_RULES, ORDER, SCALE, SYMBOLS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(batches):
        for batch in batches:
            rows = [secret_scan.digest(s) for s in batch.column("spans").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    return found.mapInArrow(digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_table(_table(spark, sf_dir, "documents"), vocabulary())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")), present_col="present")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filter, op2_secret_scan, op3_benchmark_decontamination, op4_best_fit_packing, op5_substring_dedup, op6_language_id, op7_embedding_near_dedup, op8_quality_classifier, op9_minhash_near_dedup, op10_token_shards, op11_toxicity, op12_importance_resampling, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in found}


def _url_sql() -> str:
    """The whole of op1: rules, both Markov models, the calibrated bound and the verdicts."""
    upper, lower_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{rule}', '{verdict}', '{host}', '{rule[len(host):]}')" for rule, verdict, host in DEFAULT_RULES)

    def smooth(count: str, total: str, kinds: str, shorter: str) -> str:
        return f"CASE WHEN {total} + {kinds} > 0 THEN ({count} + {kinds} * ({shorter})) / ({total} + {kinds})::DOUBLE ELSE {shorter} END"

    levels = []
    for n in range(1, ORDER + 2):
        lower = ("s.pa", "s.pb") if n > 1 else (f"1.0::DOUBLE / {SYMBOLS}",) * 2
        levels.append(f"""
c{n} AS MATERIALIZED (SELECT right(gram, {n}) AS g, left(right(gram, {n}), {n - 1}) AS context, sum(a) AS a, sum(b) AS b FROM counts WHERE a + b > 0 GROUP BY ALL),
x{n} AS MATERIALIZED (SELECT context, sum(a) AS ta, sum(b) AS tb, count(*) FILTER (a > 0) AS ka, count(*) FILTER (b > 0) AS kb FROM c{n} GROUP BY context),
l{n} AS MATERIALIZED (SELECT c.g, {smooth('c.a', 'x.ta', 'x.ka', lower[0])} AS pa, {smooth('c.b', 'x.tb', 'x.kb', lower[1])} AS pb
  FROM c{n} c JOIN x{n} x USING (context){f" JOIN l{n - 1} s ON right(c.g, {n - 1}) = s.g" if n > 1 else ""})""")
    micro = ", ".join(f"floor((ln(l{n}.pa) - ln(l{n}.pb)) * {SCALE})::BIGINT" for n in range(ORDER + 1, 0, -1))
    joins = " ".join(f"LEFT JOIN l{n} ON right(gram, {n}) = l{n}.g" for n in range(1, ORDER + 2))
    return f"""
WITH parsed AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower_case}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    '{"^" * ORDER}' || translate(coalesce(url, ''), '{upper}', '{lower_case}') AS text
  FROM pages),
rules(rule, verdict, name, prefix) AS (VALUES {rules}),
fitted AS (
  SELECT uid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parsed JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY uid),
judged AS MATERIALIZED (SELECT p.*, f.rule, f.verdict FROM parsed p LEFT JOIN fitted f USING (uid)),
grams AS MATERIALIZED (
  SELECT uid, verdict, substring(text, spot, {ORDER + 1}) AS gram
  FROM (SELECT uid, verdict, text, unnest(generate_series(1, length(text) - {ORDER})) AS spot FROM judged)),
counts AS MATERIALIZED (SELECT gram, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM grams GROUP BY gram),
{",".join(levels)},
known AS MATERIALIZED (SELECT gram, coalesce({micro}, 0) AS micro FROM counts {joins}),
scored AS MATERIALIZED (SELECT uid, floor(sum(micro)::DOUBLE / count(*))::BIGINT AS ratio FROM grams JOIN known USING (gram) GROUP BY uid),
rated AS (SELECT j.*, coalesce(s.ratio, 0) AS r FROM judged j LEFT JOIN scored s USING (uid)),
bound AS (SELECT (avg(r) FILTER (verdict = 'allow') + avg(r) FILTER (verdict = 'block')) / 2 AS bound FROM rated)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN coalesce(r >= bound, true) THEN 'allow' ELSE 'block' END) AS verdict
FROM rated, bound"""


#: op12 whole: every run of every text, a dictionary of distinct strings with their CRC-32, gains, weights, noise and ranks.
_IMPORTANCE_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
texts AS (
  SELECT row_number() OVER () AS uid, 's' AS side, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER () AS uid, 't', NULL, text FROM benchmark),
split AS MATERIALIZED (
  SELECT uid, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS MATERIALIZED (
  SELECT uid, side, array_to_string(w[i:i + n - 1], ' ') AS feature
  FROM (SELECT uid, side, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM split, (VALUES (1), (2), (3)) sizes(n))),
counted AS MATERIALIZED (SELECT feature, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM runs GROUP BY feature),
hashed AS MATERIALIZED (
  SELECT feature, s, t,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, steps.crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM counted, steps),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t, sum(sum(s)) OVER () AS all_s, sum(sum(t)) OVER () AS all_t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (all_t + 10000.0::DOUBLE))))::BIGINT AS gain FROM buckets),
dictionary AS MATERIALIZED (SELECT feature, gain FROM hashed JOIN gains USING (bucket)),
weighed AS (SELECT uid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN dictionary USING (feature) WHERE side = 's' GROUP BY uid),
scored AS MATERIALIZED (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (uid) WHERE side = 's'),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql(), "op12_importance_resampling": _IMPORTANCE_SQL}
