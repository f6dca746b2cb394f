"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import byte_bpe, quality, sharding, tool_chat, toxicity
from seamline.llm.decontaminate import benchmark_matches
from seamline.llm.exact_dedup import exact_groups
from seamline.llm.fill_middle import fill_in_middle, restored
from seamline.llm.importance import resample
from seamline.llm.line_dedup import dedup_lines, digests
from seamline.llm.ngram_join import ngram_components
from seamline.llm.simhash import simhash_components
from seamline.llm.texts import held_out
from seamline.llm.token_counts import count_tokens
from seamline.session import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _classified(kind, spark: SparkSession, folder: str, least: float) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = kind.train(docs, table(spark, folder, "labels"))
    predicted = (F.col("score") >= least).cast("int").alias("predicted")
    return kind.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted)


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(quality, spark, folder, 0.3)


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(toxicity, spark, folder, 0.5)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    counted = count_tokens(table(spark, folder, "documents").select("doc_id", "text"), model)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


#: Shards of the registered placement.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id", "source"), SHARDS)


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return digests(kept, "text", "kept_sha256").select("doc_id", "n_lines", "n_dropped", "kept_sha256")


#: What the registered chat query takes turns as: an answer is a call of this tool with these arguments.
ANSWER = {"answer": {"role": ("string", True), "words": ("bigint", True), "text": ("string", True), "lead": ("string", False)}}


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """User and system turns are calls, which need the call two turns before; the next turn is the result."""
    turns = table(spark, folder, "conversations")
    name = F.format_string("%d:%d", "conv_id", "turn")
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    asked = turns.where("role <> 'assistant'").select(
        "conv_id",
        name.alias("call_id"),
        F.col("turn").alias("position"),
        F.lit("answer").alias("tool"),
        F.to_json(F.struct(F.col("text"), F.col("role"), words.alias("words"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(F.format_string("%d:%d", "conv_id", F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    answers = turns.where("role = 'assistant'").select(
        "conv_id", F.format_string("%d:%d", "conv_id", F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    formatted = tool_chat.format_calls(asked, answers, ANSWER)
    return formatted.withColumn("problems", F.concat_ws(",", "problems"))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.digested(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    turned = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")).withColumn("restored", restored())
    named = digests(digests(turned, "output", "output_sha256"), "restored", "restored_sha256")
    return named.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _bounded(query: Query) -> Query:
    """Batches sent to Python are bounded by bytes: a row is a whole text."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_quality, op2_ngram_join, op3_exact_dedup, op4_decontamination, op5_toxicity, _bounded(op6_token_counts),
        op7_sharding, op8_line_dedup, op9_chat_format, _bounded(op10_byte_bpe), _bounded(op11_fill_middle),
        _bounded(op12_simhash), _bounded(op13_resampling),
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_ngram_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS shingle FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.y, reached.other FROM reached JOIN links ON links.x = reached.doc_id
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY d.doc_id""",
    "op3_exact_dedup": """
WITH plain AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM plain WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, k, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_fill_middle": """
WITH keyed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM keyed
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
    # DuckDB has no crc32: it is computed for each distinct word from the table of its polynomial
    "op13_resampling": f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
), words AS (
  SELECT 'd' AS kind, doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), hexed AS (
  SELECT DISTINCT w, hex(encode(w)) AS h FROM words
), buckets AS (
  SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexed, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM words JOIN buckets USING (w) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals
), weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents LEFT JOIN weighed USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)""",
}
