"""Registry of runnable queries, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` must give the same columns and values in DuckDB."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Tables whose rows are long enough that the work per row outweighs one small shuffle.
LONG_ROWS = {"documents", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG_ROWS else df


# Shared inputs, once as DataFrames and once as SQL text.

DOCS = "docs AS (SELECT doc_id, text, lang, source, lang || '/' || source AS repo, n_chars FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a repository name; `lang/source` plays owner/name."""
    return table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", "lang", "source"))


PAIRS = """pairs AS (
  SELECT a.conv_id * 1000000 + a.turn AS pair_id, a.role || '_' || b.role AS language_pair,
         a.text AS source, b.text AS target
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns as (source, target). An equi-join on (conversation, turn) has no hot
    key, where a window per conversation would."""
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("role2"), F.col("text").alias("target"))
    return turns.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pair_id"),
        F.concat_ws("_", "role", "role2").alias("language_pair"),
        F.col("text").alias("source"),
        "target",
    )


STATUS = """CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure'
  WHEN 'view' THEN 'timeout' ELSE 'compile_error' END"""

RUNS = f"""runs AS (
  SELECT event_id // 5 AS func_id, (event_id % 5)::INT AS beam, {STATUS} AS status, value,
         event_type || ' ( ' || props || ' )' AS code, event_type AS lang
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test runs: five neighbouring events are the five candidates of a function."""
    status = (
        F.when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "error", "failure")
        .when(F.col("event_type") == "view", "timeout")
        .otherwise("compile_error")
    )
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 5).alias("func_id"),
        (F.col("event_id") % 5).cast("int").alias("beam"),
        status.alias("status"),
        "value",
        F.concat("event_type", F.lit(" ( "), "props", F.lit(" )")).alias("code"),
        F.col("event_type").alias("lang"),
    )


# SQL text of helper expressions

#: Tokens between Unicode white space, as `functions.text.words`.
_WORD = r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_words(column: str) -> str:
    return f"regexp_extract_all({column}, '{_WORD}')"


def sql_uniform(seed, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT / 4294967296.0)"


def sql_shuffle_rank(seed, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5({parts}), 1, 15))::BIGINT"


def sql_adler32(column: str) -> str:
    size = f"octet_length(encode({column}))"
    byte = f"('0x' || substr(hex(encode({column})), 2 * i - 1, 2))::BIGINT"
    low = f"((1 + list_sum([{byte} FOR i IN range(1, {size} + 1)])) % 65521)"
    high = f"(({size} + list_sum([{byte} * ({size} - i + 1) FOR i IN range(1, {size} + 1)])) % 65521)"
    return f"({high} * 65536 + {low})::BIGINT"


TOKENS = f"""doc_tokens AS (SELECT doc_id, lang, {sql_words('text')} AS tokens FROM documents)"""

VOCAB = """counts AS (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM doc_tokens) GROUP BY token),
vocab AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 513)::INT AS id, count FROM
  (SELECT * FROM counts ORDER BY count DESC, token LIMIT 64000))"""


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import words

    return table(spark, sf_dir, "documents").select("doc_id", "lang", words("text").alias("tokens"))
