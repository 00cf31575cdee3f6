"""Text files with exact line numbers, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.code import usable_test
from ..functions.text import split_id_line, words
from ..operators.vocab import FIRST_ORDINARY, LINE_SEPARATOR, RESERVED
from ..operators.ordering import with_row_index
from ..session import land

CODE_SCHEMA = "repo_name string, content string, _corrupt string"
UNIT_TEST_SCHEMA = "TARGET_CLASS string, tests_strings string, scaffoldings_strings string, mutation_score double, asserts int, python_translated_tests string, _corrupt string"
REPORT_SCHEMA = "TARGET_CLASS string, MutationScore double, LineCoverage double, BranchCoverage double"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) with zero-based numbers per file.

    Lines get their place inside each input block for free; blocks are few (one row each),
    so their running line counts give exact numbers without shuffling a line. The scan is
    fixed first, because block boundaries depend on the number of running executors."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )
    fixed = land(raw, "lines")
    blocks = fixed.groupBy("path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    numbered = fixed.join(starts, ["path", "__block"])
    return numbered.select("path", (F.col("__at") - F.col("__first") + F.col("__start")).alias("line_no"), "value")


def language_of(path: Column) -> Column:
    """`…/lang.NNN.json.gz` → `lang`."""
    return F.regexp_extract(path, r"([^/.]+)\.[^/]*$", 1)


def read_code_json(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, lang, repo_name, content) of JSON code dumps; malformed lines are dropped."""
    lines = read_lines(spark, path)
    parsed = lines.withColumn(
        "r", F.from_json("value", CODE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull())
    return good.select(
        F.concat_ws(":", "path", "line_no").alias("line_id"), language_of(F.col("path")).alias("lang"), "r.repo_name", "r.content"
    )


def read_id_lines(spark: SparkSession, path: str, mode: str = "rest") -> DataFrame:
    """`id | code` lines; see `split_id_line` for the modes."""
    return read_lines(spark, path).withColumn("code", split_id_line("value", mode)).drop("value")


def zip_lines(left: DataFrame, right: DataFrame, order: str = "line_no") -> DataFrame:
    """Line i of both sides as (pair_id, source, target); the longer side is cut."""
    a = left.select(F.col(order).alias("pair_id"), F.col("value").alias("source"))
    b = right.select(F.col(order).alias("pair_id"), F.col("value").alias("target"))
    return a.join(b, "pair_id")


def numbered(df: DataFrame, order: list, value: str) -> DataFrame:
    """(line_no, value) for a table that takes the place of a line file."""
    return with_row_index(df.select(*order, value), order, "line_no").select("line_no", F.col(value).alias("value"))


def read_reports(spark: SparkSession, path: str, schema: str = REPORT_SCHEMA) -> DataFrame:
    """All report CSVs as one table with their folder; rows without a class are dropped."""
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=False)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1)
    return rows.select("*", folder.alias("folder")).filter(F.col("TARGET_CLASS").isNotNull())


def read_unit_tests(spark: SparkSession, path: str) -> DataFrame:
    """Unit tests with known test text whose Python form is usable."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = spark.read.text(path).select(F.from_json("value", UNIT_TEST_SCHEMA, options).alias("r")).select("r.*")
    return rows.filter(
        F.col("_corrupt").isNull() & F.col("TARGET_CLASS").isNotNull()
        & (F.col("tests_strings") != "missing") & usable_test("python_translated_tests")
    ).drop("_corrupt")


LINE = ["path", "line_no"]  # order of lines when one file is stored as sorted parts


def _first_per_word(df: DataFrame, word: str) -> DataFrame:
    first = df.groupBy(word).agg(F.min(F.struct(*LINE)).alias("f")).select("f.*")
    return df.join(first, LINE, "left_semi")


def read_text_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(path, line_no, word, vector): the header `n dim` goes, rows of another dimension go,
    the first row of a word stays."""
    lines = read_lines(spark, path)
    header = lines.agg(F.min("path")).first()[0]
    body = lines.filter((F.col("path") != header) | (F.col("line_no") > 0))
    parts = F.split(F.rtrim("value"), " ")
    cells = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "")
    numbers = F.transform(cells, lambda x: x.try_cast("float"))
    vectors = body.select(*LINE, F.get(parts, F.lit(0)).alias("word"), numbers.alias("vector"))
    valid = vectors.filter((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull()))
    return _first_per_word(valid, "word")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id, count) of `word count` lines. Lines of another shape, with U+2028, and
    reserved or repeated words are skipped; later ids close the gaps."""
    lines = read_lines(spark, path)
    parts = words("value")
    shaped = lines.filter(
        ~F.col("value").contains(LINE_SEPARATOR) & (F.size(parts) == 2) & F.get(parts, F.lit(1)).rlike(r"^\d+$")
    )
    rows = shaped.select(*LINE, F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).cast("long").alias("count"))
    kept = _first_per_word(rows.filter(~F.col("token").isin(RESERVED)), "token")
    order = with_row_index(kept, LINE, "rank")
    return order.select("token", (F.col("rank") + FIRST_ORDINARY).cast("int").alias("id"), "count")


def parse_retrieval_dump(df: DataFrame, row_id: str, column: str, need_both: bool = False) -> DataFrame:
    """(row, pos, source, prefix) from printed `[[array(['source', 'prefix'], …` texts. A missing
    prefix is the empty string; with `need_both`, as for end rows, such entries go."""
    # fixed values: the printed form of an entry, its quotes and what stands between its parts
    clean = F.replace(F.col(column), F.lit("</s>"), F.lit(""))
    found = F.regexp_extract_all(clean, F.lit(r"(?s)\[\[array\(\[(.*?)\],"), F.lit(1))
    trim = lambda c: F.regexp_replace(c, r"^['\",\s]+|['\",\s]+$", "")
    parts = F.split("__m", r"\",|',|,\",")
    rows = df.select(row_id, F.posexplode(found).alias("pos", "__m")).withColumn("__p", parts)
    rows = rows.filter(F.size("__p") >= 2) if need_both else rows
    return rows.select(
        row_id, "pos", trim(F.get("__p", F.lit(0))).alias("source"),
        F.coalesce(trim(F.get("__p", F.lit(1))), F.lit("")).alias("prefix"),
    )


def write_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.text(path, compression=compression)


