"""Queries over sources and sinks: tables written as files in a scratch folder, read back."""

from pyspark.sql import functions as F

from ..functions.hashing import shuffle_rank
from ..functions.text import words
from ..operators import ordering, splits
from ..session import scratch_path
from ..sources import lines, tables
from ..streaming import ingest
from .base import PAIRS, docs, pairs, query, sql_shuffle_rank, sql_words, table


def _dump(df, spark, name, folder="en.000.json"):
    path = scratch_path(spark, name)
    lines.write_lines(df, f"{path}/{folder}")
    return path


@query("read_code_json", "SELECT lang || '/' || source AS repo_name, text AS content FROM documents WHERE n_chars > 300")
def _(spark, sf):
    """A third kind of line is broken JSON and must vanish."""
    record = F.to_json(F.struct(F.col("repo").alias("repo_name"), F.col("text").alias("content")))
    broken = F.when(F.col("n_chars") > 300, record).otherwise(F.concat(F.lit("{broken "), F.col("doc_id")))
    path = _dump(docs(spark, sf).select(broken.alias("value")), spark, "dump")
    return lines.read_code_json(spark, f"{path}/*").select("repo_name", "content")


@query("read_lines_numbered", """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id FROM documents""")
def _(spark, sf):
    path = scratch_path(spark, "numbered")
    ordered = docs(spark, sf).select("doc_id").orderBy("doc_id")
    lines.write_lines(ordered.select(F.col("doc_id").cast("string").alias("value")), path)
    numbered = ordering.with_row_index(lines.read_lines(spark, path), lines.LINE, "position")
    return numbered.select(F.col("position").alias("line_no"), F.col("value").cast("long").alias("doc_id"))


@query("zip_lines", """
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, sha256(text) AS source FROM documents),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, 'q' || quality AS target FROM labels)
SELECT i AS pair_id, source, target FROM a JOIN b USING (i)""")
def _(spark, sf):
    left = lines.numbered(docs(spark, sf).withColumn("v", F.sha2("text", 256)), ["doc_id"], "v")
    right = lines.numbered(table(spark, sf, "labels").withColumn("v", F.concat(F.lit("q"), "quality")), ["doc_id"], "v")
    return lines.zip_lines(left, right)


@query("read_id_lines", "SELECT source || ' | ' || replace(text, chr(10), ' ') AS code FROM documents WHERE NOT contains(text, chr(13))")
def _(spark, sf):
    flat = F.concat_ws(" | ", F.col("doc_id").cast("string"), "source", F.replace("text", F.lit("\n"), F.lit(" ")))
    path = _dump(docs(spark, sf).filter(~F.col("text").contains("\r")).select(flat.alias("value")), spark, "ids", "functions.tok")
    return lines.read_id_lines(spark, f"{path}/*").select("code")


@query("read_reports", """
SELECT 'CLASS_' || event_id AS "TARGET_CLASS", value AS "MutationScore", event_type AS folder FROM events""")
def _(spark, sf):
    path = scratch_path(spark, "reports")
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("CLASS_"), "event_id").alias("TARGET_CLASS"), F.col("value").alias("MutationScore"),
        F.lit(0.5).alias("LineCoverage"), F.lit(0.5).alias("BranchCoverage"), "event_type",
    )
    for kind in ("view", "click", "purchase", "signup", "error"):
        rows.filter(F.col("event_type") == kind).drop("event_type").write.csv(f"{path}/{kind}", header=True)
    return lines.read_reports(spark, f"{path}/*").select("TARGET_CLASS", "MutationScore", "folder")


@query("read_unit_tests", """
SELECT 'CLASS_' || event_id AS "TARGET_CLASS", value AS mutation_score FROM events WHERE event_type IN ('click', 'purchase')""")
def _(spark, sf):
    kind = F.col("event_type")
    record = F.to_json(F.struct(
        F.concat(F.lit("CLASS_"), "event_id").alias("TARGET_CLASS"),
        F.when(kind == "view", "missing").otherwise(F.col("props")).alias("tests_strings"),
        F.col("value").alias("mutation_score"),
        F.when(kind == "error", "try assert x").when(kind == "signup", "pass").otherwise("assert x").alias("python_translated_tests"),
    ))
    path = _dump(table(spark, sf, "events").select(record.alias("value")), spark, "tests", "tests.json")
    return lines.read_unit_tests(spark, f"{path}/*").select("TARGET_CLASS", "mutation_score")


@query("read_text_vectors", """
SELECT 'w' || label AS word, round(arg_min(embedding[1], vec_id)::DOUBLE, 4) AS x0 FROM embeddings GROUP BY label""")
def _(spark, sf):
    """Labels repeat, so only the first vector of a label stays; short rows must vanish."""
    row = F.concat_ws(" ", F.concat(F.lit("w"), "label"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("at"), row.alias("value"))
    extra = spark.createDataFrame([(-2, "0 64"), (-1, "short 1.0 2.0")], "at long, value string")
    path = scratch_path(spark, "vectors")
    lines.write_lines(extra.unionByName(e).orderBy("at").select("value"), path, "none")
    vectors = lines.read_text_vectors(spark, path, 64)
    return vectors.select("word", F.round(F.col("vector")[0].cast("double"), 4).alias("x0"))


@query("read_vocab", f"""
WITH t AS (SELECT unnest({sql_words('text')}) AS token FROM documents), c AS (SELECT token, count(*) AS count FROM t GROUP BY token)
SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 513)::INT AS id, count FROM c WHERE NOT contains(token, chr(8232))""")
def _(spark, sf):
    tokens = docs(spark, sf).select(F.explode(words("text")).alias("token"))
    counts = tokens.groupBy("token").count().orderBy(F.desc("count"), "token")
    path = scratch_path(spark, "vocab")
    lines.write_lines(counts.select(F.concat_ws(" ", "token", "count").alias("value")), path)
    return lines.read_vocab(spark, path)


@query("parse_retrieval_dump", f"""
WITH {PAIRS}, c AS (SELECT pair_id, regexp_replace(source, '[^\\pL\\pN ]', '', 'g') AS s, regexp_replace(target, '[^\\pL\\pN ]', '', 'g') AS t FROM pairs)
SELECT pair_id, 0 AS pos, trim(s) AS source, trim(t) AS prefix FROM c""")
def _(spark, sf):
    plain = lambda c: F.regexp_replace(c, r"[^\pL\pN ]", "")
    dump = F.concat(F.lit("[[array(['"), plain("source"), F.lit("', '"), plain("target"), F.lit("</s>'], dtype='<U9')]]"))
    return lines.parse_retrieval_dump(pairs(spark, sf).select("pair_id", dump.alias("dump")), "pair_id", "dump")


@query("write_splits", f"""
SELECT doc_id, lang, 'train' AS split, 'sa' AS suffix, ({sql_shuffle_rank(2, 'doc_id')} % 4)::INT AS shard FROM documents""")
def _(spark, sf):
    placed = splits.shard(docs(spark, sf).withColumn("pos", shuffle_rank(2, "doc_id")), 4, "pos")
    path = scratch_path(spark, "splits")
    tables.write_splits(placed.select("doc_id", "lang", F.lit("train").alias("split"), F.lit("sa").alias("suffix"), "shard"), path)
    return spark.read.parquet(path)


@query("skip_done_inputs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return tables.not_done(docs(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


_STREAM_SCHEMA = "doc_id long, lang string, text string"


@query("ingest_new_files", "SELECT doc_id, lang, sha256(text) AS id FROM documents")
def _(spark, sf):
    """Two arrivals of files, two runs: every document is processed exactly once."""
    path = scratch_path(spark, "stream")
    d = docs(spark, sf).select("doc_id", "lang", "text")
    for langs in (["en"], ["de", "es", "fr"]):
        d.filter(F.col("lang").isin(langs)).write.mode("append").json(f"{path}/in")
        ingest.ingest_new(
            spark, f"{path}/in", f"{path}/out", f"{path}/log", _STREAM_SCHEMA,
            transform=lambda rows: rows.select("doc_id", "lang", F.sha2("text", 256).alias("id")),
        )
    return spark.read.parquet(f"{path}/out")


@query("ingest_distinct_files", "SELECT lang, sha256(text) AS content_hash FROM documents GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "distinct")
    d = docs(spark, sf).select("doc_id", "lang", "text")
    for langs in (["en", "de"], ["en", "es", "fr"]):  # the English files arrive twice
        d.filter(F.col("lang").isin(langs)).write.mode("append").json(f"{path}/in")
        ingest.ingest_distinct(spark, f"{path}/in", f"{path}/out", f"{path}/log", _STREAM_SCHEMA, "text", "doc_id", ["lang"])
    return spark.read.parquet(f"{path}/out").select("lang", "content_hash")
