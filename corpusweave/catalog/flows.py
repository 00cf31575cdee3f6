"""Queries over whole chains of operators."""

from pyspark.sql import functions as F

from ..plans import correction, corpus, mining
from .base import PAIRS, RUNS, docs, pairs, query, runs, sql_adler32, sql_shuffle_rank, sql_words
from .vectors import _CENTRES, _FUSED, _KNN, _model, _vectors

_BUCKET = sql_adler32("source || ' '")

_CORPUS = f"""u AS (SELECT *, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY {sql_shuffle_rank(4, 'doc_id')}) AS rn FROM documents),
c AS (SELECT doc_id, lang, text, CASE WHEN {_BUCKET} % 100 < 10 THEN 'test' WHEN {_BUCKET} % 100 >= 20 THEN 'train' ELSE 'valid' END AS split,
  {sql_shuffle_rank(4, 'doc_id')} % 8 AS pos FROM u WHERE rn = 1)"""


def _prepared(spark, sf):
    d = docs(spark, sf).withColumn("repo", F.concat("repo", F.lit(" ")))
    return corpus.prepare_corpus(d, "doc_id", "text", "repo", ["lang"], 4, 10, 10, 8)


@query("prepare_corpus", f"WITH {_CORPUS} SELECT doc_id, lang, split, CASE WHEN split = 'train' THEN pos ELSE 0 END AS shard FROM c")
def _(spark, sf):
    return _prepared(spark, sf).select("doc_id", "lang", "split", "shard")


@query("indexed_corpus", f"""
WITH {_CORPUS}, t AS (SELECT doc_id, split, unnest(range(len({sql_words('text')}))) AS i, unnest({sql_words('text')}) AS token FROM c),
v AS (SELECT token, (row_number() OVER (ORDER BY count(*) DESC, token) + 513)::INT AS id FROM t WHERE split = 'train' GROUP BY token ORDER BY count(*) DESC, token LIMIT 20000),
x AS (SELECT doc_id, string_agg(coalesce(id, 3)::VARCHAR, ' ' ORDER BY i) AS ids FROM t LEFT JOIN v USING (token) GROUP BY doc_id)
SELECT doc_id, CASE WHEN ids IS NULL THEN '1' ELSE ids || ' 1' END AS ids FROM c LEFT JOIN x USING (doc_id)""")
def _(spark, sf):
    _known, indexed = corpus.index_splits(_prepared(spark, sf), "doc_id", "text", 20_000)
    return indexed.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("translation_pairs", f"""
WITH {RUNS}, b AS (SELECT func_id, code FROM (SELECT *, row_number() OVER (PARTITION BY func_id ORDER BY length(code), beam) AS rn FROM runs WHERE status = 'success') WHERE rn = 1)
SELECT func_id, 'java' AS lang1, 'python' AS lang2, sha256(d.text) AS text1, b.code AS text2 FROM b JOIN documents d ON d.doc_id = b.func_id""")
def _(spark, sf):
    functions = docs(spark, sf).select(F.col("doc_id").alias("func_id"), F.sha2("text", 256).alias("code"))
    return mining.translation_pairs(functions, runs(spark, sf), "java", "python")


@query("correction_pairs", f"""
WITH {RUNS}, s AS (SELECT func_id, arg_min(code, beam) AS success FROM runs WHERE status = 'success' GROUP BY func_id),
p AS (SELECT f.func_id, f.beam, f.code AS failure, s.success FROM runs f JOIN s USING (func_id) WHERE f.status = 'failure' AND trim(f.code) <> trim(s.success)),
u AS (SELECT *, row_number() OVER (PARTITION BY sha256(failure || success) ORDER BY func_id, beam) AS rn FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY func_id, beam) - 1 AS i FROM u WHERE rn = 1)
SELECT func_id, beam AS failed_beam, failure, success, CASE WHEN i < floor(0.6 * (SELECT count(*) FROM k)) THEN 'train' ELSE 'test' END AS split FROM k""")
def _(spark, sf):
    return mining.correction_pairs(runs(spark, sf)).select("func_id", "failed_beam", "failure", "success", "split")


@query("small_datastores", f"""
WITH {PAIRS}, p AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY language_pair, sha256(source || target) ORDER BY pair_id) = 1),
cut AS (SELECT pair_id, language_pair, source, {sql_words('target')}[1:least(512, 3 * (len({sql_words('source')}) + 2) + 10) - 1] AS t FROM p),
store AS (SELECT pair_id, language_pair, source, t, unnest(range(len(t) + 1)) AS pos FROM cut),
w AS (SELECT {sql_words('source')} AS f, t[1:pos] AS s FROM store),
c AS (SELECT DISTINCT array_to_string(CASE WHEN len(s) <= 4 THEN f ELSE f[len(s) - 3:len(s) + 4] END, ' ') AS f, array_to_string(CASE WHEN len(s) <= 4 THEN s ELSE s[-4:] END, ' ') AS s FROM w WHERE len(f) > 0)
SELECT 'eos' AS part, count(*) AS n FROM store WHERE pos = len(t)
UNION ALL SELECT 'pre_eos', count(*) FROM store WHERE pos = len(t) - 1
UNION ALL SELECT 'fragments', count(*) FROM c WHERE f <> ''""")
def _(spark, sf):
    unique = correction.unique_pairs(pairs(spark, sf))
    parts = correction.small_datastores(correction.datastore_from_unique(unique), unique)
    counts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("corrected_tokens", f"""
WITH {_KNN}, {_CENTRES}, {_FUSED} SELECT query_id, token, round(score, 6) AS score FROM best WHERE rank = 1""")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    best = correction.corrected_tokens(queries, store, _model(spark, sf))
    return best.select("query_id", "token", F.round("score", 6).alias("score"))
