"""Queries over the datastore, batches and neighbour search."""

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.text import words
from ..operators import batching, datastore, fusion, ivf, joins, neighbours, vector_index, vocab
from ..sources import tables
from ..session import scratch_path
from .base import PAIRS, docs, pairs, query, sql_uniform, sql_words, table

_PAIR_VOCAB = """tok AS (SELECT unnest(""" + sql_words("target") + """) AS token FROM pairs),
counts AS (SELECT token, count(*) AS count FROM tok GROUP BY token ORDER BY count DESC, token LIMIT 64000),
vocab AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 513)::INT AS id FROM counts)"""

_STORE = f"""{_PAIR_VOCAB},
cut AS (SELECT pair_id, language_pair, source, {sql_words('target')}[1:least(512, 3 * (len({sql_words('source')}) + 2) + 10) - 1] AS t FROM pairs),
pos AS (SELECT pair_id, language_pair, source, t, unnest(range(len(t) + 1)) AS pos FROM cut),
store AS (SELECT pair_id, language_pair, source, pos::INT AS pos, CASE WHEN pos = len(t) THEN '</s>' ELSE t[pos + 1] END AS token,
  array_to_string(t[1:pos], ' ') AS prefix, CASE WHEN pos = len(t) THEN 1 ELSE v.id END AS value
  FROM pos LEFT JOIN vocab v ON v.token = CASE WHEN pos = len(t) THEN NULL ELSE t[pos + 1] END)"""


def _pair_vocab(p):
    return vocab.build_vocab(vocab.count_tokens(p, words("target")))


def _store(spark, sf):
    p = pairs(spark, sf)
    return datastore.build_datastore(p, _pair_vocab(p))


@query("build_datastore", f"""
WITH {PAIRS}, {_STORE} SELECT pair_id, language_pair, pos, token, value, sha256(source) AS source, prefix,
  round({sql_uniform('key', 'pair_id', 'pos')}, 9) AS key0 FROM store""")
def _(spark, sf):
    p = pairs(spark, sf)
    limit = F.size(words("target"))
    vectors = F.transform(F.sequence(F.lit(0), limit), lambda i: F.array(uniform("key", "pair_id", i), F.lit(0.0)))
    store = datastore.build_datastore(p.withColumn("features", vectors), _pair_vocab(p), features="features")
    return store.select(
        "pair_id", "language_pair", "pos", "token", "value", F.sha2("source", 256).alias("source"), "prefix",
        F.round(F.col("key")[0], 9).alias("key0"),
    )


@query("eos_rows", f"WITH {PAIRS}, {_STORE} SELECT pair_id, pos, prefix FROM store WHERE value = 1")
def _(spark, sf):
    return datastore.eos_rows(_store(spark, sf)).select("pair_id", "pos", "prefix")


@query("pre_eos_rows", f"""
WITH {PAIRS}, {_STORE}, n AS (SELECT *, lead(value) OVER (ORDER BY pair_id, pos) AS nxt FROM store)
SELECT pair_id, pos, value, prefix FROM n WHERE value <> 1 AND nxt = 1""")
def _(spark, sf):
    return datastore.pre_eos_rows(_store(spark, sf)).select("pair_id", "pos", "value", "prefix")


@query("eos_context", f"""
WITH {PAIRS}, {_STORE}, n AS (SELECT *, lead(value) OVER (ORDER BY pair_id, pos) AS nxt FROM store)
SELECT pair_id, pos, value FROM n WHERE nxt = 1 UNION ALL SELECT pair_id, pos, value FROM n WHERE value = 1""")
def _(spark, sf):
    return datastore.eos_context(_store(spark, sf)).select("pair_id", "pos", "value")


@query("fragment_pairs", f"""
WITH {PAIRS}, {_STORE}, w AS (SELECT {sql_words('source')} AS f, {sql_words('prefix')} AS s FROM store),
c AS (SELECT CASE WHEN len(s) <= 4 THEN f ELSE f[len(s) - 3:len(s) + 4] END AS f, CASE WHEN len(s) <= 4 THEN s ELSE s[-4:] END AS s FROM w WHERE len(f) > 0)
SELECT DISTINCT array_to_string(f, ' ') AS fail_fragment, array_to_string(s, ' ') AS succ_fragment FROM c WHERE len(f) > 0""")
def _(spark, sf):
    return datastore.fragment_pairs_of(pairs(spark, sf))


@query("fragment_pairs_rows", f"""
WITH {PAIRS}, w AS (SELECT {sql_words('source')} AS f, {sql_words('target')} AS s FROM pairs),
c AS (SELECT CASE WHEN len(s) <= 4 THEN f ELSE f[len(s) - 3:len(s) + 4] END AS f, CASE WHEN len(s) <= 4 THEN s ELSE s[-4:] END AS s FROM w WHERE len(f) > 0)
SELECT DISTINCT array_to_string(f, ' ') AS fail_fragment, array_to_string(s, ' ') AS succ_fragment FROM c WHERE len(f) > 0""")
def _(spark, sf):
    """Rows that come as texts: each pair's source against its whole target."""
    return datastore.fragment_pairs(pairs(spark, sf).select(F.col("source").alias("fail_input"), F.col("target").alias("succ_prefix")))


@query("datastore_tables", f"""
WITH {PAIRS}, {_STORE} SELECT pair_id, pos, value, language_pair FROM store WHERE language_pair = 'user_assistant'""")
def _(spark, sf):
    path = scratch_path(spark, "datastore")
    tables.write_datastore(_store(spark, sf).select("pair_id", "pos", "value", "language_pair"), path)
    return tables.read_datastore(spark, path, "user_assistant")


_CODE = f"""code AS (SELECT doc_id, {sql_words('text')} AS w FROM documents)"""


@query("renumber_identifiers", f"""
WITH {_CODE}, o AS (SELECT doc_id, w, [CASE WHEN length(t) > 6 THEN 'FUNC_' || length(t) ELSE 'VAR_' || length(t) END FOR t IN w] AS names FROM code),
p AS (SELECT doc_id, unnest(range(len(names))) AS i, unnest(names) AS name FROM o),
f AS (SELECT doc_id, name, min(i) AS first FROM p GROUP BY doc_id, name),
n AS (SELECT doc_id, name, split_part(name, '_', 1) || '_' || (row_number() OVER (PARTITION BY doc_id, split_part(name, '_', 1) ORDER BY first) - 1) AS fresh FROM f)
SELECT doc_id, (SELECT string_agg(n.fresh || ' ;', ' ' ORDER BY p.i) FROM p JOIN n USING (doc_id, name) WHERE p.doc_id = c.doc_id) AS code,
  (SELECT string_agg(n.fresh || ' w' || n.name, ' | ' ORDER BY n.fresh) FROM n WHERE n.doc_id = c.doc_id) AS dictionary
FROM code c WHERE len(w) > 0""")
def _(spark, sf):
    name = lambda t: F.when(F.length(t) > 6, F.concat(F.lit("FUNC_"), F.length(t))).otherwise(F.concat(F.lit("VAR_"), F.length(t)))
    d = docs(spark, sf).withColumn("names", F.transform(words("text"), name)).filter(F.size("names") > 0)
    d = d.select(
        "doc_id", F.array_join(F.transform("names", lambda n: F.concat(n, F.lit(" ;"))), " ").alias("code"),
        F.array_join(F.transform(F.array_distinct("names"), lambda n: F.concat(n, F.lit(" w"), n)), " | ").alias("dictionary"),
    )
    return datastore.renumber_identifiers(d, "doc_id", "code", "dictionary")


# --- batches ---


@query("token_batches", f"""
WITH l AS (SELECT doc_id, len({sql_words('text')}) + 2 AS length FROM documents)
SELECT doc_id, length::INT AS length, (sum(length) OVER (ORDER BY length, doc_id ROWS UNBOUNDED PRECEDING) // 4000)::BIGINT AS batch FROM l""")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", F.size(words("text")).alias("n"))
    return batching.token_batches(d, "doc_id", ["n"], 4000).select("doc_id", "length", "batch")


@query("token_batches_pairs", f"""
WITH {PAIRS}, l AS (SELECT pair_id, len({sql_words('source')}) + len({sql_words('target')}) + 4 AS length FROM pairs)
SELECT pair_id, (sum(length) OVER (ORDER BY length, pair_id ROWS UNBOUNDED PRECEDING) // 2000)::BIGINT AS batch FROM l""")
def _(spark, sf):
    p = pairs(spark, sf).select("pair_id", F.size(words("source")).alias("a"), F.size(words("target")).alias("b"))
    return batching.token_batches(p, "pair_id", ["a", "b"], 2000).select("pair_id", "batch")


@query("count_batches", """
WITH n AS (SELECT count(*) AS n, ceil(count(*) / 300)::BIGINT AS k FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, (CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE (n % k) + (i - (n % k) * (n // k + 1)) // (n // k) END)::BIGINT AS batch FROM r, n""")
def _(spark, sf):
    return batching.count_batches(table(spark, sf, "events").select("event_id"), ["event_id"], 300)


@query("pack_stream", f"""
WITH w AS (SELECT doc_id, [(length(t) + 514)::INT FOR t IN {sql_words('text')}] || [1] AS ids FROM documents),
u AS (SELECT doc_id, unnest(range(len(ids))) AS i, unnest(ids) AS id FROM w),
o AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p0 FROM u),
z AS (SELECT count(*) AS n, ceil(count(*) / (8 * 256))::BIGINT AS nb FROM o),
s AS (SELECT id, p0 + nb * 8 * 256 - n AS p, nb * 256 AS lane_size FROM o, z UNION ALL SELECT 1, q, nb * 256 FROM z, LATERAL (SELECT unnest(range(nb * 8 * 256 - n)) AS q)),
c AS (SELECT id, p // lane_size AS lane, p % lane_size + 1 AS r FROM s WHERE p % lane_size + 1 < lane_size UNION ALL SELECT 1, unnest(range(8)), 0)
SELECT r // 256 AS block, lane, string_agg(id::VARCHAR, ' ' ORDER BY r) AS ids FROM c GROUP BY ALL""")
def _(spark, sf):
    ids = F.transform(words("text"), lambda t: F.length(t) + 514)
    packed = batching.pack_stream(docs(spark, sf).select("doc_id", ids.alias("ids")), ["doc_id"], "ids", 256, 8)
    return packed.select("block", "lane", F.array_join("ids", " ").alias("ids"))


@query("cap_by_tokens", f"""
WITH {PAIRS}, l AS (SELECT pair_id, greatest(len({sql_words('source')}), len({sql_words('target')})) AS l, row_number() OVER (ORDER BY pair_id) - 1 AS i FROM pairs),
m AS (SELECT pair_id, i, max(l) OVER (ORDER BY i) * (i + 1) AS used FROM l)
SELECT pair_id FROM m WHERE i < coalesce((SELECT min(i) FROM m WHERE used > 40000) - 1, 1000000000)""")
def _(spark, sf):
    p = pairs(spark, sf).select("pair_id", F.size(words("source")).alias("a"), F.size(words("target")).alias("b"))
    return batching.cap_by_tokens(p, ["pair_id"], F.col("a"), F.col("b"), 40_000).select("pair_id")


@query("replay_buffer", """
SELECT event_id % 500 AS slot, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY event_id % 500""")
def _(spark, sf):
    return batching.replay_buffer(table(spark, sf, "events").select("event_id", "props"), "event_id", 500).select("slot", "event_id", "props")


# --- neighbours: every vector is a query against the whole store ---

_KNN = """d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, b.label AS token,
  list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]) AS distance
  FROM embeddings a, embeddings b),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d QUALIFY rank <= 8)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    store = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").alias("token"))
    return queries, store


def _rounded(found):
    return found.select("query_id", "row_id", F.round("distance", 6).alias("distance"), "rank")


_KNN_SQL = f"WITH {_KNN} SELECT query_id, row_id, round(distance, 6) AS distance, rank::INT AS rank FROM knn"


@query("knn_exact", _KNN_SQL)
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    return _rounded(neighbours.knn_exact(queries, store, 8))


@query("knn_blocked", _KNN_SQL)
def _(spark, sf):
    """The path for query sets too large to broadcast."""
    queries, store = _vectors(spark, sf)
    return _rounded(neighbours.final_topk(neighbours.blocked_search(queries, store, 8), 8))


@query("knn_ivf_all_lists", _KNN_SQL)
def _(spark, sf):
    """Probing every list must give the exact result."""
    queries, store = _vectors(spark, sf)
    centroids = ivf.train_ivf(store, 16)
    postings = ivf.assign_lists(store.select("row_id", "vector"), centroids)
    return _rounded(ivf.knn_ivf(queries, postings, centroids, 8, 16))


@query("knn_ivf_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings")
def _(spark, sf):
    """Three quarters of the lists find nine of ten true neighbours."""
    queries, store = _vectors(spark, sf)
    centroids = ivf.train_ivf(store, 16)
    postings = ivf.assign_lists(store.select("row_id", "vector"), centroids)
    found = ivf.recall_at_k(ivf.knn_ivf(queries, postings, centroids, 8, 12), neighbours.knn_exact(queries, store, 8), 8)
    return found.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("knn_ivfpq", _KNN_SQL)
def _(spark, sf):
    """All lists and the rows that the codes' errors leave open: the exact result."""
    queries, store = (df.withColumn("language_pair", F.lit("all")) for df in _vectors(spark, sf))
    store = store.select("language_pair", "row_id", "vector")
    quantiser = vector_index.train_index(store, 16, 8, 16)
    found = vector_index.search_index(queries, vector_index.encode_rows(store, quantiser), quantiser, 8, 16, store)
    return _rounded(found)


_KNN_PAIR_SQL = """WITH v AS (SELECT vec_id, embedding, 'p' || (label % 3) AS pair FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, a.pair AS language_pair,
  list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) FOR i IN range(1, len(a.embedding) + 1)]) AS distance
  FROM v a JOIN v b ON a.pair = b.pair),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d QUALIFY rank <= 8)
SELECT query_id, row_id, round(distance, 6) AS distance, rank::INT AS rank FROM knn"""


def _vectors_by_pair(spark, sf):
    pair = F.concat(F.lit("p"), F.col("label") % 3)
    e = table(spark, sf, "embeddings").withColumn("language_pair", pair)
    queries = e.select(F.col("vec_id").alias("query_id"), "language_pair", F.col("embedding").alias("vector"))
    return queries, e.select("language_pair", F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))


@query("knn_by_pair", _KNN_PAIR_SQL)
def _(spark, sf):
    """Neighbours of the query's own language pair only."""
    queries, store = _vectors_by_pair(spark, sf)
    quantiser = vector_index.train_index(store, 8, 8, 16)
    return _rounded(vector_index.search_index(queries, vector_index.encode_rows(store, quantiser), quantiser, 8, 8, store))


@query("knn_stored_index", _KNN_PAIR_SQL)
def _(spark, sf):
    """Half of the rows written, the other half appended, all read back and searched."""
    queries, store = _vectors_by_pair(spark, sf)
    first = F.pmod(F.xxhash64("row_id"), F.lit(2)) == 0
    path = scratch_path(spark, "knn-index")
    vector_index.write_index(store.filter(first), vector_index.train_index(store, 8, 8, 16), path)
    vector_index.append_index(store.filter(~first), vector_index.read_index(spark, path)[1], path)
    postings, quantiser = vector_index.read_index(spark, path)
    return _rounded(vector_index.search_index(queries, postings, quantiser, 8, 8, store))


_CENTRES = """centre AS (SELECT label AS token, i, avg(x) AS c FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i),
model AS (SELECT vec_id AS query_id, token, -sum((x - c) * (x - c)) AS score FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN centre USING (i) GROUP BY vec_id, token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, token) AS rank FROM model QUALIFY rank <= 8)"""


def _model(spark, sf):
    """Model score of a label = minus the squared distance to the label's mean vector."""
    e = table(spark, sf, "embeddings")
    parts = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = parts.groupBy(F.col("label").alias("token"), "i").agg(F.avg("x").alias("c"))
    gaps = parts.join(F.broadcast(centre), "i").withColumn("g", (F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))
    scores = gaps.groupBy(F.col("vec_id").alias("query_id"), "token").agg((-F.sum("g")).alias("score"))
    return neighbours.topk(scores.withColumn("key", F.round("score", 9)), "query_id", "key", "token", 8).drop("key")


@query("topk_scores", f"WITH {_CENTRES} SELECT query_id, token, round(score, 6) AS score, rank::INT AS rank FROM ranked")
def _(spark, sf):
    return _model(spark, sf).select("query_id", "token", F.round("score", 6).alias("score"), "rank")


_FUSED = """nw AS (SELECT query_id, token, 0.5 * exp(-distance / 10 - max(-distance / 10) OVER q) / sum(exp(-distance / 10)) OVER q * exp(max(-distance / 10) OVER q) AS w, rank AS place FROM knn WINDOW q AS (PARTITION BY query_id)),
mw AS (SELECT query_id, token, 0.5 * exp(score / 5 - max(score / 5) OVER q) / (sum(exp(score / 5)) OVER q) * exp(max(score / 5) OVER q) AS w, rank + 1000000000 AS place FROM ranked WINDOW q AS (PARTITION BY query_id)),
f AS (SELECT query_id, token, sum(w) AS score, min(place) AS place FROM (SELECT * FROM nw UNION ALL SELECT * FROM mw) GROUP BY query_id, token),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS rank FROM f)"""


@query("fuse_scores", f"""
WITH {_KNN}, {_CENTRES}, {_FUSED} SELECT query_id, token, round(score, 6) AS score, rank::INT AS rank FROM best WHERE rank <= 2""")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    found = neighbours.explain_neighbours(neighbours.knn_exact(queries, store, 8), store, ["token"])
    fused = fusion.fuse_scores(found, _model(spark, sf), n=2)
    return fused.select("query_id", "token", F.round("score", 6).alias("score"), "rank")


@query("fuse_scores_beams", f"""
WITH {_KNN}, {_CENTRES}, {_FUSED},
sent AS (SELECT query_id // 2 AS sentence, token + (query_id % 2) * 1000 AS token, score, place + (query_id % 2) * 1000000 AS place FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY round(score, 12) DESC, place) AS rank FROM sent)
SELECT sentence, token, round(score, 6) AS score, rank::INT AS rank FROM b WHERE rank <= 4""")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    split = lambda df: df.withColumns({"sentence": F.floor(F.col("query_id") / 2), "beam": F.col("query_id") % 2})
    found = split(neighbours.explain_neighbours(neighbours.knn_exact(queries, store, 8), store, ["token"]))
    fused = fusion.fuse_scores(found, split(_model(spark, sf)), n=4, query="sentence", beam="beam", vocab_size=1000)
    return fused.select("sentence", "token", F.round("score", 6).alias("score"), "rank")


@query("explain_neighbours", f"""
WITH {_KNN} SELECT query_id, row_id, rank::INT AS rank, round(distance, 6) AS distance, token FROM knn""")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    found = neighbours.explain_neighbours(neighbours.knn_exact(queries, store, 8), store, ["token"])
    return found.select("query_id", "row_id", "rank", F.round("distance", 6).alias("distance"), "token")


@query("mixed_datastore_size", "SELECT 2 * count(*) AS n FROM embeddings")
def _(spark, sf):
    _q, store = _vectors(spark, sf)
    return joins.merge_datastores(store, store).agg(F.count(F.lit(1)).alias("n"))
