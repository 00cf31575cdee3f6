"""Queries over joins of functions, tests, candidates and snippets."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, vocab
from .base import (
    PAIRS, RUNS, TOKENS, doc_tokens, docs, pairs, query, runs, sql_words, table,
)


@query("canonical_pairs", f"""
WITH {PAIRS}, r AS (SELECT pair_id, split_part(language_pair, '_', 1) AS la, split_part(language_pair, '_', 2) AS lb, source, target FROM pairs)
SELECT pair_id, least(la, lb) AS lang1, greatest(la, lb) AS lang2,
  CASE WHEN la <= lb THEN source ELSE target END AS text1, CASE WHEN la <= lb THEN target ELSE source END AS text2 FROM r""")
def _(spark, sf):
    sides = F.split("language_pair", "_")
    p = pairs(spark, sf).withColumns({"la": sides[0], "lb": sides[1]}).drop("language_pair")
    return joins.canonical_pairs(p, "la", "lb", "source", "target")


@query("join_tests", f"""
SELECT event_id, doc_id AS func_id, sha256(text) AS code FROM events JOIN documents ON doc_id = user_id""")
def _(spark, sf):
    tests = table(spark, sf, "events").select("event_id", F.concat(F.lit("CLASS_"), "user_id").alias("TARGET_CLASS"))
    functions = docs(spark, sf).select(F.col("doc_id").cast("string").alias("func_id"), F.sha2("text", 256).alias("code"))
    joined = joins.join_tests(tests, functions)
    return joined.select("event_id", F.col("func_id").cast("long").alias("func_id"), "code")


@query("contains_join", """
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def _(spark, sf):
    snippets = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("snippet"))
    return joins.contains_join(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", snippets, "item_id", "snippet").select("doc_id", "item_id")


@query("contains_join_short", f"""
WITH s AS (SELECT DISTINCT item_id, {sql_words('text')}[1] AS snippet FROM benchmark)
SELECT d.doc_id, s.item_id FROM documents d JOIN s ON contains(d.text, s.snippet)""")
def _(spark, sf):
    """Snippets of one word have no inner word and go through character pieces."""
    snippets = table(spark, sf, "benchmark").select("item_id", text.words("text")[0].alias("snippet"))
    return joins.contains_join(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", snippets, "item_id", "snippet").select("doc_id", "item_id")


_PREFIX_SQL = "CASE WHEN n_chars > 1000 THEN source END"
_TOKEN_SQL = f"CASE WHEN length({sql_words('text')}[1]) > 3 THEN {sql_words('text')}[1] END"


@query("append_next_token", f"""
SELECT doc_id, CASE WHEN n_chars > 1000 THEN source || ' ' || coalesce({_TOKEN_SQL}, '') ELSE coalesce({_TOKEN_SQL}, '') END AS prefix
FROM documents WHERE lang <> 'de'""")
def _(spark, sf):
    prefixes = docs(spark, sf).select(
        "doc_id", F.when(F.col("n_chars") > 1000, F.col("source")).alias("prefix"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("fail"),
    )
    word = F.get(text.words("text"), F.lit(0))
    tokens = docs(spark, sf).select("doc_id", F.when(F.length(word) > 3, word).alias("token"))
    return joins.append_next_token(prefixes, tokens, "doc_id", "prefix", "token", "fail").select("doc_id", "prefix")


@query("lookup_or", """
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'q' || l.quality ELSE 'script_not_found' END AS result FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    dim = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat(F.lit("q"), "quality")).otherwise("missing").alias("result")
    )
    return joins.lookup_or(docs(spark, sf).select("doc_id"), dim, "doc_id", "result", "script_not_found")


@query("success_failure_pairs", f"""
WITH {RUNS}, s AS (SELECT func_id, arg_min(code, beam) AS success FROM runs WHERE status = 'success' GROUP BY func_id)
SELECT f.func_id, f.beam AS failed_beam, f.code AS failure, s.success FROM runs f JOIN s USING (func_id) WHERE f.status = 'failure'""")
def _(spark, sf):
    return joins.success_failure_pairs(runs(spark, sf))


@query("all_view_pairs", """
SELECT DISTINCT doc_id, a.v AS "left", b.v AS "right" FROM documents,
 LATERAL (SELECT unnest([lang, source, 'text']) AS v, unnest([1, 2, 3]) AS i) a, LATERAL (SELECT unnest([lang, source, 'text']) AS v, unnest([1, 2, 3]) AS i) b WHERE a.i < b.i""")
def _(spark, sf):
    views = F.array("lang", "source", F.lit("text"))
    return docs(spark, sf).select("doc_id", F.inline(joins.all_pairs(views)))


_TWO_VOCABS = f"""{TOKENS},
ca AS (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM doc_tokens WHERE lang = 'en') GROUP BY token),
a AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 513)::INT AS id FROM ca),
cb AS (SELECT token, count(*) AS count FROM (SELECT unnest(tokens) AS token FROM doc_tokens WHERE lang <> 'en') GROUP BY token),
b AS (SELECT token, (row_number() OVER (ORDER BY count DESC, token) + 513)::INT AS other_id FROM cb)"""


def _aligned(spark, sf):
    tokens = doc_tokens(spark, sf)
    a = vocab.build_vocab(vocab.count_tokens(tokens.filter("lang = 'en'"), "tokens", None), None)
    b = vocab.build_vocab(vocab.count_tokens(tokens.filter("lang <> 'en'"), "tokens", None), None)
    ordinary = f"id >= {vocab.FIRST_ORDINARY}"
    return joins.align_vocab(a.filter(ordinary), b.filter(ordinary))


@query("align_vocab", f"""
WITH {_TWO_VOCABS} SELECT token, id, coalesce(other_id, 3)::INT AS other_id, other_id IS NOT NULL AS known FROM a LEFT JOIN b USING (token)""")
def _(spark, sf):
    return _aligned(spark, sf)


@query("vocab_coverage", f"""
WITH {_TWO_VOCABS} SELECT count(other_id) AS known, count(*) AS total, round(count(other_id) / count(*), 9) AS coverage FROM a LEFT JOIN b USING (token)""")
def _(spark, sf):
    return joins.vocab_coverage(_aligned(spark, sf)).withColumn("coverage", F.round("coverage", 9))


@query("both_successful", f"""
WITH {RUNS}, a AS (SELECT func_id, arg_min(code, beam) AS c FROM runs WHERE status = 'success' GROUP BY func_id),
b AS (SELECT func_id, arg_min(code, beam) AS c FROM runs WHERE status = 'timeout' GROUP BY func_id)
SELECT func_id, 'cpp' AS lang1, 'python' AS lang2, b.c AS text1, a.c AS text2 FROM a JOIN b USING (func_id)""")
def _(spark, sf):
    from ..operators.evaluate import first_success

    r = runs(spark, sf)
    python = first_success(r)
    cpp = first_success(r.withColumn("status", F.when(F.col("status") == "timeout", "success").otherwise("failure")))
    return joins.both_successful(python, cpp, "python", "cpp")


_CAND = """e AS (SELECT *, event_id // 5 AS func_id FROM events),
c AS (SELECT func_id, list(event_type || value ORDER BY event_id) AS codes, list(event_type IN ('purchase', 'click') ORDER BY event_id) AS ok FROM e GROUP BY func_id),
s AS (SELECT func_id, ok[1] AS first_ok, codes[1] AS first_code,
  list_filter(list_zip(codes, ok), lambda x: x[2])[1] AS first_good FROM c),
n AS (SELECT func_id, arg_min('knn' || props, event_id) AS near, arg_min('knn' || props, event_id) FILTER (WHERE event_type = 'view') AS near_good FROM e GROUP BY func_id)"""


@query("choose_candidate", f"""
WITH {_CAND}
SELECT func_id, 'constrained' AS mode, CASE WHEN first_ok THEN first_code WHEN first_good IS NOT NULL THEN first_good[1]
   WHEN near_good IS NOT NULL THEN near_good ELSE first_code END AS code,
  CASE WHEN first_ok THEN 'beam0' WHEN first_good IS NOT NULL THEN 'constrained' WHEN near_good IS NOT NULL THEN 'neighbour' ELSE 'beam0' END AS origin
FROM s JOIN n USING (func_id)
UNION ALL
SELECT func_id, 'restricted', CASE WHEN first_ok THEN first_code ELSE near END, CASE WHEN first_ok THEN 'beam0' ELSE 'neighbour' END FROM s JOIN n USING (func_id)
UNION ALL
SELECT func_id, 'free', near, 'neighbour' FROM s JOIN n USING (func_id)""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("func_id", F.floor(F.col("event_id") / 5))
    beams = F.transform(
        F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_type", "value").alias("code"), F.col("event_type").isin("purchase", "click").alias("compiles")))),
        lambda c: F.struct(c["code"].alias("code"), c["compiles"].alias("compiles")),
    )
    near = F.transform(
        F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit("knn"), "props").alias("code"), (F.col("event_type") == "view").alias("compiles")))),
        lambda c: F.struct(c["code"].alias("code"), c["compiles"].alias("compiles")),
    )
    c = e.groupBy("func_id").agg(beams.alias("f"), near.alias("n"))
    modes = [("constrained", True, True), ("restricted", False, True), ("free", False, False)]
    picks = F.array(*[
        F.struct(F.lit(name).alias("mode"), joins.choose_candidate("f", "n", constrained, restricted).alias("p"))
        for name, constrained, restricted in modes
    ])
    return c.select("func_id", F.explode(picks).alias("x")).select("func_id", "x.mode", "x.p.*")


@query("invert_groups", """SELECT DISTINCT lang || '/' || source AS repo, lang AS "group" FROM documents""")
def _(spark, sf):
    groups = docs(spark, sf).select("lang", F.array("repo").alias("repos")).distinct()
    return joins.invert_groups(groups, "lang", "repos")


@query("repeated_members", "SELECT source AS repo, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(spark, sf):
    groups = docs(spark, sf).select("lang", F.array("source").alias("repos")).distinct()
    return joins.repeated_members(joins.invert_groups(groups, "lang", "repos"))


@query("merge_datastores", """
SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id, label FROM embeddings""")
def _(spark, sf):
    store = table(spark, sf, "embeddings").select("vec_id", "label")
    return joins.merge_datastores(store, store)


@query("flatten_tokens", f"""
WITH {PAIRS}, t AS (SELECT pair_id, {sql_words('target')} || [''] AS tokens FROM pairs)
SELECT pair_id, (unnest(range(len(tokens))))::INT AS pos, unnest(tokens) AS token FROM t""")
def _(spark, sf):
    p = pairs(spark, sf).withColumn("tokens", text.words("target"))
    return joins.flatten_tokens(p, "pair_id", "tokens")


@query("beams_to_long", """
SELECT event_id, 0 AS beam, event_type AS code FROM events UNION ALL SELECT event_id, 1, props FROM events""")
def _(spark, sf):
    wide = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("translated_beam_0"), F.col("props").alias("translated_beam_1"),
        F.col("user_id").alias("translated_beam_3"),
    )
    return joins.beams_to_long(wide.drop("translated_beam_3"), ["event_id"], "translated_beam_", "code")


@query("beams_round_trip", """SELECT event_id, event_type AS beam_0, props AS beam_1 FROM events""")
def _(spark, sf):
    wide = table(spark, sf, "events").select("event_id", F.col("event_type").alias("beam_0"), F.col("props").alias("beam_1"))
    return joins.beams_to_wide(joins.beams_to_long(wide, ["event_id"], "beam_"), ["event_id"], 2, "beam_")


@query("regroup_shards", "SELECT doc_id, lang FROM documents")
def _(spark, sf):
    from ..sources.tables import regroup

    parts = [docs(spark, sf).filter(F.col("lang") == lang).select("doc_id", "lang") for lang in ("en", "de", "es", "fr")]
    return regroup(parts)


