"""Queries over duplicate removal, splits, shuffles, samples and row filters."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import shuffle_rank
from ..operators import dedup, filters, joins, ordering, splits
from .base import (
    DOCS, PAIRS, docs, pairs, query, runs, RUNS, sql_adler32, sql_shuffle_rank, sql_uniform, sql_words, table,
)


def _lines(spark, sf):
    return docs(spark, sf).withColumn("line", F.concat_ws(" | ", "repo", "text"))


@query("dedup_lines", f"""
WITH {DOCS}, r AS (SELECT doc_id, lang, ' ' || text AS content,
  row_number() OVER (PARTITION BY lang, sha256(' ' || text) ORDER BY {sql_shuffle_rank(1, 'doc_id')}) AS rn FROM docs)
SELECT doc_id, lang, content FROM r WHERE rn = 1""")
def _(spark, sf):
    kept = dedup.dedup_lines(_lines(spark, sf), "line", "doc_id", ["lang"], shuffle_rank(1, "doc_id"))
    return kept.select("doc_id", "lang", "content")


@query("dedup_lines_raw", """
WITH t AS (SELECT doc_id, lang, replace(text, '. ', '/ | ') AS line FROM documents),
l AS (SELECT doc_id, lang, substr(line, 1, instr(line, '|') - 1) AS repo, substr(line, instr(line, '|') + 1) AS content
  FROM t WHERE instr(line, '|') > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, sha256(content) ORDER BY doc_id) AS rn FROM l WHERE contains(repo, '/'))
SELECT doc_id, repo, content FROM r WHERE rn = 1""")
def _(spark, sf):
    """The first sentence is taken as the id part; lines without one are skipped."""
    lines = docs(spark, sf).select("doc_id", "lang", F.replace("text", F.lit(". "), F.lit("/ | ")).alias("line"))
    return dedup.dedup_lines(lines, "line", "doc_id", ["lang"]).select("doc_id", "repo", "content")


@query("dedup_parallel_views", """
SELECT doc_id, lower(text) AS obfuscated, text AS dictionary FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, sha256(lower(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def _(spark, sf):
    views = docs(spark, sf).select("doc_id", "lang", F.lower("text").alias("obfuscated"), F.col("text").alias("dictionary"))
    return dedup.dedup_parallel(views, "obfuscated", "doc_id", ["lang"]).drop("lang")


@query("dedup_pairs", f"""
WITH {PAIRS} SELECT pair_id, language_pair, source, target FROM (
  SELECT *, row_number() OVER (PARTITION BY language_pair, sha256(source || target) ORDER BY pair_id) AS rn
  FROM pairs WHERE source <> '' AND target <> '') WHERE rn = 1""")
def _(spark, sf):
    return dedup.dedup_pairs(pairs(spark, sf), "source", "target", "pair_id", ["language_pair"])


@query("distinct_lines", f"""
SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)""")
def _(spark, sf):
    lines = docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("line"))
    return dedup.distinct_rows(lines, ["line"])


@query("dedup_by_key", "SELECT source, lang, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY ALL")
def _(spark, sf):
    return dedup.dedup_by_key(docs(spark, sf), ["source", "lang"], "doc_id").select("source", "lang", "doc_id", "text")


@query("dedup_report", """
SELECT lang, count(*) AS before, count(DISTINCT sha256(text)) AS after, count(*) - count(DISTINCT sha256(text)) AS duplicates
FROM documents GROUP BY lang""")
def _(spark, sf):
    return dedup.dedup_report(docs(spark, sf), "text", ["lang"])


_BUCKET = sql_adler32("source || ' '")
_SPLIT = f"CASE WHEN {_BUCKET} % 100 < 10 THEN 'test' WHEN {_BUCKET} % 100 >= 20 THEN 'train' ELSE 'valid' END"


@query("split_by_hash", f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def _(spark, sf):
    return splits.split_by_hash(docs(spark, sf), F.concat("repo", F.lit(" ")), 10, 10).select("doc_id", "split")


@query("train_shards", f"""
WITH s AS (SELECT doc_id, lang, {_SPLIT} AS split, {sql_shuffle_rank(3, 'doc_id')} AS pos FROM documents)
SELECT doc_id, lang, pos % 8 AS shard FROM s WHERE split = 'train'""")
def _(spark, sf):
    split = splits.split_by_hash(docs(spark, sf), F.concat("repo", F.lit(" ")), 10, 10)
    placed = splits.shard(split.withColumn("pos", shuffle_rank(3, "doc_id")), 8, "pos")
    return placed.filter("split = 'train'").select("doc_id", "lang", "shard")


@query("shuffle_lines", f"""
SELECT doc_id, sha256(text) AS id, row_number() OVER (ORDER BY {sql_shuffle_rank(5, 'doc_id')}, doc_id) - 1 AS position FROM documents""")
def _(spark, sf):
    numbered = ordering.with_row_index(docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("id")), [shuffle_rank(5, "doc_id"), "doc_id"], "position")
    return numbered


@query("shuffle_order", f"""
SELECT doc_id, lang, text FROM documents ORDER BY {sql_shuffle_rank(5, 'doc_id')}, doc_id""")
def _(spark, sf):
    return splits.shuffle(docs(spark, sf).select("doc_id", "lang", "text"), 5, "doc_id")


@query("split_ordered", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(0.6 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'test' END AS split
FROM documents""")
def _(spark, sf):
    return splits.split_ordered(docs(spark, sf).select("doc_id"), ["doc_id"], 0.6)


@query("half_split", f"""
WITH {PAIRS} SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY pair_id) - 1 < (SELECT count(*) FROM pairs) // 2 THEN 1 ELSE 2 END::INT AS half FROM pairs""")
def _(spark, sf):
    p = pairs(spark, sf).select("pair_id")
    first = splits.half(p, ["pair_id"], 1).withColumn("half", F.lit(1))
    return first.unionByName(splits.half(p, ["pair_id"], 2).withColumn("half", F.lit(2)))


@query("worker_slices", """
WITH n AS (SELECT count(*) // 7 AS size FROM events), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, CASE WHEN i < size * 7 THEN i // size END::INT AS worker FROM r, n""")
def _(spark, sf):
    return splits.with_worker(table(spark, sf, "events").select("event_id"), ["event_id"], 7)


@query("head_per_group", """
SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20""")
def _(spark, sf):
    return splits.head_per_group(docs(spark, sf).select("doc_id", "lang", "text"), ["lang"], ["doc_id"], 20)


@query("truncate_to_shortest", """
WITH s AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM documents GROUP BY lang)),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM r, s WHERE rn <= m""")
def _(spark, sf):
    return splits.truncate_to_shortest(docs(spark, sf).select("doc_id", "lang"), ["lang"], ["doc_id"])


@query("budget_subset", """
WITH t AS (SELECT lang, count(*)::DOUBLE AS n, sum(octet_length(encode(text)) + 1)::DOUBLE AS size FROM documents GROUP BY lang),
k AS (SELECT count(*) AS k FROM t), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, lang FROM r JOIN t USING (lang), k WHERE i < floor((400000.0::DOUBLE / k) * (n / size))""")
def _(spark, sf):
    return splits.budget_subset(docs(spark, sf).select("doc_id", "lang", "text"), "lang", "text", ["doc_id"], 400_000).select("doc_id", "lang")


@query("capped_sample", f"""
SELECT vec_id FROM embeddings ORDER BY {sql_uniform(1, 'vec_id')}, vec_id LIMIT 300""")
def _(spark, sf):
    return splits.capped_sample(table(spark, sf, "embeddings"), 300, 1, "vec_id").select("vec_id")


@query("chunk_rows", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 2000 AS chunk FROM events")
def _(spark, sf):
    return splits.chunk(table(spark, sf, "events").select("event_id"), ["event_id"], 2000)


_WEIGHTS = """w0 AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
w1 AS (SELECT lang, n, pow(n / sum(n) OVER (), 0.5) AS p FROM w0),
w AS (SELECT lang, n, p / sum(p) OVER () AS weight FROM w1)"""


@query("sampling_weights", f"WITH {_WEIGHTS} SELECT lang, n, round(weight, 9) AS weight FROM w")
def _(spark, sf):
    return splits.sampling_weights(docs(spark, sf), "lang", 0.5).withColumn("weight", F.round("weight", 9))


@query("weighted_draw", f"""
WITH {_WEIGHTS}, c AS (SELECT lang, sum(weight) OVER (ORDER BY lang) AS upto FROM w),
d AS (SELECT doc_id, {sql_uniform(9, 'doc_id')} AS u FROM documents)
SELECT doc_id, coalesce((SELECT min(lang) FROM c WHERE upto > u), (SELECT max(lang) FROM c)) AS choice FROM d""")
def _(spark, sf):
    weights = splits.sampling_weights(docs(spark, sf), "lang", 0.5)
    return splits.weighted_choice(docs(spark, sf).select("doc_id"), weights, "lang", 9, "doc_id")


@query("select_specific", """
SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def _(spark, sf):
    ids = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("snippet"))
    return joins.select_specific(docs(spark, sf), "doc_id", "text", ids, "item_id", "snippet").select("item_id", "doc_id")


# Filters and checks


@query("ingest_report", """
WITH s AS (SELECT lang, CASE WHEN n_chars > 8000 THEN 'timeout' WHEN text IS NULL OR trim(text) = '' OR source IS NULL THEN 'error'
   WHEN contains(text, chr(10)) THEN 'multiline' WHEN n_chars < 100 THEN 'filtered' ELSE 'ok' END AS status FROM documents)
SELECT lang, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 9) AS ratio FROM s GROUP BY lang, status""")
def _(spark, sf):
    rows = docs(spark, sf).withColumn("content", F.when(F.trim("text") != "", F.col("text")))
    report = filters.ingest_report(
        rows, "lang", payload="content", repo="source",
        timed_out=F.col("n_chars") > 8000, filtered=F.col("n_chars") < 100,
    )
    return report.withColumn("ratio", F.round("ratio", 9))


@query("valid_parallel", rf"""
WITH v AS (SELECT conv_id, turn, string_split(text, '. ') AS a, string_split(trim(text), chr(10)) AS b FROM conversations)
SELECT conv_id, turn, len(a)::INT AS n FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND len(a) = len(b)""")
def _(spark, sf):
    views = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.split("text", r"\. ").alias("a"), F.split(F.trim("text"), "\n").alias("b")
    )
    return filters.valid_parallel(views, ["a", "b"]).select("conv_id", "turn", F.size("a").alias("n"))


def _identifiers(spark, sf):
    n = F.size(F.array_distinct(text.words("text")))
    entries = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("VAR_"), i, F.lit(" v"), i))
    d = docs(spark, sf).filter(n > 0)
    return d.select("doc_id", F.array_join(entries, " | ").alias("dictionary"))


@query("drop_identifier_outliers", f"""
SELECT doc_id, len(list_distinct({sql_words('text')}))::INT AS n FROM documents
WHERE len(list_distinct({sql_words('text')})) BETWEEN 1 AND 200""")
def _(spark, sf):
    kept = filters.drop_identifier_outliers(_identifiers(spark, sf), "dictionary")
    return kept.select("doc_id", F.size(F.split("dictionary", r" \| ")).alias("n"))


@query("strong_tests", f"""
SELECT event_id FROM events WHERE value / 500.0 > 0.1
  AND len(string_split(props, ',')) >= 1""")
def _(spark, sf):
    tests = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 500.0).alias("score"), F.size(F.split("props", ",")).alias("asserts")
    )
    return filters.strong_tests(tests, "score", above=0.1, asserts="asserts", min_asserts=1).select("event_id")


@query("multi_assert", """
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'assert a ; assert b' WHEN 'click' THEN 'assert ' || props ELSE props END AS test, event_type AS cpp_test FROM events)
SELECT event_id, test, cpp_test FROM t WHERE (length(test) - length(replace(test, 'assert ', ''))) // 7 > 1""")
def _(spark, sf):
    kind = F.col("event_type")
    test = F.when(kind == "view", "assert a ; assert b").when(kind == "click", F.concat(F.lit("assert "), "props")).otherwise(F.col("props"))
    t = table(spark, sf, "events").select("event_id", test.alias("test"), kind.alias("cpp_test"))
    return filters.multi_assert(t, "test")


@query("removed_share", """
SELECT count(*) AS before, count(*) FILTER (WHERE n_chars > 1000) AS after, round(1 - count(*) FILTER (WHERE n_chars > 1000) / count(*), 9) AS removed_share FROM documents""")
def _(spark, sf):
    d = docs(spark, sf)
    share = filters.removed_share(d, d.filter("n_chars > 1000"))
    return share.withColumn("removed_share", F.round("removed_share", 9))


@query("filter_lengths", f"""
WITH {PAIRS} SELECT pair_id FROM pairs WHERE len({sql_words('source')}) BETWEEN 1 AND 60 AND len({sql_words('target')}) BETWEEN 1 AND 60""")
def _(spark, sf):
    p = pairs(spark, sf).withColumns({"s": text.words("source"), "t": text.words("target")})
    return filters.filter_lengths(p, ["s", "t"], 60).select("pair_id")


@query("drop_identical_pairs", """
SELECT doc_id, lower(text) AS translated FROM documents WHERE trim(text) <> trim(lower(text))""")
def _(spark, sf):
    p = docs(spark, sf).select("doc_id", "text", F.lower("text").alias("translated"))
    return filters.drop_identical_pairs(p, "text", "translated").drop("text")


@query("guard_length", f"""
SELECT doc_id, CASE WHEN len({sql_words('text')}) + 2 > 100 THEN 'Error: input too long: ' || len({sql_words('text')}) ELSE text END AS result FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", filters.guard_length("text", F.size(text.words("text")), 100).alias("result"))


@query("keep_existing", "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return filters.keep_existing(docs(spark, sf).select("doc_id", "text"), table(spark, sf, "labels"), "doc_id")


@query("missing_report", """
SELECT count(*) AS total, count(*) - count(l.doc_id) AS missing, round((count(*) - count(l.doc_id)) / count(*), 9) AS missing_share
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    report = filters.missing_report(docs(spark, sf), table(spark, sf, "labels"), "doc_id")
    return report.withColumn("missing_share", F.round("missing_share", 9))


@query("check_corpus", f"""
SELECT 'line_count' AS rule, 'documents=' || (SELECT count(*) FROM documents) || ' labels=' || (SELECT count(*) FROM labels) AS detail
UNION ALL
SELECT 'unknown_key', source FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
UNION ALL
SELECT 'label_length', doc_id::VARCHAR FROM documents WHERE len({sql_words('text')}) <> len(string_split(text, ' '))""")
def _(spark, sf):
    d = docs(spark, sf)
    known = d.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("source").distinct()
    return (
        filters.check_line_counts({"documents": d, "labels": table(spark, sf, "labels")})
        .unionByName(filters.check_known_keys(d, known, "source"))
        .unionByName(filters.check_label_lengths(d, "doc_id", text.words("text"), F.split("text", " ")))
    )
