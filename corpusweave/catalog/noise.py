"""Queries over masking, noise, name restoration and code extraction."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import wrap_ids
from ..functions.hashing import uniform
from ..operators import augment, batching, extract, vocab
from ..session import land
from .base import DOCS, docs, pairs, query, sql_uniform, sql_words, table

_W = f"w AS (SELECT doc_id, [1] || [(length(t) + 514)::INT FOR t IN {sql_words('text')}] || [1] AS ids FROM documents)"
_T = f"{_W}, t AS (SELECT doc_id, unnest(range(len(ids)))::INT AS i, unnest(ids) AS x, len(ids) AS n FROM w)"


def _wrapped(spark, sf):
    return docs(spark, sf).select("doc_id", wrap_ids(F.transform(text.words("text"), lambda t: F.length(t) + 514)).alias("ids"))


def _u(seed, *keys):
    return sql_uniform(seed, *keys)


@query("mask_tokens", f"""
WITH {_T}, p AS (SELECT *, {_u('1p', 'doc_id', 'i')} <= 0.15 AND i > 0 AS hit, {_u('1a', 'doc_id', 'i')} AS a, {_u('1r', 'doc_id', 'i')} AS r FROM t)
SELECT doc_id, string_agg((CASE WHEN NOT hit THEN x WHEN a < 0.8 THEN 5 WHEN a < 0.8 + 0.1 THEN x ELSE floor(r * 1000)::INT END)::VARCHAR, ' ' ORDER BY i) AS ids,
  coalesce(string_agg(x::VARCHAR, ' ' ORDER BY i) FILTER (WHERE hit), '') AS targets FROM p GROUP BY doc_id""")
def _(spark, sf):
    d = _wrapped(spark, sf).withColumn("m", augment.mask_tokens("ids", "doc_id", 0.15, 1000, seed=1))
    return d.select("doc_id", F.array_join("m.ids", " ").alias("ids"), F.array_join("m.targets", " ").alias("targets"))


@query("mask_eval", f"""
WITH {_T}, u AS (SELECT *, {_u('2', 'doc_id', 'i')} AS u, i > 0 AND i < n - 1 AS inner_ FROM t),
m AS (SELECT *, min(CASE WHEN inner_ THEN u END) OVER (PARTITION BY doc_id) AS lowest FROM u)
SELECT doc_id, string_agg((CASE WHEN inner_ AND u <= greatest(lowest, 0.15) THEN 5 ELSE x END)::VARCHAR, ' ' ORDER BY i) AS ids FROM m GROUP BY doc_id""")
def _(spark, sf):
    return _wrapped(spark, sf).select("doc_id", F.array_join(augment.mask_eval("ids", "doc_id", 0.15, 2), " ").alias("ids"))


@query("mask_weighted", f"""
WITH {_T}, c AS (SELECT x, count(*) AS count FROM t GROUP BY x), wt AS (SELECT x, pow(count::DOUBLE, -0.5) AS weight FROM c),
z AS (SELECT doc_id, (sum(len(ids)) OVER (ORDER BY len(ids), doc_id ROWS UNBOUNDED PRECEDING) // 20000) AS batch, len(ids) AS n FROM w),
s AS (SELECT batch, ceil(0.15 * count(*) * max(n)) AS k FROM z GROUP BY batch),
q AS (SELECT batch, doc_id, i, x, row_number() OVER (PARTITION BY batch ORDER BY round(-ln(1 - {_u('3', 'doc_id', 'i')}) / weight, 9), doc_id, i) AS rn FROM t JOIN wt USING (x) JOIN z USING (doc_id))
SELECT batch::BIGINT AS batch, doc_id, i AS pos, x AS token_id FROM q JOIN s USING (batch) WHERE rn <= k AND i > 0""")
def _(spark, sf):
    d = land(_wrapped(spark, sf), "mask-rows")  # words are found once for counts, lengths and slots
    counts = land(d.select(F.explode("ids").alias("id")).groupBy("id").count(), "mask-counts")
    weights = counts.select("id", F.pow(F.col("count").cast("double"), F.lit(-0.5)).alias("weight"))
    sized = d.select("doc_id", (F.size("ids") - 2).alias("n"))
    batches = batching.token_batches(sized, "doc_id", ["n"], 20_000).select("doc_id", "batch")
    return augment.mask_weighted(d.join(batches, "doc_id"), weights, "batch", "doc_id", "ids", 0.15, 3)


def _shuffled(source, seed, k=3):
    return f"""SELECT doc_id, list(x ORDER BY CASE WHEN i = n - 1 THEN 1e18 WHEN i = 0 THEN -1 ELSE i + {_u(seed, 'doc_id', 'i')} * {k} END) AS ids FROM {source} GROUP BY doc_id"""


@query("word_shuffle", f"WITH {_T}, s AS ({_shuffled('t', '4')}) SELECT doc_id, array_to_string(ids, ' ') AS ids FROM s")
def _(spark, sf):
    return _wrapped(spark, sf).select("doc_id", F.array_join(augment.word_shuffle("ids", "doc_id", 3, 4), " ").alias("ids"))


def _dropped(source, seed, p=0.3):
    return f"""SELECT doc_id, CASE WHEN count(*) FILTER (WHERE keep) = 2 AND any_value(n) > 2
    THEN [1, max(CASE WHEN i = 1 + floor({_u(f'{seed}one', 'doc_id')} * (n - 2)) THEN x END), 1] ELSE list(x ORDER BY i) FILTER (WHERE keep) END AS ids
  FROM (SELECT *, i = 0 OR i = n - 1 OR {_u(seed, 'doc_id', 'i')} >= {p} AS keep FROM {source}) GROUP BY doc_id"""


@query("word_dropout", f"WITH {_T}, s AS ({_dropped('t', '5')}) SELECT doc_id, array_to_string(ids, ' ') AS ids FROM s")
def _(spark, sf):
    return _wrapped(spark, sf).select("doc_id", F.array_join(augment.word_dropout("ids", "doc_id", 0.3, 5), " ").alias("ids"))


@query("word_blank", f"""
WITH {_T} SELECT doc_id, string_agg((CASE WHEN i > 0 AND i < n - 1 AND {_u('6', 'doc_id', 'i')} < 0.2 THEN 5 ELSE x END)::VARCHAR, ' ' ORDER BY i) AS ids FROM t GROUP BY doc_id""")
def _(spark, sf):
    return _wrapped(spark, sf).select("doc_id", F.array_join(augment.word_blank("ids", "doc_id", 0.2, 6), " ").alias("ids"))


_BOUNDS = ", ".join(f"{b!r}::DOUBLE" for b in augment.length_bounds(lam=3.0))


@query("span_mask", f"""
WITH {_T}, b AS (SELECT doc_id, ceil(len(ids) * 0.15::DOUBLE)::INT AS budget FROM w), d AS (SELECT doc_id, budget, unnest(range(budget))::INT AS j FROM b),
u AS (SELECT *, {_u('7l', 'doc_id', 'j')} AS u FROM d), l AS (SELECT doc_id, budget, j, len([c FOR c IN [{_BOUNDS}] IF c <= u]) AS size FROM u),
s AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY j) - size AS before FROM l),
full_ AS (SELECT doc_id, least(size, budget - before) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS k FROM s WHERE size > 0 AND before < budget),
none AS (SELECT doc_id, count(*) AS m FROM s WHERE size = 0 AND before < budget GROUP BY doc_id),
p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY {_u('7s', 'doc_id', 'i')}, i) AS k FROM t WHERE i > 0 AND i < n - 1),
st AS (SELECT doc_id, i, size, {_u('7k', 'doc_id', 'i')} AS a, {_u('7r', 'doc_id', 'i')} AS r FROM p JOIN full_ USING (doc_id, k)),
v AS (SELECT doc_id, i, n, CASE WHEN size IS NULL OR (a >= 0.8 AND a < 0.8 + 0.1) THEN x WHEN a < 0.8 THEN 5 ELSE floor(r * 1000)::INT END AS x,
  max(i + size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t LEFT JOIN st USING (doc_id, i)),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM v WHERE i = 0 OR i = n - 1 OR reach IS NULL OR reach <= i),
z AS (SELECT doc_id, count(*) + coalesce(any_value(m), 0) AS total, coalesce(any_value(m), 0) AS m FROM k LEFT JOIN none USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, m, total, unnest(range(total))::INT AS g FROM z),
o AS (SELECT doc_id, g, g > 0 AND g < total - 1 AND row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN g > 0 AND g < total - 1 THEN {_u('7i', 'doc_id', 'g')} ELSE 2 END, g) <= m AS new_ FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, new_ ORDER BY g) AS k FROM o)
SELECT f.doc_id, string_agg((CASE WHEN NOT new_ THEN x WHEN {_u('7w', 'f.doc_id', 'g')} >= 0.1 THEN 5 ELSE 514 + floor({_u('7o', 'f.doc_id', 'g')} * 486)::INT END)::VARCHAR, ' ' ORDER BY g) AS ids
FROM f LEFT JOIN k ON f.doc_id = k.doc_id AND f.k = k.k AND NOT new_ GROUP BY f.doc_id""")
def _(spark, sf):
    masked = augment.span_mask(_wrapped(spark, sf), "doc_id", "ids", 0.15, 1000, lam=3.0, seed=7)
    return masked.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("add_noise", f"""
WITH {_T}, s AS ({_shuffled('t', '8s')}), st AS (SELECT doc_id, unnest(range(len(ids)))::INT AS i, unnest(ids) AS x, len(ids) AS n FROM s),
d AS ({_dropped('st', '8d')}), dt AS (SELECT doc_id, unnest(range(len(ids)))::INT AS i, unnest(ids) AS x, len(ids) AS n FROM d)
SELECT doc_id, string_agg((CASE WHEN i > 0 AND i < n - 1 AND {_u('8b', 'doc_id', 'i')} < 0.2 THEN 5 ELSE x END)::VARCHAR, ' ' ORDER BY i) AS ids FROM dt GROUP BY doc_id""")
def _(spark, sf):
    noisy = augment.add_noise(_wrapped(spark, sf), "doc_id", "ids", 3, 0.3, 0.2, 8)
    return noisy.select("doc_id", F.array_join("ids", " ").alias("ids"))


# Placeholder texts: every word becomes VAR_<length>; the dictionary names it w<length>.
_OBF = f"""o AS (SELECT doc_id, ['VAR_' || length(t) FOR t IN {sql_words('text')}] AS w FROM documents WHERE len({sql_words('text')}) > 0),
ot AS (SELECT doc_id, unnest(range(len(w)))::INT AS i, unnest(w) AS k FROM o)"""


def _obfuscated(spark, sf):
    d = docs(spark, sf).select("doc_id", F.transform(text.words("text"), lambda t: F.concat(F.lit("VAR_"), F.length(t))).alias("tokens")).filter(F.size("tokens") > 0)
    names = F.transform(F.array_distinct("tokens"), lambda t: F.concat(t, F.lit(" w"), F.substring(t, 5, 9)))
    return d.withColumn("dictionary", F.array_join(names, " | "))


@query("deobfuscate_occurrences", f"""
WITH {_OBF} SELECT doc_id, string_agg(CASE WHEN {_u('9', 'doc_id', 'i')} <= 0.4 THEN 'w' || substr(k, 5) ELSE k END, ' ' ORDER BY i) AS tokens FROM ot GROUP BY doc_id""")
def _(spark, sf):
    restored = augment.deobfuscate_occurrences(_obfuscated(spark, sf), "doc_id", "tokens", "dictionary", 0.4, 9)
    return restored.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("deobfuscate_identifiers", f"""
WITH {_OBF}, e AS (SELECT doc_id, k, {_u('10', 'doc_id', 'k')} AS u FROM (SELECT DISTINCT doc_id, k FROM ot)),
m AS (SELECT *, u <= 0.6 AND (max(u) OVER (PARTITION BY doc_id) > 0.6 OR u < max(u) OVER (PARTITION BY doc_id)) AS shown FROM e)
SELECT doc_id, (SELECT string_agg(CASE WHEN m.shown THEN 'w' || substr(ot.k, 5) ELSE ot.k END, ' ' ORDER BY i) FROM ot JOIN m USING (doc_id, k) WHERE ot.doc_id = o.doc_id) AS tokens,
  (SELECT string_agg(k || ' w' || substr(k, 5), ' | ' ORDER BY k) FROM m WHERE m.doc_id = o.doc_id AND NOT shown) AS dictionary
FROM o WHERE len(w) < 400""")
def _(spark, sf):
    restored = augment.deobfuscate_identifiers(_obfuscated(spark, sf), "doc_id", "tokens", "dictionary", 0.6, 400, 10)
    return restored.select("doc_id", F.array_join("tokens", " ").alias("tokens"), "dictionary")


# Source code derived from documents: one function per word group.


def _python(spark, sf):
    """A module per document: a function per line of text, the line as its literal."""
    clean = F.transform(F.split("text", "\n"), lambda l: F.regexp_replace(l, r"[\\\"'\r]", ""))
    functions = F.transform(
        clean,
        lambda l, i: F.concat(
            F.lit("def fn_"), i, F.when(i % 2 == 0, "(self, x):\n").otherwise("(x):\n"),
            F.lit("    # note\n    s = '"), l, F.lit("'\n    return s + x\n\n"),
        ),
    )
    tail = F.when(F.col("lang") == "de", "def broken(:\n  ((").otherwise("")
    return docs(spark, sf).select("doc_id", F.concat(F.array_join(functions, ""), tail).alias("code"))


@query("tokenize_python")
def _(spark, sf):
    tokens = extract.tokenize_python(_python(spark, sf), "doc_id", "code")
    return tokens.select("doc_id", "status", F.array_join("tokens", " ").alias("tokens"))


@query("extract_python_functions", """
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents WHERE lang <> 'de')
SELECT doc_id, i AS pos, CASE WHEN i % 2 = 0 THEN 'class' ELSE 'standalone' END AS kind, 'fn_' || i AS name FROM l""")
def _(spark, sf):
    from ..functions.code import function_name

    tokens = extract.tokenize_python(_python(spark, sf), "doc_id", "code").filter("status = 'ok'")
    found = extract.extract_functions(tokens, "doc_id", "tokens", "python")
    return found.select("doc_id", "pos", "kind", function_name(F.split("function", " "), "python").alias("name"))


@query("extract_java_functions", """
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents)
SELECT doc_id, i AS pos, CASE WHEN i % 2 = 0 THEN 'standalone' ELSE 'class' END AS kind,
  'public ' || CASE WHEN i % 2 = 0 THEN 'static ' ELSE '' END || 'int f' || i || ' ( int x ) { if ( x ) { x ++ ; } return x ; }' AS function FROM l""")
def _(spark, sf):
    body = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(
            F.lit("int field ; @ SuppressWarnings ( x ) public "), F.when(i % 2 == 0, "static ").otherwise(""),
            F.lit("int f"), i, F.lit(" ( int x ) { if ( x ) { x ++ ; } return x ; }"),
        ),
    )
    tokens = docs(spark, sf).select("doc_id", F.split(F.array_join(body, " "), " ").alias("tokens"))
    return extract.extract_functions(tokens, "doc_id", "tokens", "java")


@query("python_compiles", "SELECT doc_id, lang <> 'de' AS compiles FROM documents")
def _(spark, sf):
    return _python(spark, sf).select("doc_id", extract.python_compiles("code").alias("compiles"))


@query("explode_views", r"""
SELECT doc_id, 'sa' AS suffix, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS content FROM documents
UNION ALL SELECT doc_id, 'cl', unnest(range(len(string_split(text, '. '))))::INT, unnest(string_split(text, '. ')) FROM documents""")
def _(spark, sf):
    views = docs(spark, sf).select("doc_id", F.split("text", "\n").alias("sa"), F.split("text", r"\. ").alias("cl"))
    return extract.explode_views(views, ["doc_id"], ["sa", "cl"])
