"""Queries over test outcomes, BLEU, subtokens, perplexity and ranking scores."""

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import evaluate
from .base import PAIRS, RUNS, docs, pairs, query, runs, sql_uniform, sql_words, table

_PER_FUNCTION = """f AS (SELECT func_id, CASE WHEN bool_or(status = 'success') THEN 'success' ELSE arg_min(status, beam) END AS status,
  bool_or(status = 'success' AND value > 100) AS gold, arg_min(lang, beam) AS origin, arg_min(CASE WHEN value > 200 THEN 1 WHEN value < 1 THEN -1 ELSE 0 END, beam) AS rules
  FROM r GROUP BY func_id)"""

_RUNS2 = f"{RUNS}, r AS (SELECT * FROM runs)"


@query("outcome_stats", f"""
WITH {_RUNS2}, {_PER_FUNCTION}
SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failure') AS failure,
  count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'timeout') AS timeout,
  count(*) FILTER (WHERE status = 'compile_error') AS compile_error, count(*) FILTER (WHERE status = 'script_not_found') AS script_not_found,
  count(*) FILTER (WHERE gold) AS identical_gold, count(*) FILTER (WHERE rules = 1) AS fixed_rules, count(*) FILTER (WHERE rules = -1) AS corrupted_rules,
  count(*) FILTER (WHERE origin = 'signup') AS fixed_constrained, count(*) FILTER (WHERE origin = 'click') AS fixed_neighbour,
  count(*) AS total, count(*) - count(*) FILTER (WHERE status = 'script_not_found') AS total_evaluated FROM f""")
def _(spark, sf):
    r = runs(spark, sf).withColumns({
        "detail": F.when(F.col("value") > 100, "identical to gold"),
        "origin": F.when(F.col("lang") == "signup", "constrained").when(F.col("lang") == "click", "neighbour").otherwise("beam0"),
        "rules": F.when(F.col("value") > 200, 1).when(F.col("value") < 1, -1).otherwise(0),
    })
    return evaluate.outcome_stats(r, detail="detail", origin="origin", rules="rules")


@query("function_outcomes", f"WITH {_RUNS2}, {_PER_FUNCTION} SELECT func_id, status FROM f")
def _(spark, sf):
    return evaluate.function_outcomes(runs(spark, sf))


@query("computational_accuracy", f"""
WITH {_RUNS2}, {_PER_FUNCTION}
SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) AS total_evaluated,
  round(count(*) FILTER (WHERE status = 'success') / greatest(count(*), 1), 9) AS accuracy FROM f""")
def _(spark, sf):
    return evaluate.computational_accuracy(runs(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


@query("beam_contribution", f"""
WITH {RUNS}, b AS (SELECT * FROM runs)
SELECT beam, count(*) FILTER (WHERE status = 'success') AS success,
  round(count(*) FILTER (WHERE status = 'success') / (SELECT count(DISTINCT func_id) FROM b), 9) AS accuracy FROM b GROUP BY beam""")
def _(spark, sf):
    return evaluate.beam_contribution(runs(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


@query("first_success", f"WITH {_RUNS2} SELECT func_id, arg_min(code, beam) AS code FROM r WHERE status = 'success' GROUP BY func_id")
def _(spark, sf):
    return evaluate.first_success(runs(spark, sf))


@query("shortest_success", f"""
WITH {RUNS} SELECT func_id, code FROM (SELECT *, row_number() OVER (PARTITION BY func_id ORDER BY length(code), beam) AS rn FROM runs WHERE status = 'success') WHERE rn = 1""")
def _(spark, sf):
    return evaluate.shortest_success(runs(spark, sf))


@query("success_ratio", f"""
WITH {RUNS} SELECT beam, count(*) AS total, round(avg((status = 'success')::INT), 9) AS success_ratio, round(avg((status = 'timeout')::INT), 9) AS timeout_ratio
FROM runs GROUP BY beam""")
def _(spark, sf):
    ratio = evaluate.success_ratio(runs(spark, sf), ["beam"])
    return ratio.withColumns({c: F.round(c, 9) for c in ("success_ratio", "timeout_ratio")})


@query("error_table", f"""
WITH {RUNS}, b AS (SELECT func_id, string_agg(beam || ':' || status || ':' || code, chr(10) ORDER BY beam) AS beams FROM runs GROUP BY func_id)
SELECT doc_id AS func_id, sha256(text) AS source, lang AS reference, beams FROM documents LEFT JOIN b ON doc_id = func_id""")
def _(spark, sf):
    functions = docs(spark, sf).select(F.col("doc_id").alias("func_id"), F.sha2("text", 256).alias("source"), F.col("lang").alias("reference"))
    side = evaluate.error_table(functions, runs(spark, sf))
    beams = F.transform("beams", lambda b: F.concat_ws(":", b["beam"], b["status"], b["code"]))
    return side.withColumn("beams", F.array_join(beams, "\n"))


_BLEU = f"""
hw AS (SELECT pair_id, {sql_words('source')} AS w FROM pairs), rw AS (SELECT pair_id, 0 AS k, {sql_words('target')} AS w FROM pairs UNION ALL SELECT pair_id, 1, {sql_words('lower(target)')} FROM pairs),
hg AS (SELECT pair_id, n, gram, count(*) AS c FROM (SELECT pair_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM hw, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
rg AS (SELECT pair_id, n, gram, max(c) AS c FROM (SELECT pair_id, k, n, gram, count(*) AS c FROM (SELECT pair_id, k, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM rw, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL) GROUP BY ALL),
s AS (SELECT n, sum(least(hg.c, coalesce(rg.c, 0)))::DOUBLE AS hit, sum(hg.c)::DOUBLE AS total FROM hg LEFT JOIN rg USING (pair_id, n, gram) GROUP BY n),
l AS (SELECT hw.pair_id, len(hw.w) AS h, arg_min(len(rw.w), abs(len(hw.w) - len(rw.w)) * 1000000 + len(rw.w)) AS r FROM hw JOIN rw USING (pair_id) GROUP BY hw.pair_id, len(hw.w)),
t AS (SELECT sum(h)::BIGINT AS hyp_len, sum(r)::BIGINT AS ref_len FROM l)"""


@query("bleu", f"""
WITH {PAIRS}, {_BLEU}
SELECT round(CASE WHEN min(hit) = 0 THEN 0 ELSE 100 * (CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1 END) * exp(sum(ln(hit / total)) / 4) END, 6) AS bleu,
  round(100 * max(hit / total) FILTER (WHERE n = 1), 6) AS p1, round(100 * max(hit / total) FILTER (WHERE n = 2), 6) AS p2,
  round(100 * max(hit / total) FILTER (WHERE n = 3), 6) AS p3, round(100 * max(hit / total) FILTER (WHERE n = 4), 6) AS p4, hyp_len, ref_len
FROM s, t GROUP BY hyp_len, ref_len""")
def _(spark, sf):
    p = pairs(spark, sf)
    hyp = p.select("pair_id", words("source").alias("h"))
    refs = p.select("pair_id", F.lit(0).alias("k"), words("target").alias("r")).unionByName(
        p.select("pair_id", F.lit(1).alias("k"), words(F.lower("target")).alias("r")))
    score = evaluate.bleu(hyp, refs, "pair_id", "h", "r", "k")
    return score.withColumns({c: F.round(c, 6) for c in ("bleu", "p1", "p2", "p3", "p4")})


@query("bleu_documents", f"""
WITH pairs AS (SELECT doc_id AS pair_id, replace(text, 'the ', 'a ') AS source, text AS target FROM documents), {_BLEU}
SELECT round(CASE WHEN min(hit) = 0 THEN 0 ELSE 100 * (CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1 END) * exp(sum(ln(hit / total)) / 4) END, 6) AS bleu, hyp_len, ref_len
FROM s, t GROUP BY hyp_len, ref_len""")
def _(spark, sf):
    d = docs(spark, sf)
    hyp = d.select("doc_id", words(F.replace("text", F.lit("the "), F.lit("a "))).alias("h"))
    refs = d.select("doc_id", F.lit(0).alias("k"), words("text").alias("r")).unionByName(
        d.select("doc_id", F.lit(1).alias("k"), words(F.lower("text")).alias("r")))
    score = evaluate.bleu(hyp, refs, "doc_id", "h", "r", "k")
    return score.select(F.round("bleu", 6).alias("bleu"), "hyp_len", "ref_len")


# Identifier lines: reference names join the first words of a document with capital parts.
_REF_LINE = f"array_to_string(['VAR_' || i || ' ' || w[i + 1] || 'Name' FOR i IN range(0, len(w))], ' | ')"


def _dictionaries(spark, sf):
    w = docs(spark, sf).select("doc_id", F.transform(words("text"), lambda t: F.replace(t, F.lit("|"), F.lit("_"))).alias("w")).filter(F.size("w") > 0)
    ref = w.select("doc_id", F.array_join(F.transform("w", lambda t, i: F.concat(F.lit("VAR_"), i, F.lit(" "), t, F.lit("Name"))), " | ").alias("ref"))
    beam0 = w.select("doc_id", F.lit(0).alias("beam"), F.array_join(F.transform("w", lambda t, i: F.concat(F.lit("VAR_"), i, F.lit(" "), F.get("w", i + 1))), " | ").alias("hyp"))
    beam1 = w.select("doc_id", F.lit(1).alias("beam"), F.array_join(F.transform("w", lambda t, i: F.concat(F.lit("VAR_"), i, F.lit(" "), F.reverse(t), F.lit("Name"))), " | ").alias("hyp"))
    return ref, beam0, beam1


_SNAKE = r"""lower(substr(p, 1, 1)) || translate(regexp_replace(substr(p, 2), '([A-Z])', '_\1', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _parts(name):
    p = rf"regexp_replace({name}, '[\-.\s]', '_', 'g')"
    return f"list_distinct([x FOR x IN string_split({_SNAKE.replace('(p,', '(' + p + ',')}, '_') IF x <> ''])"


_SUB = f"""
w AS (SELECT doc_id, [replace(t, '|', '_') FOR t IN {sql_words('text')}] AS w FROM documents),
k AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM w),
e AS (SELECT doc_id, i, w[i + 1] || 'Name' AS ref, w[i + 2] AS h0, reverse(w[i + 1]) || 'Name' AS h1 FROM k),
z AS (SELECT *, {_parts('ref')} AS rs, CASE WHEN h0 IS NULL THEN [] ELSE {_parts('h0')} END AS s0, {_parts('h1')} AS s1 FROM e)"""


@query("subtoken_macro", f"""
WITH {_SUB}, c AS (SELECT *, len(list_intersect(rs, s0)) AS i0, len(list_intersect(rs, s1)) AS i1 FROM z),
q AS (SELECT *, CASE WHEN len(s0) > 0 THEN i0 / len(s0) ELSE 0 END AS p0, CASE WHEN len(rs) > 0 THEN i0 / len(rs) ELSE 0 END AS r0,
  CASE WHEN len(s1) > 0 THEN i1 / len(s1) ELSE 0 END AS p1, CASE WHEN len(rs) > 0 THEN i1 / len(rs) ELSE 0 END AS r1 FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM q)
SELECT round(avg(CASE WHEN f1 > f0 THEN p1 ELSE p0 END), 6) AS precision, round(avg(CASE WHEN f1 > f0 THEN r1 ELSE r0 END), 6) AS recall,
  round(avg(greatest(f0, f1)), 6) AS f1, round(avg((coalesce(h0 = ref, false) OR h1 = ref)::INT), 6) AS exact_match FROM f""")
def _(spark, sf):
    ref, a, b = _dictionaries(spark, sf)
    score = evaluate.subtoken_macro(ref, a.unionByName(b), "doc_id", "ref", "hyp", "beam")
    return score.select(*[F.round(c, 6).alias(c) for c in score.columns])


@query("subtoken_micro", f"""
WITH {_SUB}, t AS (SELECT sum(len(list_intersect(rs, s0))) AS h, sum(len(s0)) AS p, sum(len(rs)) AS e FROM z)
SELECT round(h / p, 6) AS precision, round(h / e, 6) AS recall, round(2 * (h / p) * (h / e) / (h / p + h / e), 6) AS f1 FROM t""")
def _(spark, sf):
    ref, a, _b = _dictionaries(spark, sf)
    score = evaluate.subtoken_micro(ref, a, "doc_id", "ref", "hyp")
    return score.select(*[F.round(c, 6).alias(c) for c in score.columns])


def _losses(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("lang"), (F.col("value") / 1000.0).alias("loss"), (F.col("user_id") + 1).alias("words"),
        F.floor((F.col("user_id") + 1) / 2).alias("valid"),
    )


_LOSS = "SELECT event_type AS lang, value / 1000.0 AS loss, user_id + 1 AS words, (user_id + 1) // 2 AS valid FROM events"


@query("perplexity", f"""
SELECT lang, round(exp(sum(loss * words) / sum(words)), 6) AS ppl, round(100.0 * sum(valid) / sum(words), 6) AS acc FROM ({_LOSS}) GROUP BY lang""")
def _(spark, sf):
    score = evaluate.perplexity(_losses(spark, sf), ["lang"], "loss", "words", "valid")
    return score.withColumns({c: F.round(c, 6) for c in ("ppl", "acc")})


@query("perplexity_macro", f"""
WITH s AS (SELECT lang, exp(sum(loss * words) / sum(words)) AS ppl, 100.0::DOUBLE * sum(valid) / sum(words) AS acc FROM ({_LOSS}) GROUP BY lang)
SELECT round(avg(ppl), 6) AS ppl, round(avg(acc), 6) AS acc FROM s""")
def _(spark, sf):
    score = evaluate.macro_mean(evaluate.perplexity(_losses(spark, sf), ["lang"], "loss", "words", "valid"), ["ppl", "acc"])
    return score.select(*[F.round(c, 6).alias(c) for c in score.columns])


@query("class_report", """
WITH x AS (SELECT label AS l, CASE WHEN embedding[1] > 0 THEN label ELSE (label + 1) % 10 END AS p FROM embeddings), c AS (SELECT unnest(range(10)) AS class)
SELECT class::INT AS class, round(100.0::DOUBLE * count(*) FILTER (WHERE l = class) / count(*), 6) AS proportion,
  round(100.0::DOUBLE * count(*) FILTER (WHERE l = class AND p = class) / count(*) FILTER (WHERE l = class), 6) AS recall,
  round(100.0::DOUBLE * count(*) FILTER (WHERE l = class AND p = class) / count(*) FILTER (WHERE p = class), 6) AS precision,
  round(100.0::DOUBLE * count(*) FILTER (WHERE l = p) / count(*), 6) AS accuracy FROM x, c GROUP BY class""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "label", F.when(F.col("embedding")[0] > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("predicted"))
    report = evaluate.class_report(e, "label", "predicted", 10)
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("proportion", "recall", "precision", "accuracy")])


_RANK = """by_s AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY s),
run AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp FROM by_s)
SELECT round(sum(neg::DOUBLE * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS roc_auc,
  round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) AS average_precision"""


@query("quality_ranking", f"""
WITH x AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), {_RANK} FROM run""")
def _(spark, sf):
    joined = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    score = evaluate.ranking_scores(joined, "quality", "n_chars")
    return score.select(*[F.round(c, 6).alias(c) for c in score.columns])


def _one_rest(name, y, s):
    return f"""SELECT '{name}' AS name, * FROM (WITH x AS (SELECT {y} AS y, {s} AS s FROM d), {_RANK} FROM run)"""


_SCORES3 = [sql_uniform(7, "event_id", str(c)) for c in range(3)]


@query("ranking_report", f"""
WITH d AS (SELECT CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS l, {', '.join(f'{u} AS s{c}' for c, u in enumerate(_SCORES3))} FROM events)
{' UNION ALL '.join([*[_one_rest(f'cl{c}', f'(l = {c})::INT', f's{c}') for c in range(3)], _one_rest('all_changes', '(l > 0)::INT', '1 - s0')])}""")
def _(spark, sf):
    from ..functions.hashing import uniform

    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        F.when(kind == "purchase", 1).when(kind == "error", 2).otherwise(0).alias("label"),
        F.array(*[uniform(7, "event_id", F.lit(c)) for c in range(3)]).alias("scores"),
    )
    report = evaluate.ranking_report(e, "label", "scores", 3)
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision")])


@query("metrics_long", f"""
WITH s AS (SELECT lang, round(exp(sum(loss * words) / sum(words)), 6) AS ppl, round(100.0::DOUBLE * sum(valid) / sum(words), 6) AS acc FROM ({_LOSS}) GROUP BY lang)
SELECT lang, 'ppl' AS metric, ppl AS value FROM s UNION ALL SELECT lang, 'acc', acc FROM s""")
def _(spark, sf):
    wide = evaluate.perplexity(_losses(spark, sf), ["lang"], "loss", "words", "valid")
    return evaluate.metrics_long(wide, ["lang"]).withColumn("value", F.round("value", 6))


@query("rerank_beams", """
WITH s AS (SELECT user_id, event_id, -value / pow(length(props)::DOUBLE, 0.6) AS score FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s)
SELECT user_id, event_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    h = table(spark, sf, "events").select("user_id", "event_id", (-F.col("value")).alias("logp"), F.length("props").alias("n"))
    best = evaluate.rerank(h, "user_id", "logp", "n", "event_id", 0.6, 5)
    return best.select("user_id", "event_id", F.round("score", 6).alias("score"), "rank")
