import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusweave.functions.text import words
from corpusweave.operators import evaluate


def macro(spark, ref, *hyps):
    refs = spark.createDataFrame([(0, ref)], "line int, ref string")
    rows = [(0, i, h) for i, h in enumerate(hyps)]
    hyp = spark.createDataFrame(rows, "line int, beam int, hyp string")
    return evaluate.subtoken_macro(refs, hyp, "line", "ref", "hyp", "beam").first()


def micro(spark, ref, hyp):
    refs = spark.createDataFrame([(0, ref)], "line int, ref string")
    hyps = spark.createDataFrame([(0, hyp)], "line int, hyp string")
    return evaluate.subtoken_micro(refs, hyps, "line", "ref", "hyp").first()


REF = "VAR_1 countLines | VAR_2 uniqueWords"


def test_subtoken_macro_golden(spark):
    r = macro(spark, REF, "VAR_1 linesCount | VAR_2 words")
    assert (r.precision, r.recall, r.exact_match) == (1.0, 0.75, 0.0)
    assert r.f1 == pytest.approx(0.8333, abs=1e-4)
    r = macro(spark, REF, "VAR_1 linesCount | VAR_2 sentences")
    assert (r.precision, r.recall, r.f1, r.exact_match) == (0.5, 0.5, 0.5, 0.0)


def test_subtoken_best_beam_unknown_and_missing_keys(spark):
    r = macro(spark, REF, "VAR_1 x | VAR_9 countLines", "VAR_1 countLines | VAR_2", "VAR_1 lines")
    assert (r.precision, r.recall, r.exact_match) == (0.5, 0.5, 0.5)


def test_subtoken_micro_golden(spark):
    assert micro(spark, REF, "VAR_1 linesCount | VAR_2 words").f1 == pytest.approx(0.857142, abs=1e-5)
    r = micro(spark, REF, "VAR_3 x")
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def bleu_by_hand(pairs):
    hit, total, hyp_len, ref_len = [0] * 5, [0] * 5, 0, 0
    for hyp, refs in pairs:
        h, rs = hyp.split(), [r.split() for r in refs]
        hyp_len += len(h)
        ref_len += min((abs(len(h) - len(r)), len(r)) for r in rs)[1]
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: E731, B023
            best = Counter()
            for r in rs:
                best |= grams(r)
            counts = grams(h)
            total[n] += sum(counts.values())
            hit[n] += sum((counts & best).values())
    if not all(hit[1:]):
        return 0.0
    brevity = math.exp(1 - ref_len / hyp_len) if hyp_len < ref_len else 1.0
    return 100 * brevity * math.exp(sum(math.log(hit[n] / total[n]) for n in range(1, 5)) / 4)


@pytest.mark.parametrize(
    "pairs",
    [
        [("the cat sat on the mat", ["the cat sat on a mat", "a cat sat on the mat today"])],
        [("the the the the the", ["the cat the cat the"])],
        [("a b c", ["a b c"])],
        [("a b c d e", ["a b c d"]), ("x y z w", ["x y z w v u", "x y"])],
        [("a b c d", [""]), ("a b c d e", ["a b c d e"])],
    ],
)
def test_bleu(spark, pairs):
    hyp = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pairs)], "id int, h string")
    ref = spark.createDataFrame([(i, k, r) for i, (_, rs) in enumerate(pairs) for k, r in enumerate(rs)], "id int, k int, r string")
    score = evaluate.bleu(hyp.select("id", words("h").alias("h")), ref.select("id", "k", words("r").alias("r")), "id", "h", "r", "k")
    assert score.first()["bleu"] == pytest.approx(bleu_by_hand(pairs))


@pytest.mark.parametrize("most", [1 << 20, 30, 4])
def test_bleu_groups_by_spark_only_what_large_lines_have(spark, monkeypatch, most):
    draw = random.Random(most)
    text = lambda: " ".join(draw.choice("abcd") for _ in range(draw.randrange(25)))
    lines = [(text(), [text() for _ in range(draw.randrange(1, 4))]) for _ in range(60)] + [("a b c d " * 50, ["b c d a " * 40])]
    hyp = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(lines)], "id int, h string")
    ref = spark.createDataFrame([(i, k, r) for i, (_, rs) in enumerate(lines) for k, r in enumerate(rs)], "id int, k int, r string")
    grouped, ngrams = [], evaluate._ngrams
    monkeypatch.setattr(evaluate, "_ngrams", lambda df, *a: grouped.append({r.id for r in df.select("id").collect()}) or ngrams(df, *a))
    monkeypatch.setattr(evaluate, "LINE_TOKENS", most)
    score = evaluate.bleu(hyp.select("id", words("h").alias("h")), ref.select("id", "k", words("r").alias("r")), "id", "h", "r", "k")
    assert score.first()["bleu"] == pytest.approx(bleu_by_hand(lines))
    sizes = [len(h.split()) + sum(len(r.split()) for r in rs) for h, rs in lines]
    assert grouped == [{i for i, n in enumerate(sizes) if n > most}]


def test_bleu_counts_lines_without_a_reference(spark):
    hyp = spark.createDataFrame([(0, ["a", "b", "c", "d"]), (1, ["e", "f"])], "id int, h array<string>")
    ref = spark.createDataFrame([(0, 0, ["a", "b", "c", "d"])], "id int, k int, r array<string>")
    score = evaluate.bleu(hyp, ref, "id", "h", "r", "k").first()
    assert (score.hyp_len, score.ref_len, score.p1) == (6, 4, pytest.approx(100 * 4 / 6))


def test_ranking_ties_and_single_class(spark):
    def run(rows):
        return evaluate.ranking_scores(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()

    tied = run([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])
    assert (tied.roc_auc, tied.average_precision) == (0.5, 0.5)
    assert run([(1, 0.5), (1, 0.7)]).roc_auc is None
    mixed = run([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert mixed.roc_auc == pytest.approx(0.75)
    assert mixed.average_precision == pytest.approx(0.8333333, abs=1e-6)


RUNS = "func_id int, beam int, status string, code string"


def test_shortest_success_ties_and_none(spark):
    runs = spark.createDataFrame(
        [(1, 0, "success", "bbb"), (1, 1, "success", "aa"), (1, 2, "success", "cc"), (2, 0, "failure", "x")], RUNS
    )
    assert [(r.func_id, r.code) for r in evaluate.shortest_success(runs).collect()] == [(1, "aa")]
    assert evaluate.first_success(runs).first()["code"] == "bbb"


def test_outcomes_use_the_first_beam(spark):
    runs = spark.createDataFrame(
        [(1, 0, "timeout", ""), (1, 1, "error", ""), (2, 0, "failure", ""), (2, 1, "success", ""), (3, 0, "script_not_found", "")], RUNS
    )
    stats = evaluate.outcome_stats(runs).first()
    assert (stats.success, stats.timeout, stats.error, stats.total, stats.total_evaluated) == (1, 1, 0, 3, 2)
    assert evaluate.computational_accuracy(runs).first()["accuracy"] == 0.5
    nothing = evaluate.computational_accuracy(runs.filter("func_id = 3")).first()
    assert nothing["accuracy"] == 0.0


def test_empty_perplexity(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 0)], "l string, loss double, n int, v int")
    r = evaluate.perplexity(df, ["l"], "loss", "n", "v").first()
    assert (r.ppl, r.acc) == (1e9, 0.0)


def test_rerank(spark):
    df = spark.createDataFrame([(1, 0, -4.0, 4), (1, 1, -3.0, 2), (1, 2, -9.0, 9)], "s int, h int, lp double, n int")
    best = evaluate.rerank(df, "s", "lp", "n", "h", 1.0, 2).orderBy("rank").collect()
    assert [r.h for r in best] == [0, 2]


def test_class_report_without_a_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "l int, p int")
    r = {x["class"]: x for x in evaluate.class_report(df, "l", "p", 3).collect()}
    assert r[2]["recall"] == 0.0 and r[2]["precision"] == 0.0
    assert r[0]["recall"] == 50.0 and r[1]["precision"] == 50.0
    assert r[0]["accuracy"] == pytest.approx(200 / 3)


def test_success_ratio(spark):
    df = spark.createDataFrame([("a", "success"), ("a", "timeout")], "k string, status string")
    assert evaluate.success_ratio(df, ["k"]).select(F.col("success_ratio")).first()[0] == 0.5


def test_subtoken_lines_are_shuffled_whole(spark):
    """One row per line and side goes through the shuffle, not one per identifier."""
    refs = spark.createDataFrame([(0, REF)], "line int, ref string")
    hyps = spark.createDataFrame([(0, 0, REF)], "line int, beam int, hyp string")
    for score in (evaluate.subtoken_micro(refs, hyps, "line", "ref", "hyp"), evaluate.subtoken_macro(refs, hyps, "line", "ref", "hyp", "beam")):
        plan = score._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "collect_list" not in plan


def test_subtoken_parts_are_those_of_the_column_function(spark):
    names = ["countLines", "a-b.c d\te", "ÉtéName", "__x__", "", "ABC", "snake_case_X", "ß", "a\x0bB"]
    from corpusweave.functions.text import subtokens

    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", subtokens(F.col("n")).alias("p")).collect()
    assert {r.n: frozenset(r.p) for r in rows} == {n: evaluate._parts_of(n) for n in names}


def test_subtoken_rows_of_a_line_that_come_twice(spark):
    refs = spark.createDataFrame([(None, "k a | j b"), (None, "k a"), (1, None), (2, " | x | y  z")], "line int, ref string")
    hyps = spark.createDataFrame([(None, 0, "q x | k a"), (None, 0, "k c"), (None, 1, "k d | j b"), (3, 0, "k a")], "line int, beam int, hyp string")
    r = evaluate.subtoken_macro(refs, hyps, "line", "ref", "hyp", "beam").first()
    # k keeps its entry of the later place, a; j has its name at beam 1; the empty name of y has no candidate
    assert (r.precision, r.recall, r.exact_match) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
