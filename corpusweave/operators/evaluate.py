"""Scores over test outcomes, losses and class predictions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.binding import let
from ..session import land
from .ordering import with_running

EMPTY_PERPLEXITY = 1e9  # fixed value: perplexity of an empty set


def _ratio(part, whole) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


# --- test outcomes ----------------------------------------------------------------------


def function_outcomes(runs: DataFrame, func_id: str = "func_id", beam: str = "beam", status: str = "status", keys: list[str] | None = None) -> DataFrame:
    """One row per function: `success` if any candidate passed, else the first one's status."""
    passed = F.bool_or(F.col(status) == "success")
    return runs.groupBy(*(keys or []), func_id).agg(
        F.when(passed, "success").otherwise(F.min_by(status, beam)).alias("status")
    )


def outcome_stats(
    runs: DataFrame, keys: list[str] | None = None, func_id: str = "func_id", beam: str = "beam", status: str = "status",
    detail: str | None = None, origin: str | None = None, rules: str | None = None,
) -> DataFrame:
    """Tally over functions. `detail = "identical to gold"` marks copies of the reference,
    `origin` the candidate source and `rules` (1 / −1) repairs and damage by rules."""
    keys = keys or []
    passed = F.col(status) == "success"
    first = [F.when(F.bool_or(passed), "success").otherwise(F.min_by(status, beam)).alias("__status")]
    first.append((F.bool_or(passed & (F.col(detail) == "identical to gold")) if detail else F.lit(False)).alias("__gold"))
    first.append((F.min_by(origin, beam) if origin else F.lit("")).alias("__origin"))
    first.append((F.min_by(rules, beam) if rules else F.lit(0)).alias("__rules"))
    per_function = runs.groupBy(*keys, func_id).agg(*first)
    is_ = lambda s: F.count_if(F.col("__status") == s)
    total = F.count(F.lit(1))
    return per_function.groupBy(*keys).agg(
        *[is_(s).alias(s) for s in ("success", "failure", "error", "timeout", "compile_error", "script_not_found")],
        F.count_if(F.col("__gold")).alias("identical_gold"),
        F.count_if(F.col("__rules") == 1).alias("fixed_rules"),
        F.count_if(F.col("__rules") == -1).alias("corrupted_rules"),
        F.count_if(F.col("__origin") == "constrained").alias("fixed_constrained"),
        F.count_if(F.col("__origin") == "neighbour").alias("fixed_neighbour"),
        total.alias("total"),
        (total - is_("script_not_found")).alias("total_evaluated"),
    )


def computational_accuracy(runs: DataFrame, keys: list[str] | None = None, func_id: str = "func_id", beam: str = "beam", status: str = "status") -> DataFrame:
    """Share of evaluated functions with a passing candidate (denominator 1 if none)."""
    stats = outcome_stats(runs, keys, func_id, beam, status)
    denominator = F.greatest(F.col("total_evaluated"), F.lit(1))
    return stats.select(*(keys or []), "success", "total_evaluated", (F.col("success") / denominator).alias("accuracy"))


def beam_contribution(runs: DataFrame, func_id: str = "func_id", beam: str = "beam", status: str = "status") -> DataFrame:
    """Successes of each beam over the same denominator as the accuracy."""
    evaluated = computational_accuracy(runs, None, func_id, beam, status).first()["total_evaluated"]
    per_beam = runs.groupBy(beam).agg(F.count_if(F.col(status) == "success").alias("success"))
    return per_beam.withColumn("accuracy", F.col("success") / F.lit(max(evaluated, 1)))


def first_success(runs: DataFrame, func_id: str = "func_id", beam: str = "beam", status: str = "status", code: str = "code") -> DataFrame:
    return runs.filter(F.col(status) == "success").groupBy(func_id).agg(F.min_by(code, beam).alias(code))


def shortest_success(runs: DataFrame, func_id: str = "func_id", beam: str = "beam", status: str = "status", code: str = "code") -> DataFrame:
    """Shortest passing translation, earliest candidate on ties; functions without one go."""
    good = runs.filter(F.col(status) == "success")
    return good.groupBy(func_id).agg(F.min_by(code, F.struct(F.length(code), F.col(beam))).alias(code))


def success_ratio(runs: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    share = lambda s: F.avg((F.col(status) == s).cast("double"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), share("success").alias("success_ratio"), share("timeout").alias("timeout_ratio")
    )


def error_table(functions: DataFrame, runs: DataFrame, func_id: str = "func_id", beam: str = "beam", code: str = "code", status: str = "status") -> DataFrame:
    """Source and reference beside all candidates in beam order, one row per function.
    A function has as many candidates as the beam is wide."""
    beams = runs.groupBy(func_id).agg(F.array_sort(F.collect_list(F.struct(beam, code, status))).alias("beams"))
    return functions.join(beams, func_id, "left")


# --- identifier subtokens ---------------------------------------------------------------


REFERENCE = -1  # stands for the beam number of reference entries
#: Rows of identifier lines that a task holds as Python objects at a time.
LINES_AT_ONCE = 64
#: Names whose parts a task remembers before it forgets them all.
NAMES_KNOWN = 1 << 16


def _lines(ref: DataFrame, hyp: DataFrame, line_id: str, ref_text: str, hyp_text: str, beam: Column) -> DataFrame:
    """(line, beam, text) of both sides, dealt by line, the rows of a line one after the other."""
    line = F.col(line_id).alias("line")
    sides = ref.select(line, F.lit(REFERENCE).alias("beam"), F.col(ref_text).alias("text")).unionByName(
        hyp.select(line, beam.cast("int").alias("beam"), F.col(hyp_text).alias("text"))
    )
    return sides.repartition("line").sortWithinPartitions("line").select("line", "beam", "text")


def _entries(text: str) -> dict[str, tuple[int, str]]:
    """Key to place and name of `key name | key name`; a repeated key keeps its last name."""
    out = {}
    for pos, entry in enumerate(text.split("|")):
        parts = entry.strip(" ").split(" ", 2)
        if len(parts) > 1:
            out[parts[0]] = (pos, parts[1])
    return out


def _known(beams: dict[int | None, dict[str, tuple[int, str]]]) -> Iterator[tuple[str, list[str]]]:
    """Each reference identifier's name and its candidates in beam order. Keys of a beam that comes
    before the reference, or of none, are no reference identifiers."""
    ref = beams.get(REFERENCE, {})
    outside = [own for beam, own in beams.items() if beam is None or beam < REFERENCE]
    after = [beams[beam] for beam in sorted(b for b in beams if b is not None and b > REFERENCE)]
    for key, (_, name) in ref.items():
        if not any(key in own for own in outside):
            yield name, [own[key][1] for own in after if key in own]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(name, candidates) of all lines. Entries without a name and keys unknown to the reference
    are ignored; a task holds the distinct entries of one line."""
    last, beams = None, {}
    for batch in batches:
        for lo in range(0, batch.num_rows, LINES_AT_ONCE):
            columns = (c.to_pylist() for c in batch.slice(lo, LINES_AT_ONCE).columns)
            for line, beam, text in zip(*columns, strict=True):
                if (line,) != last:
                    yield from _known(beams)
                    last, beams = (line,), {}
                if text is None:
                    continue
                own = _entries(text)
                if beam not in beams:
                    beams[beam] = own
                    continue
                old = beams[beam]
                for key, found in own.items():
                    if key not in old or old[key] < found:
                        old[key] = found
    yield from _known(beams)


_PART_MARKS = re.compile(r"[\-. \t\n\x0b\f\r]")
_LARGE = re.compile("[A-Z]")


def _parts_of(name: str) -> frozenset[str]:
    """`functions.text.subtokens` of one name."""
    plain = _PART_MARKS.sub("_", name)
    parts = set((plain[:1].lower() + _LARGE.sub(lambda m: f"_{m[0].lower()}", plain[1:])).split("_"))
    parts.discard("")
    return frozenset(parts)


def _parts_lookup():
    """`_parts_of` that splits a name once while it is remembered."""
    found: dict[str, frozenset[str]] = {}

    def parts(name: str) -> frozenset[str]:
        own = found.get(name)
        if own is None:
            if len(found) >= NAMES_KNOWN:
                found.clear()
            own = found[name] = _parts_of(name)
        return own

    return parts


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _rates(expected: frozenset[str], proposed: frozenset[str]) -> tuple[float, float, float]:
    """F1, precision, recall of two sets."""
    hit = len(expected & proposed)
    if not hit:
        return 0.0, 0.0, 0.0
    p, r = hit / len(proposed), hit / len(expected)
    return 2 * p * r / (p + r), p, r


def subtoken_macro(ref: DataFrame, hyp: DataFrame, line_id: str, ref_text: str, hyp_text: str, beam: str) -> DataFrame:
    """Mean over identifiers of the candidate with the best F1 (the first one on ties). Lines are
    shuffled once as texts; tasks take them apart and send sums."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts = _parts_lookup(), Counter()  # how often each (F1, precision, recall): few
        n = exact = 0
        for name, hyps in _names(batches):
            n += 1
            exact += name in hyps
            expected, best = parts(name), None
            for proposed in hyps:
                rates = _rates(expected, parts(proposed))
                if best is None or rates[0] > best[0]:
                    best = rates
            if best:
                counts[best] += 1
        f, p, r = (math.fsum(rates[i] * k for rates, k in counts.items()) for i in range(3))
        yield pa.RecordBatch.from_pydict({"n": [n], "p": [p], "r": [r], "f": [f], "exact": [float(exact)]})

    lines = _lines(ref, hyp, line_id, ref_text, hyp_text, F.col(beam))
    sums = lines.mapInArrow(score, "n bigint, p double, r double, f double, exact double")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0))
    return sums.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), mean("exact").alias("exact_match"))


def subtoken_micro(ref: DataFrame, hyp: DataFrame, line_id: str, ref_text: str, hyp_text: str) -> DataFrame:
    """Sums of the set sizes first, then precision, recall and F1. Lines are shuffled once as texts;
    tasks take them apart and send sums."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, totals = _parts_lookup(), [0, 0, 0]
        for name, hyps in _names(batches):
            expected = parts(name)
            proposed = parts(hyps[0]) if hyps else frozenset()
            totals[0] += len(expected & proposed)
            totals[1] += len(proposed)
            totals[2] += len(expected)
        yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip(("hit", "proposed", "expected"), totals, strict=True)})

    lines = _lines(ref, hyp, line_id, ref_text, hyp_text, F.lit(0))
    found = lines.mapInArrow(sizes, "hit bigint, proposed bigint, expected bigint")
    totals = found.agg(*[F.sum(c).alias(c) for c in ("hit", "proposed", "expected")])
    rates = totals.select(
        F.coalesce(_ratio(F.col("hit"), F.col("proposed")), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio(F.col("hit"), F.col("expected")), F.lit(0.0)).alias("recall"),
    )
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


# --- corpus BLEU ------------------------------------------------------------------------

MAX_ORDER = 4
#: Tokens that a task counts n-grams of together; a line of more is left to Spark.
LINE_TOKENS = 1 << 20


def _ngrams(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """One row per (keys, n, n-gram) for n = 1…4; the text form keeps token borders."""

    def of_order(n: int) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
            lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, F.lit(n)), " ").alias("gram")),
        )
        return F.when(F.size(tokens) >= n, every).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    pieces = [of_order(n) for n in range(1, MAX_ORDER + 1)]
    return df.select(*keys, F.explode(F.concat(*pieces)).alias("g")).select(*keys, "g.n", "g.gram")


def _line_sums(lines: np.ndarray, sides: np.ndarray, own: np.ndarray, tokens: pa.Array) -> np.ndarray:
    """Clipped matches of orders 1…4, then n-grams of hypotheses, over rows of whole lines: per row
    its line, its side (line and reference), whether it is the hypothesis, and its tokens."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    words = pc.list_flatten(tokens).dictionary_encode(null_encoding="encode")
    codes, kinds = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    line_of, own_of = np.zeros(sides.max(initial=0) + 1, np.int64), np.zeros(sides.max(initial=0) + 1, bool)
    line_of[sides], own_of[sides] = lines, own
    side, left = np.repeat(sides, sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    at, gram, most, out = np.arange(len(codes)), codes, kinds, np.zeros(2 * MAX_ORDER, np.int64)
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            fits = left[at] >= n
            at, gram = at[fits], gram[fits]
            found, gram = np.unique(gram * kinds + codes[at + n - 1], return_inverse=True)
            most = max(1, len(found))
        key, count = np.unique(side[at] * most + gram, return_counts=True)
        which, key = key // most, line_of[key // most] * most + key % most
        mine = own_of[which]
        order = np.argsort(key[~mine], kind="stable")
        others, best = key[~mine][order], count[~mine][order]
        if len(others):
            starts = np.flatnonzero(np.concatenate([[True], others[1:] != others[:-1]]))
            others, best = others[starts], np.maximum.reduceat(best, starts)
            place = np.minimum(np.searchsorted(others, key[mine]), len(others) - 1)
            out[n - 1] = np.where(others[place] == key[mine], np.minimum(best[place], count[mine]), 0).sum()
        out[MAX_ORDER + n - 1] = count[mine].sum()
    return out


_SUMS = [*[f"c{n}" for n in range(1, MAX_ORDER + 1)], *[f"t{n}" for n in range(1, MAX_ORDER + 1)]]


def _match_lines(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Sums per run of lines, from rows (line, reference, tokens) that come line by line. Rows of a
    line with more than `most` tokens are passed on as they are, with sums that are null."""

    def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = [pa.nulls(len(batch), pa.int64()) for _ in _SUMS]
        return pa.RecordBatch.from_arrays([*none, *(c.cast(f.type) for c, f in zip(batch.columns, list(schema)[len(_SUMS) :], strict=True))], schema=schema)

    def sums_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        line, ref = (rows.column(i).dictionary_encode(null_encoding="encode") for i in (0, 1))
        lines = line.indices.to_numpy().astype(np.int64)
        _, sides = np.unique(lines * len(ref.dictionary) + ref.indices.to_numpy(), return_inverse=True)
        sums = _line_sums(lines, sides, pc.is_null(rows.column(1)).to_numpy(zero_copy_only=False), rows.column(2))
        return pa.RecordBatch.from_arrays([*(pa.array([int(v)], pa.int64()) for v in sums), *(pa.nulls(1, f.type) for f in list(schema)[len(_SUMS) :])], schema=schema)

    done: list[pa.RecordBatch] = []  # whole lines that wait to be counted together
    held: list[pa.RecordBatch] = []  # rows so far of the last line
    waiting = holding = 0
    last, large = None, False
    for batch in batches:
        if not len(batch):
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(np.diff(coded)) + 1, [len(batch)]])
        tokens = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy())])
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            own = batch.column(0)[int(lo)].as_py()
            if (held or large) and own != last:  # the held line is whole
                done, waiting, held, holding, large = done + held, waiting + holding, [], 0, False
                if waiting > most:
                    yield sums_of(done)
                    done, waiting = [], 0
            last = own
            held.append(batch.slice(int(lo), int(hi - lo)))
            holding += int(tokens[hi] - tokens[lo])
            if large or holding > most:
                yield from map(rows_of, held)
                held, holding, large = [], 0, True
    if done or held:
        yield sums_of(done + held)


def _matched(grams: DataFrame, line_id: str) -> DataFrame:
    """Sums of the lines whose n-grams are given, grouped by Spark."""
    counts = grams.groupBy(line_id, "n", "gram", "__ref").agg(F.count(F.lit(1)).alias("c"))
    own = F.col("__ref").isNull()
    matched = counts.groupBy(line_id, "n", "gram").agg(
        F.max(F.when(own, F.col("c"))).alias("count"), F.max(F.when(~own, F.col("c"))).alias("ref_count")
    ).filter(F.col("count").isNotNull())
    return matched.agg(
        *[F.sum(F.when(F.col("n") == n, F.least("count", F.coalesce("ref_count", F.lit(0)))).otherwise(0)).alias(f"c{n}") for n in range(1, 5)],
        *[F.sum(F.when(F.col("n") == n, F.col("count")).otherwise(0)).alias(f"t{n}") for n in range(1, 5)],
    )


def bleu(hyp: DataFrame, refs: DataFrame, line_id: str, hyp_tokens: str, ref_tokens: str, ref_no: str) -> DataFrame:
    """Corpus BLEU-4 in percent with clipped counts and the closest reference length.

    A line without a reference counts with its length and its unmatched n-grams.
    Token arrays are shuffled once and sorted by line; n-grams, which are many times larger,
    are counted in Arrow batches of whole lines. Only lines of more than `LINE_TOKENS` tokens
    have theirs grouped by Spark."""
    sides = hyp.select(line_id, F.lit(None).cast("string").alias("__ref"), F.col(hyp_tokens).alias("__t")).unionByName(
        refs.select(line_id, F.col(ref_no).cast("string").alias("__ref"), F.col(ref_tokens).alias("__t"))
    )
    schema = StructType([*(StructField(c, LongType()) for c in _SUMS), *sides.schema.fields])
    arrow = to_arrow_schema(schema)
    ordered, most = sides.repartition(line_id).sortWithinPartitions(line_id), LINE_TOKENS
    counted = land(ordered.mapInArrow(lambda it: _match_lines(it, arrow, most), schema), "bleu-lines")
    large = counted.filter(F.col("c1").isNull()).select(line_id, "__ref", "__t")
    totals = counted.filter(F.col("c1").isNotNull()).select(*_SUMS).unionByName(_matched(_ngrams(large, [line_id, "__ref"], "__t"), line_id))
    by_order = totals.agg(*[F.sum(c).alias(c) for c in _SUMS])
    lengths = hyp.select(line_id, F.size(hyp_tokens).alias("h")).join(
        refs.select(line_id, F.size(ref_tokens).alias("r")), line_id, "left"
    )
    closest = lengths.groupBy(line_id).agg(
        F.first("h").alias("h"), F.min(F.struct(F.abs(F.col("h") - F.col("r")).alias("d"), F.col("r"))).alias("c")
    )
    sizes = closest.agg(F.sum("h").alias("hyp_len"), F.sum("c.r").alias("ref_len")).first()
    hyp_len, ref_len = sizes["hyp_len"] or 0, sizes["ref_len"] or 0
    precisions = [_ratio(F.col(f"c{n}"), F.col(f"t{n}")) for n in range(1, 5)]
    logs = sum((F.log(p) for p in precisions[1:]), F.log(precisions[0])) / MAX_ORDER
    usable = (F.least(*precisions) > 0) & F.lit(hyp_len > 0 and ref_len > 0)
    brevity = F.exp(F.lit(1 - ref_len / hyp_len)) if 0 < hyp_len < ref_len else F.lit(1.0)
    return by_order.select(
        F.when(usable, 100 * brevity * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"),
        *[(100 * p).alias(f"p{n}") for n, p in enumerate(precisions, 1)],
        F.lit(hyp_len).cast("long").alias("hyp_len"), F.lit(ref_len).cast("long").alias("ref_len"),
    )


# --- perplexity, class report, ranking --------------------------------------------------


def perplexity(df: DataFrame, keys: list[str], loss: str, words: str, valid: str) -> DataFrame:
    """`exp(Σ loss·n / Σ n)` and accuracy in percent; 1e9 and 0 on an empty set."""
    n = F.sum(words)
    return df.groupBy(*keys).agg(
        F.when(n > 0, F.exp(F.sum(F.col(loss) * F.col(words)) / n)).otherwise(F.lit(EMPTY_PERPLEXITY)).alias("ppl"),
        F.when(n > 0, 100.0 * F.sum(valid) / n).otherwise(F.lit(0.0)).alias("acc"),
    )


def macro_mean(scores: DataFrame, columns: list[str]) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(c) for c in columns])


def class_report(df: DataFrame, label: str, predicted: str, n_classes: int) -> DataFrame:
    """Share, recall and precision of every class, and overall accuracy, in percent."""
    pairs = df.groupBy(F.col(label).alias("__l"), F.col(predicted).alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    total, right = F.sum("n"), F.sum(F.when(F.col("__l") == F.col("__p"), F.col("n")).otherwise(0))
    part = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    percent = lambda a, b: F.when(b > 0, 100.0 * a / b).otherwise(F.lit(0.0))
    rows = []
    for c in range(n_classes):
        true, said = part(F.col("__l") == c), part(F.col("__p") == c)
        hit = part((F.col("__l") == c) & (F.col("__p") == c))
        rows.append(F.struct(
            F.lit(c).alias("class"), percent(true, total).alias("proportion"), percent(hit, true).alias("recall"),
            percent(hit, said).alias("precision"), percent(right, total).alias("accuracy"),
        ))
    return pairs.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _by_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulative hits from the highest distinct score down; exact, however many scores."""
    counts = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg")
    )
    return with_running(counts, [-F.col("s")], sums={"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC (ties count half) and average precision of a 0/1 label; null if one class only."""
    steps = _by_threshold(df, label, score)
    totals = steps.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2.0)).alias("area"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("precision_sum"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return totals.select(
        F.when(both, F.col("area") / (F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("precision_sum") / F.col("p")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_scores(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_scores(df, label, score).select("average_precision")


def ranking_report(df: DataFrame, label: str, scores: str, n_classes: int) -> DataFrame:
    """One-vs-rest scores for each class and for "any change" (label > 0, score 1 − s₀);
    `scores` is an array with one entry per class."""
    parts = []
    for c in range(n_classes):
        one = df.select((F.col(label) == c).cast("int").alias("y"), F.get(scores, F.lit(c)).alias("s"))
        parts.append(ranking_scores(one, "y", "s").withColumn("name", F.lit(f"cl{c}")))
    change = df.select((F.col(label) > 0).cast("int").alias("y"), (1 - F.get(scores, F.lit(0))).alias("s"))
    parts.append(ranking_scores(change, "y", "s").withColumn("name", F.lit("all_changes")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metrics_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide score rows to (keys, metric, value)."""
    values = [c for c in wide.columns if c not in keys]
    as_double = wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in values])
    return as_double.unpivot(keys, values, "metric", "value")


def rerank(df: DataFrame, key: str, sum_logprob: str, length: str, tie: str, penalty: float, n: int) -> DataFrame:
    """Best n hypotheses per sentence by `Σ log p / length^penalty`."""
    scored = df.withColumn("score", F.col(sum_logprob) / F.pow(F.col(length).cast("double"), F.lit(float(penalty))))
    order = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
