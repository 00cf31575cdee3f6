"""Quality rules: counts of a text's faults, and a learnt verdict.

Method: logistic regression over hashed word and character n-grams, trained on labelled rows and
calibrated to probabilities on rows held back; texts are scored in Arrow batches against fixed
thresholds. Training uses a documented, bounded sample of the labels; scoring reads everything."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shuffle_rank
from .common import input_columns, output_field, text_slices, texts_of, tidy
from .textcodes import SEGMENT, Texts, mix, sums_by_doc

MIN_WORDS = 50
MOST_REPEATED = 0.5
SYMBOLS = "#*$%&|<>"
#: Labelled rows of each class that are learnt from, at most: those with the smallest hash of id.
PER_CLASS = 1500
#: A text is kept from this calibrated probability of good quality.
KEEP_FROM = 0.5
HELD_BACK = 5  # one row in so many calibrates
BITS = 15  # of each of the two halves, words and characters
CHAR_GRAM = 3
WORD_GRAM = 2
ROUNDS = 150
_BLANKS = "\t\n\v\f\r "


@dataclass
class Model:
    """Weights of hashed n-grams, and the line that turns a score into a log-odds."""

    weights: np.ndarray
    scale: float
    shift: float


def _gram_slots(texts: Texts, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot of each n-gram, bounds by text, number of n-grams by text), piece by piece."""
    spans = texts.spans()
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), spans, texts.n_words
    pairs, first = texts.windows(words, WORD_GRAM)
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(first, spans), np.maximum(texts.n_words - WORD_GRAM + 1, 0)
    # character n-grams end at the line break after a text
    grams = np.maximum(texts.lengths + 2 - CHAR_GRAM, 0)
    for at in range(0, len(texts.codes), SEGMENT):
        codes = texts.codes[at : at + SEGMENT + CHAR_GRAM - 1].astype(np.uint64)
        n = len(codes) - CHAR_GRAM + 1
        if n <= 0:
            break
        total = codes[:n]
        for i in range(1, CHAR_GRAM):
            total = total * np.uint64(0x10FFFF) + codes[i : i + n]
        slots = (mix(total) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
        begin = np.clip(texts.first - at, 0, n)
        end = np.clip(texts.first + grams - at, 0, n)
        mask = np.zeros(n + 1, np.int8)  # n-grams that run into the next text do not count
        np.add.at(mask, begin, 1)
        np.add.at(mask, end, -1)
        inside = np.flatnonzero(np.cumsum(mask[:-1]) > 0)
        yield slots[inside], np.searchsorted(inside, np.append(begin, n)), grams


def _scores(texts: Texts, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the mean weights of word, word pair and character n-grams."""
    total = np.zeros(texts.count)
    for slots, bounds, n in _gram_slots(texts, words):
        total += sums_by_doc(weights[slots], bounds) / np.maximum(n, 1)
    return total


def base_counts(texts: Texts, words: np.ndarray, raw: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text."""
    symbol = np.zeros(128, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    hits = np.flatnonzero(symbol[np.minimum(texts.codes, 127)])
    n_symbols = np.diff(np.searchsorted(hits, np.append(texts.first, len(texts.codes))))
    n_dup_lines = []
    for text in raw:
        lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
        n_dup_lines.append(len(lines) - len(set(lines)))
    windows, first = texts.windows(words, 3)
    own = mix(windows + texts.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(first) else windows
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    equal = np.zeros(len(own) + 1, bool)
    equal[1:-1] = ranked[1:] == ranked[:-1]
    again = first[order[equal[:-1] | equal[1:]]]
    covered = np.zeros(len(words) + 3, bool)
    for i in range(3):
        covered[again + i] = True
    n_repeat = sums_by_doc(covered[: len(words)], texts.spans())
    return {"n_words": texts.n_words, "word_chars": texts.word_chars, "n_symbols": n_symbols, "n_dup_lines": np.array(n_dup_lines), "n_repeat_words": n_repeat}


@tidy
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as (rank, label, slots, values)."""
    for batch in text_slices(batches):
        slots, values = [], []
        for text in texts_of(batch):
            one = Texts([text])
            dense = np.zeros(2 << BITS)
            for at, bounds, n in _gram_slots(one, one.word_hashes()):
                np.add.at(dense, at[bounds[0] : bounds[1]], 1.0 / max(1, int(n[0])))
            used = np.flatnonzero(dense)
            slots.append(used.astype("<i4").tobytes())
            values.append(dense[used].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["rank", "label", "slots", "values"])


def _fit(rows: list[dict], prior: dict[int, float]) -> Model:
    """Full-batch logistic regression (Adam), then a calibration line on the rows held back."""
    y = np.array([r["label"] for r in rows], np.float64)
    sizes = np.array([len(r["slots"]) // 4 for r in rows])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    slots = np.frombuffer(b"".join(r["slots"] for r in rows), "<i4")
    values = np.frombuffer(b"".join(r["values"] for r in rows), "<f4").astype(np.float64) * 10
    back = np.arange(len(rows)) % HELD_BACK == HELD_BACK - 1
    share = np.where(back, 0.0, np.where(y == 1, 0.5 / max(1, (y[~back] == 1).sum()), 0.5 / max(1, (y[~back] == 0).sum())))
    weights, first, second = (np.zeros(2 << BITS) for _ in range(3))
    for step in range(1, ROUNDS + 1):
        score = sums_by_doc(values * weights[slots], bounds)
        error = share * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        slope = np.bincount(slots, values * np.repeat(error, sizes), 2 << BITS) + 1e-6 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    score, label = sums_by_doc(values * weights[slots], bounds)[back], y[back]
    importance = np.array([prior[int(v)] / max(1, (label == v).sum()) for v in label])
    line, one = np.zeros(2), np.stack([score, np.ones_like(score)], 1)
    for _ in range(30):  # Newton steps with a small ridge, which keeps separable rows finite
        p = 1 / (1 + np.exp(-np.clip(one @ line, -30, 30)))
        bend = one.T @ (one * (importance * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        line -= np.linalg.solve(bend, one.T @ (importance * (p - label)) + 1e-3 * line)
    return Model((weights * 10).astype(np.float32), float(line[0]), float(line[1]))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from at most `per_class` labelled rows of each class; one task fits the model.

    The sample is chosen by a hash of the id. Class shares of all labels set the prior. Null
    labels are ignored. None without rows of both classes."""
    known = input_columns(labels, doc_id=id_col, label=label_col).filter("label in (0, 1) and doc_id is not null")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    prior = {k: n / sum(counts.values()) for k, n in counts.items()}
    ranked = known.select("doc_id", F.col("label").cast("int").alias("label"), shuffle_rank("quality", "doc_id").alias("rank"))
    sample = [ranked.filter(F.col("label") == k).orderBy("rank", "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 * per_class rows
    texts = input_columns(docs, doc_id=id_col, text=text_col).join(sample, "doc_id").select("rank", "label", "text")
    found = texts.mapInArrow(_sparse, "rank bigint, label int, slots binary, values binary")

    @tidy
    def fit(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["rank"], r["slots"], r["values"]))
        if {r["label"] for r in rows} == {0, 1}:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(_fit(rows, prior))]})

    row = found.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def _judge(batch: pa.RecordBatch, model: Model | None, keep_from: float) -> dict[str, np.ndarray]:
    raw = texts_of(batch)
    texts = Texts(raw)
    words = texts.word_hashes()
    out = base_counts(texts, words, raw)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    odds = np.full(len(raw), math.inf) if model is None else model.scale * _scores(texts, words, model.weights) + model.shift
    out["quality"] = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
    out["kept"] = ~out["base_failed"] & (out["quality"] >= keep_from)
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality (probability) and kept per row, without a shuffle.

    Null and empty texts have no words and fail the base rules. Without a model, what passes
    these is kept. Repeated rows and null ids are judged like any other. An empty table gives
    none. Other columns are ignored."""
    rows = input_columns(docs, doc_id=id_col, text=text_col)

    @tidy
    def run(batches):
        for batch in text_slices(batches):
            found = _judge(batch, model, keep_from)
            columns = [batch.column("doc_id"), *[pa.array(found[c].astype(np.int64)) for c in LONGS]]
            columns += [pa.array(found["base_failed"]), pa.array(found["quality"]), pa.array(found["kept"])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *LONGS, "base_failed", "quality", "kept"])

    ddl = f"doc_id {output_field(rows, 'doc_id')}, {', '.join(f'{c} bigint' for c in LONGS)}, base_failed boolean, quality double, kept boolean"
    return rows.mapInArrow(run, ddl)


def keep_good(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows that `score_quality` keeps, with all their columns."""

    @tidy
    def run(batches):
        for batch in text_slices(batches, text_col):
            yield batch.filter(pa.array(_judge(batch.rename_columns(["text" if c == text_col else f"_{c}" for c in batch.schema.names]), model, keep_from)["kept"]))

    return docs.mapInArrow(run, docs.schema)
