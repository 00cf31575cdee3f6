"""Byte-pair merges: learned from word counts on Spark, applied batch-wise in place.

Learning keeps the distinct words as symbol arrays and the counts of all pairs. A round merges a
whole batch of pairs that one-at-a-time learning would pick in turn. Only words that hold a merged
pair give delta counts, so the shuffle of a round grows with what it changes, not with the words."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, land, spread
from .vocab import token_pieces

END = "</w>"  # fixed value: mark of a word's last symbol
JOINT = "@@"  # fixed value: mark of a symbol that is continued
#: Pairs that a round looks at; more give larger batches, never other merges.
CANDIDATES = 500
#: Tokens that a task has as Python objects at a time, and words whose pieces it remembers.
TOKENS_AT_ONCE = 1 << 17
WORDS_KNOWN = 1 << 17
#: Rounds after which pair counts are summed up and written again.
FOLD_ROUNDS = 8

Merge = tuple[str, str, int]


# --- batches of symbol arrays -------------------------------------------------------------


class _Words:
    """Words of an Arrow batch as one run of symbol numbers, with the pairs of neighbours."""

    def __init__(self, column: pa.Array, counts: np.ndarray):
        coded = column.flatten().dictionary_encode()
        self.names: pa.Array = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(column)), self.sizes)
        self.counts = counts
        self.width = max(1, len(self.names))
        inside = self.owner[:-1] == self.owner[1:]
        self.at = np.flatnonzero(inside)  # where pairs start
        self.keys = self.ids[self.at] * self.width + self.ids[self.at + 1]

    def numbers_of(self, pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of those pairs whose symbols occur here, and their places in the list."""
        number = {name: i for i, name in enumerate(self.names.to_pylist())}
        known = [(number[a] * self.width + number[b], i) for i, (a, b) in enumerate(pairs) if a in number and b in number]
        known.sort()
        return np.array([k for k, _ in known], np.int64), np.array([i for _, i in known], np.int64)

    def which(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        """For each pair of neighbours its place in the list, or -1."""
        keys, places = self.numbers_of(pairs)
        if not len(keys):
            return np.full(len(self.keys), -1)
        near = np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)
        return np.where(keys[near] == self.keys, places[near], -1)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the exact sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(weights, starts)


_ROUND = pa.schema([("symbols", pa.list_(pa.string())), ("count", pa.int64()), ("left", pa.string()), ("right", pa.string())])
_ROUND_DDL = "symbols array<string>, count bigint, left string, right string"


def _state_rows(column: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    nothing = pa.nulls(len(counts), pa.string())
    return pa.RecordBatch.from_arrays([column, counts, nothing, nothing], schema=_ROUND)


def _pair_rows(words: _Words, own: np.ndarray | None, sign: int) -> pa.RecordBatch:
    """Pair counts of all words, or of the marked ones."""
    at, keys = (words.at, words.keys) if own is None else (words.at[own[words.owner[words.at]]], words.keys[own[words.owner[words.at]]])
    keys, sums = _sums(keys, sign * words.counts[words.owner[at]])
    left, right = words.names.take(pa.array(keys // words.width)), words.names.take(pa.array(keys % words.width))
    return pa.RecordBatch.from_arrays([pa.nulls(len(keys), _ROUND.field(0).type), pa.array(sums, pa.int64()), left, right], schema=_ROUND)


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    return batch.column("symbols"), batch.column("count").to_numpy(zero_copy_only=False).astype(np.int64)


def _merged_once(words: _Words, merges: list[tuple[str, str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words with pairs merged that do not overlap, their sizes, and which words changed."""
    which = words.which(merges)
    hits, places = words.at[which >= 0], which[which >= 0]
    if len(hits):  # of equal symbols in a row, pairs are taken from the left
        runs = np.flatnonzero(np.concatenate([[True], np.diff(hits) != 1]))
        even = (hits - np.repeat(hits[runs], np.diff(np.append(runs, len(hits))))) % 2 == 0
        hits, places = hits[even], places[even]
    ids, gone = words.ids.copy(), np.zeros(len(words.ids), bool)
    ids[hits] = words.width + places
    gone[hits + 1] = True
    own = np.bincount(words.owner[hits], minlength=len(words.sizes))
    sizes = words.sizes - own
    names = pa.concat_arrays([words.names.cast(pa.string()), pa.nulls(words.width - len(words.names), pa.string()), pa.array([a + b for a, b in merges], pa.string())])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, names.take(pa.array(ids[~gone]))), sizes, own > 0


def _merge_batch(batch: pa.RecordBatch, steps: list[list[tuple[str, str]]]) -> Iterator[pa.RecordBatch]:
    """The words with the pairs merged, step by step, and the changes of pair counts this makes."""
    column, counts = _columns(batch)
    before = words = _Words(column, counts)
    sizes, changed = words.sizes, np.zeros(len(column), bool)
    for merges in steps:
        merged, new_sizes, own = _merged_once(words, merges)
        if own.any():
            column, sizes, changed = merged, new_sizes, changed | own
            words = _Words(column, counts)
    open_ = pa.array(sizes > 1)  # a word of one symbol has no pairs left
    yield _state_rows(column.filter(open_), pa.array(counts).filter(open_))
    if changed.any():
        yield _pair_rows(before, changed, -1)
        yield _pair_rows(words, changed, 1)


def _triples(state: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str, str], int]:
    """Counts of three symbols in a row whose both pairs are given ones."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("count", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _Words(*_columns(batch))
            known = words.which(pairs) >= 0
            first = np.flatnonzero(known[:-1] & known[1:] & (np.diff(words.at) == 1)) if len(known) else np.empty(0, int)
            at = words.at[first]
            keys = words.keys[first] * words.width + words.ids[at + 2]
            keys, sums = _sums(keys, words.counts[words.owner[at]])
            parts = [keys // words.width**2, keys // words.width % words.width, keys % words.width]
            yield pa.RecordBatch.from_arrays([*(words.names.take(pa.array(p)) for p in parts), pa.array(sums, pa.int64())], schema=schema)

    rows = state.mapInArrow(count, "a string, b string, c string, count bigint").groupBy("a", "b", "c").agg(F.sum("count").alias("count"))
    return {(r.a, r.b, r.c): r["count"] for r in rows.collect()}  # neighbours among CANDIDATES pairs


# --- which merges go together -------------------------------------------------------------


class _Batch:
    """Pairs while a batch is chosen: their counts or upper bounds, and what is known of them.

    A merge of (a, b) takes occurrences from the pairs (x, a) and (b, y), as many as there are
    triples (x, a, b) and (a, b, y), and makes pairs (x, ab) and (ab, y), as many or fewer. A pair
    that lost occurrences on one side only, to merges that had all of theirs, has a known count,
    and so has a new pair while nothing else took its symbols. All others have an upper bound."""

    def __init__(self, candidates: list[Merge], triples: dict[tuple[str, str, str], int]):
        self.after, self.before = defaultdict(list), defaultdict(list)
        for (a, b, c), n in triples.items():
            self.after[a, b].append((c, n))
            self.before[b, c].append((a, n))
        self.counts = {(left, right): n for left, right, n in candidates}
        self.lost = defaultdict(int), defaultdict(int)  # on the left, on the right
        self.unknown: set[tuple[str, str]] = set()
        self.bases: dict[tuple[str, str], tuple] = {}  # of a new pair: the old pairs at its left and right end
        self.by_left, self.by_right = defaultdict(list), defaultdict(list)  # new pairs
        self.ending, self.starting = defaultdict(list), defaultdict(list)  # merged symbols
        self.queue = [(-n, left, right) for left, right, n in candidates]  # sorted, so a heap

    def bound(self, pair: tuple[str, str]) -> int:
        return self.counts[pair] - max(self.lost[0][pair], self.lost[1][pair])

    def sure(self, pair: tuple[str, str]) -> bool:
        return pair not in self.unknown and not (self.lost[0][pair] and self.lost[1][pair])

    def next(self) -> tuple[tuple[str, str], int] | None:
        """The pair of the highest bound, the first by name of equal ones."""
        while self.queue:
            negative, *names = heapq.heappop(self.queue)
            pair = tuple(names)
            if self.bound(pair) == -negative:
                return pair, -negative
            if self.bound(pair):
                heapq.heappush(self.queue, (-self.bound(pair), *pair))
        return None

    def add(self, pair: tuple[str, str], bound: int, bases: tuple | None = None) -> None:
        """A new pair; without bases its count is not known."""
        if pair not in self.counts:
            self.counts[pair] = bound
            self.by_left[pair[0]].append(pair)
            self.by_right[pair[1]].append(pair)
            heapq.heappush(self.queue, (-bound, *pair))
        if bases and pair not in self.unknown:
            self.bases[pair] = bases
        else:
            self.unknown.add(pair)

    def merge(self, pair: tuple[str, str]) -> bool:
        """Take the pair out; whether it had all of its occurrences."""
        left, right = pair
        joined = left + right
        first, last = self.bases.get(pair, (pair, pair))
        whole = pair not in self.bases and not (self.lost[0][pair] or self.lost[1][pair])
        for new in self.by_right[left]:  # new pairs that end or start where this one takes a symbol
            self.unknown.add(new)
            self.add((new[0], joined), self.counts[new])
        for new in self.by_left[right]:
            self.unknown.add(new)
            self.add((joined, new[1]), self.counts[new])
        for y, n in self.after[last]:
            near = (right, y)
            known = whole and y != left and self.sure(near) and not self.lost[1][near]
            self._take(near, n, 0 if whole else None)
            self.add((joined, y), n, (pair, near) if known else None)
            for other in [*self.starting[y], *([joined] if y == left else [])]:
                self.add((joined, other), n)
        for x, n in self.before[first]:
            near = (x, left)
            known = whole and x != right and self.sure(near) and not self.lost[0][near]
            self._take(near, n, 1 if whole else None)
            self.add((x, joined), n, (near, pair) if known else None)
            for other in self.ending[x]:
                self.add((other, joined), n)
        self.ending[right].append(joined)
        self.starting[left].append(joined)
        return whole

    def _take(self, pair: tuple[str, str], n: int, side: int | None) -> None:
        if side is None:
            self.unknown.add(pair)
        else:
            self.lost[side][pair] += n


def batch_of_merges(candidates: list[Merge], triples: dict[tuple[str, str, str], int], made: set[str], truncated: bool) -> list[list[Merge]]:
    """The first merges that one-at-a-time learning would pick from the sorted candidates, in steps
    of merges that do not overlap. The batch ends where a pair whose count is not known could be
    next: it waits for the next round, where all counts are exact again."""
    batch, steps = _Batch(candidates, triples), []
    cut = candidates[-1][2] if truncated and candidates else 0
    while found := batch.next():
        pair, count = found
        left, right = pair
        if steps and (left == right or count <= cut or not batch.sure(pair)):
            break
        joined = left + right
        again = joined in made or joined.endswith(END) and not right.endswith(END)
        made.add(joined)
        if left == right or again:  # occurrences overlap, or another pair gives the same symbol
            steps.append([(left, right, count)])
            break
        if batch.merge(pair) and steps:
            steps[-1].append((left, right, count))
        else:
            steps.append([(left, right, count)])
    return steps


# --- learning --------------------------------------------------------------------------------


def _initial_symbols(word: Column) -> Column:
    """`low` → [l, o, w</w>]."""
    letters = F.split(word, "")
    last = F.size(letters)
    return F.concat(F.slice(letters, F.lit(1), last - 1), F.array(F.concat(F.element_at(letters, -1), F.lit(END))))


def _pair_sums(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("left", "right").agg(F.sum("count").alias("count")).filter("count > 0")


def learn_bpe(counts: DataFrame, n_merges: int, word: str = "word", count: str = "count", candidates: int = CANDIDATES) -> DataFrame:
    """Ordered merges (rank, left, right, count) from words and their counts; the most frequent
    pair first, equal counts by (left, right).

    Per round the driver sees the leading candidates, the triples among them and nothing else.
    Words rest in a written table, which each round rewrites with what its batch merged."""
    spark = counts.sparkSession
    start = counts.filter(F.length(word) > 1).select(_initial_symbols(F.col(word)).alias("symbols"), F.col(count).cast("long").alias("count"))
    state = land(spread(start), "bpe-words")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pair_rows(_Words(*_columns(batch)), None, 1)

    parts = [land(_pair_sums([state.mapInArrow(first, _ROUND_DDL).select("left", "right", "count")]), "bpe-pairs")]
    merges: list[Merge] = []
    made: set[str] = set()
    while len(merges) < n_merges:
        if len(parts) > FOLD_ROUNDS:
            parts = [land(_pair_sums(parts), "bpe-pairs")]
        rows = _pair_sums(parts).orderBy(F.desc("count"), "left", "right").limit(candidates).collect()
        top = [(r["left"], r["right"], r["count"]) for r in rows]
        if not top:
            break
        near = _triples(state, [m[:2] for m in top])
        chosen = batch_of_merges(top, near, made, len(top) == candidates)
        merges += [m for step in chosen for m in step]
        if len(merges) >= n_merges:
            break

        def work(batches: Iterator[pa.RecordBatch], steps: list = [[m[:2] for m in step] for step in chosen]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _merge_batch(batch, steps)

        done = land(state.mapInArrow(work, _ROUND_DDL), "bpe-round")
        state = done.filter("symbols is not null").select("symbols", "count")
        parts.append(done.filter("left is not null").select("left", "right", "count"))
    rows = [(i, left, right, n) for i, (left, right, n) in enumerate(merges[:n_merges])]
    return spark.createDataFrame(rows, "rank int, left string, right string, count long")


# --- applying ----------------------------------------------------------------------------------


def _segment(word: str, ranks: dict) -> str:
    """Apply merges by rank until none fits; an empty token stays as it is."""
    if not word:
        return word
    symbols, rank_of = [*word[:-1], word[-1] + END], ranks.get
    while len(symbols) > 1:
        near = [rank_of(p, math.inf) for p in zip(symbols, symbols[1:])]
        lowest = min(near)
        if lowest == math.inf:
            break
        at = near.index(lowest)
        best = symbols[at], symbols[at + 1]
        merged, i = symbols[:at], at
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                merged.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                merged.append(symbols[i])
                i += 1
        symbols = merged
    return f"{JOINT} ".join(symbols).removesuffix(END)


def _joined(column: pa.ListArray, pieces_of) -> pa.Array:
    """Each list's tokens replaced by their pieces and joined by blanks; a batch segments its
    distinct tokens once."""
    coded = column.flatten().dictionary_encode()
    pieces = pa.array([pieces_of(w) for w in coded.dictionary.to_pylist()], pa.string())
    offsets = pc.subtract(column.offsets, column.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(coded.indices)), " ")


def _segmented(batches: Iterator[pa.RecordBatch], row_id: str, ranks: dict) -> Iterator[pa.RecordBatch]:
    """Rows in runs of a bounded number of tokens, with their tokens in pieces."""
    cached = lru_cache(maxsize=WORDS_KNOWN)(lambda word: _segment(word, ranks))
    for batch in token_pieces(batches, 1, TOKENS_AT_ONCE):
        yield pa.RecordBatch.from_arrays([batch.column(0), _joined(batch.column(1), cached)], names=[row_id, "text"])


def _apply_shared(df: DataFrame, row_id: str, tokens: str, codes: DataFrame) -> DataFrame:
    """Codes of a measured size go to every task; rows do not move."""
    rows = codes.collect()
    table = df.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["rank"] for r in rows})

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segmented(batches, row_id, table.value)

    kind = dict(df.dtypes)[row_id]
    return df.select(row_id, F.array_compact(tokens).alias("tokens")).mapInArrow(segment, f"`{row_id}` {kind}, text string")


def _apply_joined(df: DataFrame, row_id: str, tokens: str, codes: DataFrame) -> DataFrame:
    """Codes of any size: each distinct token meets, by a join on its stretches of up to the
    longest merged symbol, the codes that can apply to it; then tokens meet their pieces."""
    fixed = land(df.select(F.col(row_id).alias("id"), F.array_compact(tokens).alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "bpe-rows")
    places = fixed.select("row", F.posexplode("tokens").alias("pos", "word"))
    words = land(places.select("word").distinct(), "bpe-tokens")
    longest = codes.agg(F.max(F.length("left") + F.length("right"))).first()[0] or 0
    ended = F.concat("word", F.lit(END))
    stretches = F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(ended)),
        lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(longest), F.length(ended) - i + 1))), lambda n: F.substring(ended, i, n)),
    ))
    parts = words.filter("word <> ''").select("word", F.explode(F.array_distinct(stretches)).alias("joined"))
    keyed = codes.select("left", "right", "rank", F.concat("left", "right").alias("joined"))
    own = parts.join(keyed, "joined").groupBy("word").agg(F.collect_list(F.struct("left", "right", "rank")).alias("codes"))  # of one word

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_segment(w, {(c["left"], c["right"]): c["rank"] for c in cs or ()}) for w, cs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["word", "pieces"])

    pieces = words.join(own, "word", "left").select("word", "codes").mapInArrow(segment, "word string, pieces string")
    sorted_ = F.array_sort(F.collect_list(F.struct("pos", "pieces")))
    # a token may hold a third of all places: each task looks up its own distinct tokens of a salt
    salts = 32
    salted = places.withColumn("salt", (F.col("row") % salts).cast("int"))
    spread_ = pieces.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(salts)])))
    text = salted.join(spread_, ["word", "salt"]).groupBy("row").agg(F.array_join(F.transform(sorted_, lambda s: s["pieces"]), " ").alias("text"))
    whole = fixed.select("row", F.col("id").alias(row_id)).join(text, "row", "left")
    return whole.select(row_id, F.coalesce("text", F.lit("")).alias("text"))


def apply_bpe(df: DataFrame, row_id: str, tokens: str, codes: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_id, text) with sub-words joined by `@@ `, for any number of merges. Null tokens are
    left out. Codes beyond `most_bytes` are joined to the distinct tokens instead of shared."""
    size = codes.agg(F.sum(F.octet_length("left") + F.octet_length("right") + 200)).first()[0] or 0
    return (_apply_shared if size <= most_bytes else _apply_joined)(df, row_id, tokens, codes)
