"""License scans: short notices found with a few edits in whole texts.

Method: a notice of which at most k characters may be edited is split into k + 1 seeds, so each
match holds one seed unchanged (pigeonhole). An automaton of all seeds finds these places in one
pass; around them the regex library's bounded-error matching verifies the edits and gives spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_columns, output_field, text_slices

# Base phrases with their labels, and short notices with theirs, in words as
# `plain_words` gives them.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice, up to the most.
CHARS_PER_EDIT = 10
MOST_EDITS = 4

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TO_WORDS = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def plain_words(text: str | None) -> str:
    """The words of a text after lower-casing A-Z, joined by single blanks. A word is a run of
    letters, digits and anything beyond ASCII."""
    return b" ".join((text or "").encode().translate(_TO_WORDS).split()).decode()


def allowed_edits(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_PER_EDIT)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of near-equal length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _matcher(notices: tuple, phrases: tuple):
    """Automaton of seeds and phrases, and two bounded-error patterns per notice (leftmost
    match, best match). Phrases are
    looked up with the blanks around them, so only whole words count."""
    entries: dict[str, list] = {}
    for number, (phrase, _) in enumerate(phrases):
        entries.setdefault(f" {phrase} ", []).append((None, number))
    patterns = []
    for number, (notice, _) in enumerate(notices):
        edits = allowed_edits(notice)
        for offset, piece in seeds(notice, edits):
            entries.setdefault(piece, []).append((number, offset))
        bounded = f"(?:{regex.escape(notice, special_only=True)}){{e<={edits}}}"
        patterns.append((regex.compile(f"(?e){bounded}"), regex.compile(f"(?b){bounded}")))
    automaton = ahocorasick.Automaton()
    for piece, uses in entries.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton, patterns


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(windows):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _matches(patterns: tuple, padded: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) of the matches in a window, from the left; each is the best one that
    starts where the leftmost match lies."""
    leftmost, best = patterns
    while match := leftmost.search(padded, start, end):
        edits = sum(match.fuzzy_counts)
        if edits:
            match = best.search(padded, match.start(), min(end, match.end() + edits))
            edits = sum(match.fuzzy_counts)
        yield match.start(), match.end(), edits
        start = max(match.end(), start + 1)


def _overlaps(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Whether any of the sorted, disjoint stretches meets start..end."""
    i = bisect_left(ends, start + 1)
    return i < len(starts) and starts[i] < end


def _settle(spans: list[tuple]) -> list[tuple]:
    """Of spans that overlap, those with the fewest edits for the length of their notice."""
    kept: list[tuple] = []  # by share; those with a smaller share stand before
    starts: list[int] = []
    ends: list[int] = []
    for _, group in groupby(sorted(spans), key=lambda s: s[0]):
        free = [s for s in group if not _overlaps(starts, ends, s[1], s[2])]
        kept += free
        pairs = _merged([(s[1], s[2]) for s in kept])
        starts, ends = [p[0] for p in pairs], [p[1] for p in pairs]
    return sorted(kept, key=lambda k: k[1:])


def scan_words(words: str, notices: tuple = NOTICES, phrases: tuple = BASE_PHRASES) -> tuple[list, list]:
    """Places (phrase number, start) of the phrases, and spans (share of edits, start, end, notice
    number, edits) of the notices. Positions count characters of the words with a blank before
    and after."""
    automaton, patterns = _matcher(notices, phrases)
    padded = f" {words} "
    places, windows = [], {}
    for end, (length, uses) in automaton.iter(padded):
        start = end - length + 1
        for number, offset in uses:
            if number is None:
                places.append((offset, start + 1))
                continue
            notice = notices[number][0]
            edits = allowed_edits(notice)
            begin = start - offset
            windows.setdefault(number, []).append((max(0, begin - edits), min(len(padded), begin + len(notice) + edits)))
    spans = []
    for number, found in windows.items():
        for start, end in _merged(found):
            for first, last, edits in _matches(patterns[number], padded, start, end):
                spans.append((edits / len(notices[number][0]), first, last, number, edits))
    return places, _settle(spans)


def _word_numbers(padded: str, positions: set[int]) -> dict[int, int]:
    """Number of the word at or after each position, in one pass over the text."""
    out, last, blanks = {}, 0, 0
    for position in sorted(positions):
        blanks += padded.count(" ", last, position)
        out[position], last = blanks - 1 + (padded[position : position + 1] == " "), position
    return out


def _scan(batches: Iterator[pa.RecordBatch], notices: tuple, phrases: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        counts, all_places, all_spans = [], [], []
        for text in batch.column("text").to_pylist():
            words = plain_words(text)
            places, spans = scan_words(words, notices, phrases)
            padded = f" {words} "
            # a span starts and ends on a word, whatever blanks the edits took in
            trimmed = [(start + (padded[start] == " "), end - (padded[end - 1] == " ") - 1, number, edits) for _, start, end, number, edits in spans]
            at = _word_numbers(padded, {p for _, p in places} | {p for s in trimmed for p in s[:2]})
            counts.append(words.count(" ") + 1 if words else 0)
            all_places.append([{"label": phrases[n][1], "word": at[p]} for n, p in places])
            all_spans.append([
                {"label": notices[n][1], "first_word": at[a], "last_word": at[b], "edits": edits, "similarity": 1 - edits / len(notices[n][0]), "found": padded[a : b + 1]}
                for a, b, n, edits in trimmed
            ])
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_places, schema.field("places").type), pa.array(all_spans, schema.field("spans").type)]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def find_notices(docs: DataFrame, notices: tuple = NOTICES, phrases: tuple = BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_words, places and spans, one row per input row; nothing is shuffled.

    `places`: label and word number wherever the words of a phrase stand consecutively. `spans`:
    label, first and last word, edits, similarity (1 - edits by the notice's length) and the words
    found, wherever a stretch of the words is within the allowed edits of a notice (inserted,
    deleted or changed characters: one for ten, four at most). Matches of one notice do not
    overlap; of overlapping matches of several notices those with the smallest share of edits stay.

    Null or empty text: no words, empty arrays. Texts of any length are scanned whole. Repeated
    rows each give a row, an empty table gives none, a null id stays null, and other columns are
    ignored."""
    rows = input_columns(docs, doc_id=id_col, text=text_col)
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("found", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", place), ("spans", span)])
    ddl = (
        f"doc_id {output_field(rows, 'doc_id')}, n_words bigint, places array<struct<label: string, word: bigint>>, "
        "spans array<struct<label: string, first_word: bigint, last_word: bigint, edits: int, similarity: double, found: string>>"
    )
    return rows.mapInArrow(lambda it: _scan(it, notices, phrases, schema), ddl)


def license_digest(found: DataFrame) -> DataFrame:
    """One row of counts and labels per row of `find_notices`. `score` is the similarity of the
    best span, 1 where a phrase stands, and 0 with neither."""
    places = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform("spans", lambda s: s["label"])
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        "spans",
    )
