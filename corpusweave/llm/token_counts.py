"""Token counts of whole texts, huge ones by overlapping chunks.

Method: a huge document is encoded in overlapping chunks with offsets. Two neighbouring chunks
are spliced where both start a word of the pre-tokenizer at the same place, far enough from the
ends that neither could have seen the text otherwise. Without such a place the overlap is widened."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import input_columns, output_field, text_slices
from .encoding import BLANKS, encoder, tokenizer_path

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
LIMIT = 512
_IS_BLANK = re.compile(f"[{BLANKS}]")


class _Chunk:
    """An encoded stretch of a text: ids, and the token at which each word starts."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        self.start, self.end = start, end
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.ids = found.ids
        words, offsets = found.word_ids, found.offsets
        self.words = {}
        for i, (word, (at, _)) in enumerate(zip(words, offsets, strict=True)):
            if i == 0 or word is None or word != words[i - 1]:
                self.words.setdefault(start + at, i)


def _splice(left: _Chunk, right: _Chunk, text: str, after: int, margin: int) -> int | None:
    """The last place where both start a word that the cut ends can not have moved: the left one
    saw `margin` characters beyond it, the right one saw the character before it."""
    def stable(p: int) -> bool:
        return not _IS_BLANK.match(text, p + (text[p] == " "))

    places = [p for p in left.words.keys() & right.words.keys() if after < p and right.start + 1 < p and p + margin <= left.end and stable(p)]
    return max(places, default=None)


def encode_in_chunks(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """ids of the whole text in runs, as one call of the library would give them.

    A pre-tokenizer looks back no further than the start of a word, and ahead by one character
    after it, a contraction or an added token; `margin` covers these. So a common start of a word
    is a true one by induction from the start of the text, and what follows it is alike."""
    longest = max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    margin = max(8, longest + 4)
    left, known, used = _Chunk(tokenizer, text, 0, min(len(text), chunk)), -1, 0
    while left.end < len(text):
        width = overlap
        while True:
            start = left.end - width
            if start <= max(known, left.start) + 1:  # no stable place at all: a longer chunk from the last one
                left = _Chunk(tokenizer, text, left.start, min(len(text), left.end + (left.end - left.start)))
                used = left.words[known] if known >= 0 else 0
                break
            right = _Chunk(tokenizer, text, start, min(len(text), start + max(chunk, 2 * width)))
            place = _splice(left, right, text, known, margin)
            if place is not None:
                yield left.ids[used : left.words[place]]
                left, known, used = right, place, right.words[place]
                break
            width *= 2
    yield left.ids[used:]


def _count(batches: Iterator[pa.RecordBatch], schema: pa.Schema, path: str, limit: int, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in text_slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        huge = {i for i, t in enumerate(texts) if len(t) > chunk}
        whole = iter(own.encode(t for i, t in enumerate(texts) if i not in huge))
        tokens = [sum(map(len, encode_in_chunks(own.tokenizer, t, chunk, overlap))) if i in huge else len(next(whole)) // own.dtype.itemsize for i, t in enumerate(texts)]
        n_bytes = [len(t.encode()) for t in texts]
        columns = [batch.column("doc_id"), n_bytes, tokens, [n > limit for n in tokens]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row.

    No shuffle: rows stay in their tasks, which hold about a megabyte of text and one chunk.
    Null and empty texts have no tokens. Repeated rows and null ids are counted like any other.
    A text without blanks is encoded in one piece. An empty table gives none. Other columns are
    ignored."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    rows = input_columns(docs, doc_id=id_col, text=text_col)
    ddl = f"doc_id {output_field(rows, 'doc_id')}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("doc_id", first.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

        def all_batches():
            yield first
            yield from batches

        yield from _count(all_batches(), schema, path, limit, chunk_chars, overlap_chars)

    return rows.mapInArrow(run, ddl)
