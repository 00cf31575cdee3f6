"""Token ids of whole texts as the tokenizers library gives them, one library call per new piece.

Both pre-tokenizers that are known here never join characters across the start of a blank-led
piece, so a text's ids are the ids of its pieces in a row. Pieces repeat, hence the cache. Texts
that contain an added token, and other tokenizer files, go to the library whole."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part

#: White space of the library's patterns (fixed value).
BLANKS = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that end at an ASCII sign, where both patterns end a word too: "word," is two pieces.
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_SIGNS = r"!-/:-@\[-`{-~"
#: Such a word; a run of other characters with the space before it; the rest of a blank run.
PIECE = re.compile(f" ?[{_LETTERS}]++(?=[{_SIGNS}])| ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]")
CUT = re.compile(f"(?<=[^{BLANKS}])(?= [^{BLANKS}])")
#: Characters of one text that are held as pieces at a time.
SLICE_CHARS = 1 << 20
#: Bytes of pieces and ids that a worker remembers; beyond it, it starts afresh.
CACHE_BYTES = 160 << 20
_ENTRY_BYTES = 160  # of Python objects for one piece
#: A sign between pieces that go to the library as one text, and how many do.
MARK = "|"
TOGETHER = 64


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def _known(spec: dict) -> bool:
    """Whether ids of pieces in a row are the ids of the text: byte-level pieces without
    normaliser, or words and signs found by a pattern that drops white space."""
    added = spec.get("added_tokens") or []
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) or spec.get("post_processor"):
        return False
    split, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if split.get("type") == "ByteLevel":
        return norm is None and split["use_regex"] and not split["add_prefix_space"]
    if split.get("type") == "Sequence" and norm and norm["type"] == "Sequence":
        first, *rest = split["pretokenizers"]
        kinds = [n["type"] for n in norm["normalizers"]]
        words = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
        plain = [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"]
        return words and plain and r"[^\s\p{L}\p{N}]+" in first["pattern"]["Regex"] and kinds == ["NFC", "Replace", "Lowercase"]
    return False


def _drops_blanks(spec: dict) -> bool:
    """Whether a known tokenizer's pattern takes no white space into any word."""
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", "[^")
    return " " not in pattern and r"\s" not in pattern


class Encoder:
    """ids as bytes of unsigned integers, `width` bytes each, little-endian."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.piecewise = _known(spec)
        self.folds = self.piecewise and spec["normalizer"] is not None
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids if self.folds and _drops_blanks(spec) else []
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece. Where white space parts words and is dropped, pieces are encoded as
        one text, with a sign of one id between them that none of them contains."""
        if self.mark is None:
            return self._direct(pieces)
        out: list[bytes] = []
        parts = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([f" {MARK} ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(ids == self.mark).tolist()
            if len(at) != len(part) - 1:  # a piece gave the sign too
                out += self._direct(part)
                continue
            data, width = ids.tobytes(), self.dtype.itemsize
            out += [data[(lo + 1) * width : hi * width] for lo, hi in zip([-1, *at], [*at, len(ids)], strict=True)]
        return out

    def _slices(self, text: str) -> Iterator[str]:
        """Slices that start at a piece; a text without blanks stays whole."""
        start = 0
        while len(text) - start > SLICE_CHARS and (cut := CUT.search(text, start + SLICE_CHARS)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        split = [PIECE.findall(t) for t in texts]
        missing = list(set().union(*split).difference(self.cache))
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            ids = self._apart(part)
            self.cache.update(zip(part, ids, strict=True))
            self.held += sum(map(len, part)) + sum(map(len, ids)) + _ENTRY_BYTES * len(part)
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """ids of each whole text, special tokens of the text handled as the library does."""
        out: list[bytes] = []
        short: list[str] = []

        def flush():
            out.extend(self._by_pieces(short))
            short.clear()

        for text in texts:
            # the library lower-cases after composing characters, which ASCII texts do not need
            plain = text.lower() if self.folds and text.isascii() else text
            by_pieces = self.piecewise and not any(a in plain for a in self.added)
            if by_pieces and len(plain) <= SLICE_CHARS:
                short.append(plain)
                continue
            flush()
            out.append(b"".join(self._by_pieces([s])[0] for s in self._slices(plain)) if by_pieces else self._direct([text])[0])
        flush()
        return out

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.dtype)


@lru_cache(maxsize=4)
def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder per worker process; its cache lives on between tasks."""
    return Encoder(path, cache_bytes)
