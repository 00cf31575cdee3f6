"""Tokens and functions of source code. Python's own tokenizer marks the pieces; literals,
filters and slicing stay in the JVM."""

from __future__ import annotations

import io
import tokenize as pytok
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.binding import let
from ..functions.code import is_python3
from ..functions.text import PYTHON_PIECES, normalize_comment, tokenize_literal

# Layout marks in token streams.
NEW_LINE, INDENT, DEDENT = "NEW_LINE", "INDENT", "DEDENT"
# Characters of source whose tokens a task holds as Python objects at a time; a longer source is on its own.
CHARS_AT_ONCE = 1 << 18
TOKEN_SCHEMA = "array<struct<kind:string,text:string>>"


def _python_marks(code: str) -> list[dict]:
    """(kind, text) of every token; kind is plain, string, comment or docstring."""
    marks: list[tuple[str, str]] = []
    fstring_start, depth = None, 0
    code = code.replace(r"\r", "").replace("\r", "")
    lines = code.splitlines(keepends=True)
    for token in pytok.tokenize(io.BytesIO(code.encode("utf-8")).readline):
        kind, text = pytok.tok_name[token.type], token.string
        if kind == "FSTRING_START":
            fstring_start, depth = (fstring_start or token.start), depth + 1
        elif kind == "FSTRING_END":
            depth -= 1
            if depth == 0:  # join the pieces of an f-string back into one literal
                (row, left), (last, right) = fstring_start, token.end
                piece = "".join(lines[row - 1 : last])
                tail = len(lines[last - 1]) - right
                marks.append(("string", piece[left : len(piece) - tail]))
                fstring_start = None
        elif depth or kind in {"ENCODING", "NL"}:
            continue
        elif kind == "ENDMARKER":
            break
        elif kind == "NEWLINE":
            marks.append(("newline", NEW_LINE))
        elif kind == "INDENT":
            marks.append(("plain", INDENT))
        elif kind == "DEDENT":
            if marks and marks[-1][1] == INDENT:
                marks.pop()  # empty block
            else:
                marks.append(("plain", DEDENT))
        elif kind == "COMMENT":
            marks.append(("comment", text))
        elif kind == "STRING":
            marks.append(("docstring" if text == token.line.strip() else "string", text))
        else:
            marks.append(("plain", text))
    return [{"kind": k, "text": t} for k, t in marks]


def _drop_docstrings(marks: list[dict]) -> list[dict]:
    """A removed docstring takes the next line end along."""
    out, pending = [], False
    for mark in marks:
        if mark["kind"] == "docstring":
            pending = True
        elif mark["kind"] == "newline" and pending:
            pending = False
        elif mark["kind"] == "plain" and mark["text"] == DEDENT and out and out[-1]["text"] == INDENT:
            out.pop()
        else:
            out.append(mark)
    return out


def _marks_or_error(code, keep_comments: bool):
    if code is None:
        return None, "error"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            marks = _python_marks(code)
    except (pytok.TokenError, SyntaxError, UnicodeError, ValueError) as problem:
        return None, f"error: {type(problem).__name__}"
    if not keep_comments:
        marks = _drop_docstrings([m for m in marks if m["kind"] != "comment"])
    return marks, "ok"


def _source_pieces(batches: Iterator[pd.DataFrame], most: int = CHARS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The rows of each batch in runs with about `most` characters of `code`."""
    for batch in batches:
        ends = np.cumsum([0 if text is None else len(text) for text in batch["code"]])
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + most, side="right")))
            yield batch.iloc[lo:hi].reset_index(drop=True)
            lo = hi


def tokenize_python(df: DataFrame, row_id: str, code: str, keep_comments: bool = False) -> DataFrame:
    """(row, status, tokens). Sources that do not tokenise get status `error…` and no tokens."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _source_pieces(batches):
            found = [_marks_or_error(text, keep_comments) for text in batch["code"]]
            yield pd.DataFrame({row_id: batch[row_id], "marks": [m for m, _ in found], "status": [s for _, s in found]})

    kind = dict(df.dtypes)[row_id]
    marked = df.select(row_id, F.col(code).alias("code")).mapInPandas(
        mark, f"`{row_id}` {kind}, marks {TOKEN_SCHEMA}, status string"
    )

    def literal(m: Column) -> Column:
        comment = tokenize_literal(m["text"], PYTHON_PIECES, comment=True)
        return (
            F.when(m["kind"].isin("plain", "newline"), m["text"])
            .when(m["kind"] == "string", tokenize_literal(m["text"], PYTHON_PIECES))
            .when(normalize_comment(m["text"]) == "", F.lit("")).otherwise(comment)
        )

    tokens = F.filter(F.transform("marks", literal), lambda t: t != "")
    return marked.select(row_id, "status", F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, " "))), lambda t: t != "").alias("tokens"))


def _python_spans(tokens) -> list[tuple[int, int]]:
    """[start, end) of every outermost `def … DEDENT`."""
    spans, i, n = [], 0, len(tokens)
    while i < n:
        if tokens[i] != "def":
            i += 1
            continue
        depth, j = 0, i + 1
        while j < n:
            depth += (tokens[j] == INDENT) - (tokens[j] == DEDENT)
            if tokens[j] == DEDENT and depth == 0:
                break
            j += 1
        if j == n:
            break
        spans.append((i, j + 1))
        i = j + 1
    return spans


# Tokens after which a function may start, and annotations that are left out.
JAVA_STARTS = {";", "}", "{", "*/", "ENDCOM", NEW_LINE, "\n"}


def _java_spans(tokens) -> list[tuple[int, int]]:
    """[start, end) of every brace-matched block behind `)` or `) throws X`."""
    solid = [i for i, t in enumerate(tokens) if not t.startswith(NEW_LINE)]
    order = {i: p for p, i in enumerate(solid)}
    spans, i, n = [], 0, len(tokens)
    while i < n:
        nxt = [tokens[j] for j in solid[order[i] + 1 : order[i] + 4]] if i in order else []
        opens = nxt[:1] == ["{"] or (nxt[:1] == ["throws"] and nxt[2:3] == ["{"])
        if tokens[i] != ")" or not opens:
            i += 1
            continue
        start = i
        while start >= 0 and tokens[start] not in JAVA_STARTS:
            start -= 1
        opening = {"*/": "/*", "ENDCOM": "//"}.get(tokens[start]) if start >= 0 else None
        if opening:  # the comment right before the header belongs to the function
            back = start
            while back >= 0 and tokens[back] != opening:
                back -= 1
            start = back if back >= 0 else start + 1
        else:
            start += 1
        j, depth = tokens.index("{", i), 0
        while j < n:
            depth += (tokens[j] == "{") - (tokens[j] == "}")
            if depth == 0:
                break
            j += 1
        spans.append((start, min(j + 1, n)))
        i = j + 1
    return spans


ANNOTATION = r"^@ (Override|Deprecated|SuppressWarnings) (\( .*? \) )"


def extract_functions(df: DataFrame, row_id: str, tokens: str, lang: str) -> DataFrame:
    """(row, kind, pos, function): `class` or `standalone` functions in order of appearance."""
    find = {"python": _python_spans, "java": _java_spans}[lang]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"start": a, "end": b} for a, b in find(list(t))] if t is not None else [])

    def function(s: Column) -> Column:
        body = F.slice(tokens, s["start"] + 1, s["end"] - s["start"])
        return let(body, lambda f: F.struct(f.alias("f"), F.array_join(f, " ").alias("t")))

    # cut before they become rows: a row holds its function, not all tokens of its source
    functions = df.select(row_id, tokens, spans(F.col(tokens)).alias("__s")).select(
        row_id, F.posexplode(F.transform("__s", function)).alias("pos", "__c")
    )
    cut = functions.select(row_id, "pos", F.col("__c.f").alias("__f"), F.col("__c.t").alias("__t"))
    text = F.col("__t")
    if lang == "python":
        after = F.get("__f", F.array_position("__f", "(").cast("int"))
        kind = F.when(after == "self", "class").otherwise("standalone")
        found = cut.filter(F.array_contains("__f", "(")).select(row_id, kind.alias("kind"), "pos", text.alias("function"))
        return found.filter(is_python3("function"))
    header = F.slice("__f", F.lit(1), F.array_position("__f", "{").cast("int") - 1)
    kind = F.when(F.array_contains(header, "static"), "standalone").otherwise("class")
    return cut.select(row_id, kind.alias("kind"), "pos", F.regexp_replace(text, ANNOTATION, "").alias("function"))


@F.pandas_udf(BooleanType())
def _compiles(sources: pd.Series) -> pd.Series:
    def check(source):
        if source is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(source, "source", "exec")
            return True
        except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError):
            return False

    return sources.map(check)


def python_compiles(code) -> Column:
    """Whether the text compiles as Python. It is only compiled, never run."""
    return _compiles(F.col(code) if isinstance(code, str) else code)


def explode_views(df: DataFrame, keys: list[str], views: list[str]) -> DataFrame:
    """One row per (document, view, item) from array-valued view columns."""
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("suffix"), F.col(v).alias("items")) for v in views]))
    long = df.select(*keys, stacked.alias("v")).select(*keys, "v.suffix", "v.items")
    return long.select(*keys, "suffix", F.posexplode("items").alias("pos", "content"))
