"""Text clean-up and marking functions. Each takes and returns a Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let
from .hashing import _col, content_id

# Reserved identifier prefixes and the marks for white space in literals.
NAME_PREFIXES = ["VAR_", "FUNC_", "CLASS_"]
SPACE_MARK = "▁"
NEWLINE_MARK = "STRNEWLINE"
TAB_MARK = "TABSYMBOL"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: A token: no character that Unicode or ASCII control codes count as white space. Stated as the
#: ranges that are left, printable ASCII first: a negated class of many ranges costs several times as much.
WORD = (
    r"[!-~\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xa1-\u167f\u1681-\u1fff\u200b-\u2027"
    r"\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}]+"
)


def words(value) -> Column:
    """Tokens between Unicode white space, no empty strings."""
    return F.regexp_extract_all(_col(value), F.lit(WORD), F.lit(0))


def protect_names(value) -> Column:
    """Lower-case the reserved prefixes, so that raw text can not look like a placeholder."""
    out = _col(value)
    for prefix in NAME_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(prefix.lower()))
    return out


def _single_spaces(value: Column) -> Column:
    return F.regexp_replace(value, " +", " ")


# Pieces of Python literals that must survive punctuation splitting.
COMMENT_START = "#"
PYTHON_PIECES = ["#", "\\n", '"""', "'''"]
END_COMMENT = "ENDCOM"
# every kind of white space, not only ASCII
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
_HOLD = 0xE000  # private-use characters stand in for protected pieces


def tokenize_literal(value, pieces: list[str] | None = None, comment: bool = False) -> Column:
    """Text of a string literal or comment → space-separated tokens with white-space marks.

    `pieces` stay whole; a comment is normalised first and closed by an end mark."""
    out = normalize_comment(value) if comment else _col(value)
    for char, mark in ((" ", SPACE_MARK), ("\n", NEWLINE_MARK), ("\t", TAB_MARK)):
        out = F.replace(out, F.lit(char), F.lit(f" {mark} "))
    held = {piece: chr(_HOLD + i) for i, piece in enumerate(pieces or [])}
    for piece, mark in held.items():
        out = F.replace(out, F.lit(piece), F.lit(f" {mark} "))
    if COMMENT_START in held:
        def closed(text: Column) -> Column:
            end = F.when(
                text.contains(f" {NEWLINE_MARK} "),
                F.regexp_replace(text, f"(?s)^(.*?) {NEWLINE_MARK} ", f"$1 {END_COMMENT}"),
            ).otherwise(F.concat(text, F.lit(f" {END_COMMENT}")))
            return F.when(F.trim(text).startswith(held[COMMENT_START]), end).otherwise(text)

        out = let(out, closed)
    out = _single_spaces(out)
    out = F.regexp_replace(out, r"(\P{N})(\p{P})", "$1 $2 ")
    out = F.regexp_replace(out, r"(\p{P})(\P{N})", " $1 $2")
    out = F.regexp_replace(out, r"(\p{S})", " $1 ")
    out = F.trim(F.regexp_replace(out, WHITE_SPACE, " "))
    for piece, mark in held.items():
        out = F.replace(out, F.lit(mark), F.lit(piece))

    def rejoined(text: Column) -> Column:
        first = F.substring(text, 1, 1)
        return F.when(
            first.rlike(r"^\p{L}$"), F.replace(text, F.concat(first, F.lit(" ")), first)
        ).otherwise(text)

    return let(out, rejoined)


def tokenize_string(value) -> Column:
    return tokenize_literal(value)


def detokenize_string(value) -> Column:
    return F.replace(F.replace(_col(value), F.lit(" "), F.lit("")), F.lit(SPACE_MARK), F.lit(" "))


def normalize_comment(value) -> Column:
    """Collapse spaces, cut long character runs to five, blank out wordless comments."""
    return let(
        F.regexp_replace(_single_spaces(_col(value)), r"(.)\1{4,}", "$1$1$1$1$1"),
        lambda out: F.when(F.length(F.regexp_replace(out, r"(?U)\W", "")) < 2, F.lit("")).otherwise(out),
    )


@F.pandas_udf(StringType())
def _fold_accents(texts: pd.Series) -> pd.Series:
    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")

    return texts.map(fold, na_action="ignore")


def strip_accents(value) -> Column:
    """Lower-case and drop combining marks. Unicode decomposition has no Spark built-in."""
    return _fold_accents(F.lower(_col(value)))


def restore_bpe(value) -> Column:
    return F.regexp_replace(_col(value), r"(@@ )|(@@ ?$)", "")


def repair_identifiers(value) -> Column:
    """Re-join placeholders (`VAR_12`) that sub-word splitting broke with `@@ ` joints."""
    out = _col(value)
    for prefix in NAME_PREFIXES:
        broken = "(?:@@ )?".join(prefix)
        out = F.regexp_replace(out, rf"{broken}(?:@@ )?([0-9]+(?:$| ))", f"{prefix}$1")
        out = _join_digits(out, prefix, "@@ ")
    return out


def _join_digits(value: Column, prefix: str, joint: str) -> Column:
    """Any number of pieces in one pass: each match goes on where the last one ended."""
    return F.regexp_replace(value, rf"((?:{prefix}|(?!^)\G)[0-9]+){joint}(?=[0-9])", "$1")


def repair_spaced_identifiers(value) -> Column:
    """The same repair for byte-level sub-words, where the pieces are split by spaces."""
    out = _col(value)
    # fixed values: prefixes as byte-level sub-words break them
    for broken, prefix in (("CLASS _ ", "CLASS_"), ("FUN C _ ", "FUNC_"), ("V AR _ ", "VAR_")):
        out = F.replace(out, F.lit(broken), F.lit(prefix))
    for prefix in NAME_PREFIXES:
        out = F.replace(out, F.lit(f"Ġ{prefix}"), F.lit(f"Ġ {prefix}"))
        out = _join_digits(out, prefix, " ")
    return out


def class_name(value) -> Column:
    return F.concat(F.lit("CLASS_"), content_id(value))


def id_from_class_name(value) -> Column:
    """Inverse of `class_name`: only the first `CLASS_` goes."""
    return F.regexp_replace(_col(value), r"(?s)^(.*?)CLASS_", "$1")


def clip(value, n: int = 150) -> Column:
    return F.substring(_col(value), 1, n)


def escape_unk(value) -> Column:
    return F.replace(_col(value), F.lit("<unk>"), F.lit("<<unk>>"))


def parse_dictionary(value) -> Column:
    """`"VAR_0 x | FUNC_0 f"` → map."""
    return F.str_to_map(_col(value), F.lit(r" \| "), F.lit(" "))


def format_dictionary(mapping) -> Column:
    """Map → text, keys in string order."""
    entries = F.array_sort(F.map_entries(_col(mapping)))
    return F.array_join(
        F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), " | "
    )


def subtokens(value) -> Column:
    """Distinct snake-case parts of an identifier."""
    marks = "-. \t\n\x0b\f\r"

    def snake(plain: Column) -> Column:
        rest = F.regexp_replace(F.substring(plain, F.lit(2), F.length(plain)), "([A-Z])", "_$1")
        return F.concat(F.lower(F.substring(plain, 1, 1)), F.translate(rest, UPPER, LOWER))

    plain = F.translate(_col(value), marks, "_" * len(marks))
    return F.array_remove(F.array_distinct(F.split(snake(plain), "_")), "")


def split_id_line(value, mode: str = "rest") -> Column:
    """Lines `id | code`. `rest`: all after the id; `pair`: struct(id, code); `code`: field 1."""
    parts = F.split(_col(value), r" \| ")
    if mode == "rest":
        return F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " | ")
    code = F.get(parts, F.lit(1))
    if mode == "code":
        return code
    return F.struct(F.get(parts, F.lit(0)).alias("id"), code.alias("code"))
