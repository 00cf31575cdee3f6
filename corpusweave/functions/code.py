"""Predicates and signature parts of functions written as space-separated tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col

# Text that marks file access, Python 2, and the argument types kept.
IO_MARKS = ["java.io.File(", "io.FileWriter", "zip.ZipFile"]
IO_EXCEPTION = "IOException"
PYTHON2_PATTERNS = [r"print [^(]", r"raise \w+ ,", r"except \w+ ,", r"[^ ]+ = \d+ L"]
PYTHON2_TEXTS = [
    ". iterkeys ( )",
    ". itervalues ( )",
    ". iteritems ( )",
    "xrange (",
    "imap (",
]
PRIMITIVE_TYPES = ["short", "int", "long", "float", "double", "boolean", "char"]
BOXED_TYPES = ["Double", "Float", "String", "Integer", "Boolean", "Long", "Short"]
SIMPLE_TYPES = PRIMITIVE_TYPES + BOXED_TYPES
SUPPORTED_TYPES = (
    SIMPLE_TYPES + [f"{t}[]" for t in SIMPLE_TYPES] + [f"ArrayList<{t}>" for t in SIMPLE_TYPES]
)
IDENTIFIER_LIMITS = ["VAR_200", "FUNC_200", "CLASS_100"]


def _any(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def uses_io(value) -> Column:
    raw = _col(value)
    packed = F.replace(raw, F.lit(" "), F.lit(""))
    return _any([packed.contains(mark) for mark in IO_MARKS]) | raw.contains(IO_EXCEPTION)


def is_python3(value) -> Column:
    raw = _col(value)
    old = [raw.rlike(f"(?U){p}") for p in PYTHON2_PATTERNS]
    return ~_any(old + [raw.contains(t) for t in PYTHON2_TEXTS])


def usable_test(value) -> Column:
    raw = _col(value)
    return ~raw.contains("try ") & ~raw.contains("catch(") & raw.contains("assert ")


def assert_count(value) -> Column:
    raw = _col(value)
    gone = F.replace(raw, F.lit("assert "), F.lit(""))
    return ((F.length(raw) - F.length(gone)) / len("assert ")).cast("int")


def too_many_identifiers(dictionary) -> Column:
    """True when an identifier dictionary mentions a placeholder over the limits."""
    return _any([_col(dictionary).contains(mark) for mark in IDENTIFIER_LIMITS])


def _argument_tokens(tokens: Column) -> Column:
    """Tokens strictly inside the first balanced pair of parentheses."""
    opening = F.greatest(F.array_position(tokens, "(").cast("int"), F.lit(1))
    tail = F.slice(tokens, opening, F.size(tokens))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("closed_at")
    )

    def step(acc, token):
        depth = acc["depth"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        seen = acc["seen"] + 1
        closed = F.when((acc["closed_at"] == 0) & (depth == 0), seen).otherwise(acc["closed_at"])
        return F.struct(depth.alias("depth"), seen.alias("seen"), closed.alias("closed_at"))

    closed_at = F.aggregate(tail, start, step, lambda acc: acc["closed_at"])
    end = F.when(closed_at == 0, F.size(tail)).otherwise(closed_at)
    return F.slice(tail, F.lit(2), F.greatest(end - 2, F.lit(0)))


def _argument(text: Column) -> Column:
    """One `type name [ ]` argument → struct(type, name); brackets move to the type."""
    marks = F.array_join(F.regexp_extract_all(text, F.lit(r"(\[ \])"), F.lit(1)), " ")
    bare = F.when(marks == "", text).otherwise(F.replace(text, marks, F.lit("")))
    parts = F.split(F.regexp_replace(F.trim(bare), " +", " "), " ")
    kind = F.array_join(
        F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(marks)), " "
    )
    return F.struct(kind.alias("type"), F.element_at(parts, -1).alias("name"))


def arguments(tokens) -> Column:
    """Array of struct(type, name); an empty list gives one `None` entry."""
    inside = F.array_join(_argument_tokens(_col(tokens)), " ")
    none = F.array(F.struct(F.lit("None").alias("type"), F.lit("None").alias("name")))
    return F.when(inside == "", none).otherwise(F.transform(F.split(inside, ","), _argument))


def function_name(tokens, lang: str = "java") -> Column:
    array = _col(tokens)
    if lang == "python":
        return F.get(array, F.array_position(array, "def").cast("int"))
    return F.get(array, F.array_position(array, "(").cast("int") - 2)


def return_type(tokens) -> Column:
    array = _col(tokens)
    return F.get(array, F.array_position(array, "(").cast("int") - 3)


def supported_signature(tokens) -> Column:
    """Only simple argument and return types; `void` needs an array or list argument."""
    types = F.transform(arguments(tokens), lambda a: a["type"])
    plain = F.transform(types, lambda t: F.replace(F.replace(t, F.lit("final "), F.lit("")), F.lit(" "), F.lit("")))
    allowed = F.array(*[F.lit(t) for t in SUPPORTED_TYPES + ["None"]])
    result = return_type(tokens)
    mutable = F.exists(
        types,
        lambda t: F.replace(t, F.lit(" "), F.lit("")).contains("[]")
        | t.contains("List")
        | t.contains("Array"),
    )
    fine = (
        (F.size(F.array_except(plain, allowed)) == 0)
        & result.isin(*SUPPORTED_TYPES, "void")
        & ~((result == "void") & ~mutable)
        & (F.trim(function_name(tokens)) != "main")
    )
    return F.coalesce(fine, F.lit(False))
