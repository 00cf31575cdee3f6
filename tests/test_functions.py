import zlib

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import arrays, code, hashing, outcomes, text


def one(spark, expression, **columns):
    literals = [F.lit(v).alias(k) for k, v in columns.items()]
    return spark.range(1).select(*literals).select(expression).first()[0]


@pytest.mark.parametrize("value", ["", "a", "name ", "größe", "x" * 300])
def test_adler32_equals_zlib(spark, value):
    assert one(spark, hashing.adler32("v"), v=value) == zlib.adler32(value.encode())


def test_tokenize_string_golden_and_round_trip(spark):
    raw = "isn't it nice?"
    tokens = one(spark, text.tokenize_string("v"), v=raw)
    assert tokens == "isn ' t ▁ it ▁ nice ?"
    assert one(spark, text.detokenize_string("v"), v=tokens) == raw


def test_tokenize_string_first_letter(spark):
    # the blank goes after every occurrence of the first letter
    assert one(spark, text.tokenize_string("v"), v="L 'L a") == "L▁ ' L▁ a"


@pytest.mark.parametrize(
    "raw,expected",
    [("a  b", "a b"), ("-" * 9 + " ok", "-" * 5 + " ok"), ("# !", ""), ("é", ""), ("éß", "éß"), ("--x-", "")],
)
def test_normalize_comment(spark, raw, expected):
    assert one(spark, text.normalize_comment("v"), v=raw) == expected


def test_strip_accents(spark):
    assert one(spark, text.strip_accents("v"), v="Élan ÜBER naïve") == "elan uber naive"


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("V@@ AR@@ _@@ 12 = 3", "VAR_12 = 3"),
        ("FUNC_1@@ 2@@ 3 (", "FUNC_123 ("),
        ("CLASS_@@ 0", "CLASS_0"),
        ("V@@ AR@@ _@@ 1@@ 2", "V@@ AR@@ _@@ 1@@ 2"),
    ],
)
def test_repair_identifiers(spark, raw, expected):
    assert one(spark, text.repair_identifiers("v"), v=raw) == expected


def test_repair_spaced_identifiers(spark):
    assert one(spark, text.repair_spaced_identifiers("v"), v="ĠV AR _ 1 2 x") == "Ġ VAR_12 x"


def test_restore_bpe(spark):
    assert one(spark, text.restore_bpe("v"), v="lo@@ w er@@") == "low er"


def test_class_name_back(spark):
    assert one(spark, text.id_from_class_name("v"), v="CLASS_aCLASS_b") == "aCLASS_b"


@pytest.mark.parametrize(
    "name,parts",
    [("countLines", {"count", "lines"}), ("HTTPServer", {"h", "t", "t", "p", "server"}), ("a-b.c", {"a", "b", "c"}), ("__x__", {"x"})],
)
def test_subtokens(spark, name, parts):
    assert set(one(spark, text.subtokens("v"), v=name)) == parts


def test_split_id_line_modes(spark):
    line = "7 | f ( x ) | y"
    assert one(spark, text.split_id_line("v", "rest"), v=line) == "f ( x ) | y"
    assert one(spark, text.split_id_line("v", "code"), v=line) == "f ( x )"
    assert tuple(one(spark, text.split_id_line("v", "pair"), v=line)) == ("7", "f ( x )")


def test_signature(spark):
    tokens = F.split(F.lit("static int [ ] f ( int [ ] a , Map < K , V > m ) { g ( ) ; }"), " ")
    df = spark.range(1).select(tokens.alias("t"))
    assert df.select(code.function_name("t")).first()[0] == "f"
    assert [tuple(a) for a in df.select(code.arguments("t")).first()[0]][0] == ("int [ ]", "a")
    empty = spark.range(1).select(F.split(F.lit("void f ( ) { }"), " ").alias("t"))
    assert [tuple(a) for a in empty.select(code.arguments("t")).first()[0]] == [("None", "None")]


@pytest.mark.parametrize(
    "function,supported",
    [
        ("int f ( int a , String b ) { }", True),
        ("void f ( int a ) { }", False),
        ("void f ( int [ ] a ) { }", True),
        ("void f ( ArrayList < Integer > a ) { }", True),
        ("int main ( int a ) { }", False),
        ("Map f ( int a ) { }", False),
        ("int f ( Map a ) { }", False),
        ("int f ( final int a ) { }", True),
        ("int f ( ) { }", True),
        ("no parentheses", False),
    ],
)
def test_supported_signature(spark, function, supported):
    assert one(spark, code.supported_signature(F.split("v", " ")), v=function) is supported


@pytest.mark.parametrize(
    "function,good",
    [("print ( x )", True), ("print x", False), ("raise E , 1", False), ("x = 10 L", False), ("d . iteritems ( )", False), ("xrange ( 3 )", False)],
)
def test_is_python3(spark, function, good):
    assert one(spark, code.is_python3("v"), v=function) is good


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("..\nRan 2 tests in 0.0s\n\nOK\n", ("success", 2, 0)),
        ("F\nRan 3 tests in 0.0s\n\nFAILED (failures=2)", ("failure", 3, 2)),
        ("F\nRan 3 tests in 0.0s\n\nFAILED (failures=1, errors=12)", ("failure", 3, 12)),
        ("Traceback", ("error", None, None)),
        ("", ("error", None, None)),
    ],
)
def test_python_outcome(spark, raw, expected):
    assert tuple(one(spark, outcomes.parse_outcome("v", "python"), v=raw)) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("[==========] Running 4 tests\nx\n[==========] 4 tests ran.\n[  PASSED  ] 4 tests.\n", ("success", 4, 0)),
        ("[==========] Running 4 tests\n[==========] 4 tests ran.\n\n 2 FAILED TESTS\n", ("failure", 4, 2)),
        ("segfault", ("error", None, None)),
    ],
)
def test_cpp_outcome(spark, raw, expected):
    assert tuple(one(spark, outcomes.parse_outcome("v", "cpp"), v=raw)) == expected


@pytest.mark.parametrize("raw,status", [("#Results:3,3", "success"), ("a\n#Results: 1, 3\n", "failure"), ("none", "error")])
def test_script_outcome(spark, raw, status):
    assert one(spark, outcomes.parse_outcome("v", "script"), v=raw)["status"] == status


@pytest.mark.parametrize(
    "raw,expected",
    [("('success', 3, 0)", ("success", 3, "0")), ("('error', 0, 'a, (b)')", ("error", 0, "a, (b)")), ("('timeout', None, \"x\")", ("timeout", None, "x"))],
)
def test_result_tuple(spark, raw, expected):
    assert tuple(one(spark, outcomes.parse_result_tuple("v"), v=raw)) == expected


def ids(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")


def test_pad_and_truncate(spark):
    df = spark.range(1)
    assert df.select(arrays.pad_ids(ids(7, 8), 6)).first()[0] == [1, 7, 8, 1, 2, 2]
    assert df.select(arrays.pad_ids(ids(7, 8, 9), 4)).first()[0] == [1, 7, 8, 1]
    assert df.select(arrays.pad_ids(ids(), 3)).first()[0] == [1, 1, 2]


def test_concat_pair(spark):
    a, b = ids(1, 7, 1), ids(1, 8, 9, 1)
    both = spark.range(1).select(arrays.concat_pair(a, b, 0, 1).alias("c")).first()["c"]
    assert both["ids"] == [1, 7, 1, 1, 8, 9, 1]
    assert both["positions"] == [0, 1, 2, 0, 1, 2, 3]
    assert both["langs"] == [0, 0, 0, 1, 1, 1, 1]
    shared = spark.range(1).select(arrays.concat_pair(a, b, 0, 1, False).alias("c")).first()["c"]
    assert shared["ids"] == [1, 7, 1, 8, 9, 1] and shared["positions"] == [0, 1, 2, 3, 4, 5]


def test_split_sentence_id(spark):
    r = spark.range(1).select(arrays.split_sentence_id(ids(5, 6, 4, 7, 4), 4).alias("r")).first()["r"]
    assert (r["head"], r["tail"]) == ([5, 6], [7, 4])


def test_until_eos(spark):
    assert spark.range(1).select(arrays.until_eos(ids(1, 7, 1, 8))).first()[0] == [7]
    assert spark.range(1).select(arrays.until_eos(ids(1, 7, 8))).first()[0] == [7, 8]


def test_broken_placeholders_of_any_length(spark):
    from corpusweave.functions import text

    df = spark.createDataFrame([("VAR_1@@ 2@@ 3@@ 4@@ 5@@ 6 x", "ĠVAR_1 2 3 4 5 6")], "a string, b string")
    row = df.select(text.repair_identifiers("a").alias("a"), text.repair_spaced_identifiers("b").alias("b")).first()
    assert row["a"] == "VAR_123456 x" and "VAR_123456" in row["b"]


def test_unknown_ids_read_alike_on_both_paths(spark, monkeypatch):
    from corpusweave.operators import vocab

    known = spark.createDataFrame([(514, "a"), (515, "b")], "id int, token string")
    df = spark.createDataFrame([(1, [1, 514, 900, 515, 1])], "row_id long, ids array<int>")
    small = vocab.ids_to_text(df, "row_id", "ids", known).first()["text"]
    monkeypatch.setattr(vocab, "LOOKUP_BYTES", 1)
    assert small == vocab.ids_to_text(df, "row_id", "ids", known).first()["text"] == "a <unk> b"


def test_long_function_ids_are_not_cut(spark):
    from corpusweave.plans import mining

    rows = [("f" * 63 + x, b, s, 1.0, c, "py") for x in "ab" for b, s, c in ((0, "failure", "bad " + x), (1, "success", "good " + x))]
    runs = spark.createDataFrame(rows, "func_id string, beam int, status string, value double, code string, lang string")
    found = mining.correction_pairs(runs)
    assert found.select("pair_id").distinct().count() == 2


def test_words_split_at_unicode_white_space(spark):
    value = "a\u00a0b\u3000c\u0085d\x1ce\x0bf\u2028g  h\u200bi"
    assert spark.createDataFrame([(value,)], "t string").select(text.words("t")).first()[0] == value.split()
