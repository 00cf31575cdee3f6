import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import augment, extract


def sentences(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id int, ids array<int>")


LISTS = [[1, *range(600, 600 + n), 1] for n in (0, 1, 2, 10, 50, 200)]


def test_mask_eval_masks_at_least_one(spark):
    out = sentences(spark, LISTS).select("id", augment.mask_eval("ids", "id", 0.0, 3).alias("ids")).collect()
    for r in out:
        original = LISTS[r.id]
        assert r.ids[0] == r.ids[-1] == 1 and len(r.ids) == len(original)
        assert r.ids.count(5) == (1 if len(original) > 2 else 0)


def test_mask_tokens_spares_first_and_padding(spark):
    df = sentences(spark, [[1, 600, 601, 1, 2, 2]])
    m = df.select(augment.mask_tokens("ids", "id", 1.0, 1000, (1.0, 0.0, 0.0), 1).alias("m")).first()["m"]
    assert m["ids"] == [1, 5, 5, 5, 2, 2] and m["targets"] == [None, 600, 601, 1, None, None]
    keep = df.select(augment.mask_tokens("ids", "id", 1.0, 1000, (0.0, 1.0, 0.0), 1).alias("m")).first()["m"]
    assert keep["ids"] == [1, 600, 601, 1, 2, 2]


def test_word_noise_invariants(spark):
    df = sentences(spark, LISTS)
    shuffled = {r.id: r.ids for r in df.select("id", augment.word_shuffle("ids", "id", 3, 1).alias("ids")).collect()}
    dropped = {r.id: r.ids for r in df.select("id", augment.word_dropout("ids", "id", 0.99, 1).alias("ids")).collect()}
    for i, original in enumerate(LISTS):
        assert sorted(shuffled[i]) == sorted(original) and shuffled[i][0] == shuffled[i][-1] == 1
        moved = [abs(original.index(x) - p) for p, x in enumerate(shuffled[i][1:-1], 1)]
        assert all(m <= 3 for m in moved)
        assert dropped[i][0] == dropped[i][-1] == 1 and (len(original) == 2 or len(dropped[i]) >= 3)


def test_noise_does_not_depend_on_partitions(spark):
    df = sentences(spark, LISTS)
    run = lambda d: {r.id: r.ids for r in augment.add_noise(d, "id", "ids", 3, 0.2, 0.2, 4, 1000, lam=2.0).collect()}
    assert run(df.repartition(1)) == run(df.repartition(5))


@pytest.mark.parametrize("options", [{"lam": 3.0}, {"fixed": 3}, {"fixed": 0}, {"fixed": 1}])
def test_span_mask_invariants(spark, options):
    out = augment.span_mask(sentences(spark, LISTS[1:]), "id", "ids", 0.3, 1000, seed=2, probs=(1.0, 0.0, 0.0), word_rand=0.0, **options)
    for r in out.collect():
        original = LISTS[1:][r.id]
        assert r.ids[0] == r.ids[-1] == 1
        rest = [x for x in r.ids if x != 5]
        assert rest == [x for x in original if x in set(rest)]
        budget = int(np.ceil(0.3 * len(original)))
        if options == {"fixed": 0}:
            assert len(r.ids) == len(original) + budget and r.ids.count(5) == budget
        if options == {"fixed": 1}:
            assert len(r.ids) == len(original) and r.ids.count(5) == min(budget, len(original) - 2)


def test_span_lengths():
    p = augment.span_lengths(lam=3.0)
    assert p.sum() == pytest.approx(1.0) and p[3] == pytest.approx(0.224, abs=1e-3)


OBF = [(1, "VAR_0 = FUNC_0 ( VAR_1 , VAR_0 )".split(), "FUNC_0 run | VAR_0 total | VAR_1 item")]


def test_deobfuscation(spark):
    df = spark.createDataFrame(OBF, "id int, tokens array<string>, dictionary string")
    assert augment.deobfuscate_occurrences(df, "id", "tokens", "dictionary", 1.0).first()["tokens"] == "total = run ( item , total )".split()
    assert augment.deobfuscate_occurrences(df, "id", "tokens", "dictionary", -1.0).first()["tokens"] == OBF[0][1]
    full = augment.deobfuscate_identifiers(df, "id", "tokens", "dictionary", 1.0, 100).first()
    hidden = [e.split(" ")[0] for e in full["dictionary"].split(" | ")]
    assert len(hidden) == 1 and hidden[0] in full["tokens"]
    none = augment.deobfuscate_identifiers(df, "id", "tokens", "dictionary", -1.0, 100).first()
    assert none["dictionary"] == OBF[0][2]
    assert augment.deobfuscate_identifiers(df, "id", "tokens", "dictionary", 0.5, 8).count() == 0


def python_tokens(spark, source, keep=False):
    df = spark.createDataFrame([(1, source)], "id int, code string")
    r = extract.tokenize_python(df, "id", "code", keep).first()
    return r["status"], r["tokens"]


@pytest.mark.parametrize(
    "source,tokens",
    [
        ("a = [3.14,4]", "a = [ 3.14 , 4 ] NEW_LINE"),
        ("def f(a):\n    a+=1\n    return a", "def f ( a ) : NEW_LINE INDENT a += 1 NEW_LINE return a NEW_LINE DEDENT"),
        ("#comment blabla\n''' lll coo\n# kkk ''' ", ""),
        ("a = 'it x'", "a = ' it ▁ x ' NEW_LINE"),
        ("a = ''' fff\nfff''' ", "a = ''' ▁ fff STRNEWLINE fff ''' NEW_LINE"),
        ("def f():\n    '''doc'''\n", "def f ( ) : NEW_LINE"),
        ("s = f'a{x}b'", "s = f' a { x } b ' NEW_LINE"),
    ],
)
def test_tokenize_python(spark, source, tokens):
    assert python_tokens(spark, source) == ("ok", tokens.split())


def test_tokenize_python_keeps_comments(spark):
    assert python_tokens(spark, "#comment blabla\na = 10", True)[1] == "# comment ▁ blabla ENDCOM a = 10 NEW_LINE".split()


@pytest.mark.parametrize("source", ["def f(:\n  ((", "a = '''x", "if x:\n   a\n  b"])
def test_broken_python_gives_a_status(spark, source):
    status, tokens = python_tokens(spark, source)
    assert status.startswith("error") and tokens is None


def functions_of(spark, text, lang):
    df = spark.createDataFrame([(1, text.split())], "id int, tokens array<string>")
    return [(r.kind, r.function) for r in extract.extract_functions(df, "id", "tokens", lang).orderBy("pos").collect()]


def test_python_functions(spark):
    inner = "def f ( self ) : NEW_LINE INDENT def g ( ) : NEW_LINE INDENT x NEW_LINE DEDENT DEDENT"
    plain = "def h ( a ) : NEW_LINE INDENT return a NEW_LINE DEDENT"
    old = "def p ( ) : NEW_LINE INDENT print x NEW_LINE DEDENT"
    found = functions_of(spark, f"import os NEW_LINE {inner} {plain} {old} def cut ( ) :", "python")
    assert found == [("class", inner), ("standalone", plain)]


def test_java_functions(spark):
    text = "class A { int x ; public static int f ( int a ) { if ( a ) { b ( ) ; } } int g ( ) throws E { } abstract int h ( ) ; }"
    assert functions_of(spark, text, "java") == [
        ("standalone", "public static int f ( int a ) { if ( a ) { b ( ) ; } }"),
        ("class", "int g ( ) throws E { }"),
    ]


def test_compile_check(spark):
    df = spark.createDataFrame([(1, "x = 1"), (2, "x ="), (3, None)], "id int, c string")
    assert [r[0] for r in df.orderBy("id").select(extract.python_compiles("c")).collect()] == [True, False, None]


def test_mask_weighted_counts(spark):
    df = sentences(spark, LISTS[3:]).withColumn("b", F.lit(0))
    weights = spark.createDataFrame([(i, 1.0) for i in range(600, 800)], "id int, weight double")
    picked = augment.mask_weighted(df, weights, "b", "id", "ids", 0.1, 1)
    assert picked.count() == int(np.ceil(0.1 * 3 * 202))
    assert picked.filter("token_id < 600").count() == 0


def test_mask_weighted_reads_its_rows_once_and_moves_them_whole(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = spark.createDataFrame([(1, 0, [1, 600, 700, 1]), (1, None, [1, 600, 600, 600, 1]), (2, 0, [1, 700, 2, 1]), (3, 0, None)], "id int, b int, ids array<int>")
    df = rows.mapInPandas(counted, rows.schema)
    weights = spark.createDataFrame([(i, 1.0) for i in (1, 2, 600, 700)], "id int, weight double")
    picked = augment.mask_weighted(df, weights, "b", "id", "ids", 1.0, 1)
    # rows of no batch, first positions and padding are not picked; a row without ids counts for the size
    assert sorted(map(tuple, picked.collect())) == [(0, 1, 1, 600), (0, 1, 2, 700), (0, 1, 3, 1), (0, 2, 1, 700), (0, 2, 3, 1)]
    assert made.value == rows.count()
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # slots are made above the shuffle


def test_source_pieces_bound_what_is_held_at_once():
    import pandas as pd

    from corpusweave.operators.extract import _source_pieces

    texts = ["abc", None, "d", "e" * 9, "", "fg", None]
    found = list(_source_pieces([pd.DataFrame({"id": range(7), "code": texts}), pd.DataFrame({"id": [7], "code": [None]})], 4))
    assert [p["id"].tolist() for p in found] == [[0, 1, 2], [3], [4, 5, 6], [7]]
    assert [t for p in found for t in p["code"]] == [*texts, None]


def test_function_rows_do_not_carry_their_whole_source(spark):
    """Rows of functions are as long as the functions, not as their sources."""
    df = spark.createDataFrame([(1, "def f ( self ) : NEW_LINE INDENT x DEDENT y".split(), 0)], "id int, tokens array<string>, n int")
    found = extract.extract_functions(df, "id", "tokens", "python")
    assert [(r.kind, r.pos, r.function) for r in found.collect()] == [("class", 0, "def f ( self ) : NEW_LINE INDENT x DEDENT")]

    def nodes(plan):
        yield plan
        below = plan.children()
        for i in range(below.size()):
            yield from nodes(below.apply(i))

    made = [n for n in nodes(found._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Generate"]
    assert made and all("tokens" not in n.output().toString() for n in made)
