import random

import pytest
from pyspark.sql import functions as F

from corpusweave.functions.text import words
from corpusweave.operators import bpe, dedup, filters, joins, ordering, splits, vocab


def ids_of(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_dedup_lines_edges(spark):
    lines = [
        (1, "java", "a/b | x"), (2, "java", "c/d | x"), (3, "java", "no bar"), (4, "java", "nobar | a/b"),
        (5, "cpp", "a/b | x"), (6, "java", "a/b | x "),
    ]
    df = spark.createDataFrame(lines, "id long, suffix string, line string")
    kept = dedup.dedup_lines(df, "line", "id", ["suffix"])
    assert ids_of(kept) == [1, 5, 6]
    assert kept.filter("id = 1").first()["content"] == " x"


def test_dedup_pairs_without_separator(spark):
    df = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, "", "z"), (4, "q", "")], "id long, s string, t string")
    assert ids_of(dedup.dedup_pairs(df, "s", "t", "id")) == [1]


def test_first_by_order_column(spark):
    df = spark.createDataFrame([(1, "a", 9), (2, "a", 3)], "id long, k string, o int")
    assert ids_of(dedup.dedup_by_key(df, ["k"], "id", F.col("o"))) == [2]


def test_split_keeps_trailing_blank(spark):
    names = [(i, f"owner/repo{i}") for i in range(300)]
    df = spark.createDataFrame(names, "id long, repo string")
    plain = {r.id: r.split for r in splits.split_by_hash(df, "repo", 30, 30).collect()}
    blank = {r.id: r.split for r in splits.split_by_hash(df, F.concat("repo", F.lit(" ")), 30, 30).collect()}
    assert plain != blank and set(plain.values()) == {"train", "valid", "test"}
    whole = splits.split_by_hash(df, "repo", 50, 50)
    assert whole.filter("split = 'train'").count() == 0


def test_row_index_and_group_rank_with_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 < 6, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"))
    indexed = ordering.with_row_index(df, [F.desc("id")], "i").collect()
    assert all(r.i == 4999 - r.id for r in indexed)
    ranked = ordering.with_group_rank(df, ["g"], ["id"], "r").collect()
    expected, seen = {}, {}
    for r in sorted(ranked, key=lambda r: r.id):
        expected[r.id] = seen.get(r.g, 0)
        seen[r.g] = expected[r.id] + 1
    assert {r.id: r.r for r in ranked} == expected


def test_running_sums_with_null_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a", i) for i in range(200)], "id int, g string, v int")
    out = ordering.with_running(df, ["id"], group=["g"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}).collect()
    for r in out:
        same = [x for x in out if x.g == r.g and x.id <= r.id]
        assert r.s == sum(x.v for x in same) and r.m == max(x.v for x in same)


def test_capped_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).withColumnRenamed("id", "row")
    a = sorted(r.row for r in splits.capped_sample(df, 700, 1, "row").collect())
    b = sorted(r.row for r in splits.capped_sample(df.repartition(7), 700, 1, "row").collect())
    assert a == b and len(a) == 700
    assert splits.capped_sample(df, 5000, 1, "row").count() == 3000


def test_large_head_uses_the_rank(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("g"))
    assert ids_of(splits.head_per_group(df, ["g"], ["id"], 1500)) == list(range(3000))


def test_worker_slices_drop_the_remainder(spark):
    df = spark.range(10)
    assert ids_of(splits.worker_slice(df, ["id"], 2, 3)) == [6, 7, 8]
    assert splits.with_worker(df, ["id"], 3).filter("worker IS NULL").count() == 1


def test_equal_weights_and_draw_count(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "k string")
    equal = splits.sampling_weights(df, "k", -1)
    assert {r.weight for r in equal.collect()} == {0.5}
    assert splits.weighted_draw(equal, "k", 5, 1).count() == 2


# --- joins ---


def test_contains_join_equals_nested_loop(spark):
    texts = [(0, "the quick brown fox"), (1, "quick brown"), (2, "thequick  brownfox jumps"), (3, ""), (4, "brown\nfox quick brown fox")]
    snippets = [(0, "quick brown fox"), (1, "brown"), (2, "quick brown"), (3, "ick bro"), (4, "x"), (5, "zzz"), (6, " "), (7, ""), (8, "brown\nfox"), (9, "a the quick")]
    a = spark.createDataFrame(texts, "id long, text string")
    b = spark.createDataFrame(snippets, "sid long, snippet string")
    found = {(r.id, r.sid) for r in joins.contains_join(a, "id", "text", b, "sid", "snippet").collect()}
    assert found == {(i, j) for i, t in texts for j, s in snippets if s in t}
    none = joins.contains_join(a, "id", "text", b.limit(0), "sid", "snippet")
    assert none.count() == 0


@pytest.mark.parametrize("group_bytes", [1 << 20, 6])
def test_contains_join_of_any_group_size(spark, group_bytes):
    texts = [(0, "abc abcd", 1), (1, None, 2), (2, "", 3), (3, "été x", 4), (4, "ab" * 3000, 5), (None, "abc", 6), (0, "abc abcd", 1)]
    snippets = [(10, "abc"), (11, "abc"), (12, ""), (13, None), (14, "té"), (15, "bc abc"), (16, "ba"), (17, "abab" * 50), (18, "")]
    a = spark.createDataFrame(texts, "id long, text string, n int")
    b = spark.createDataFrame(snippets, "sid long, snippet string")
    found = joins.contains_join(a, "id", "text", b, "sid", "snippet", group_bytes)
    assert found.columns == ["id", "sid", "text", "n"]
    expected = [(i, j, t, n) for i, t, n in texts for j, s in snippets if t is not None and s is not None and s in t]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_contains_join_reads_texts_once_and_moves_none(spark):
    a = spark.createDataFrame([(1, "a b")], "id long, text string")
    b = spark.createDataFrame([(1, "b"), (2, " ")], "sid long, snippet string")
    plan = joins.contains_join(a, "id", "text", b, "sid", "snippet")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan


def test_append_next_token(spark):
    prefixes = spark.createDataFrame([(0, "a", "src"), (1, None, "src"), (2, "b", "src"), (3, None, "src"), (4, "c", None)], "i int, p string, s string")
    tokens = spark.createDataFrame([(0, "x"), (1, "y"), (2, None), (3, None), (4, "z")], "i int, t string")
    out = {r.i: r.p for r in joins.append_next_token(prefixes, tokens, "i", "p", "t", "s").collect()}
    assert out == {0: "a x", 1: "y", 2: "b ", 3: ""}


def test_success_failure_pairs(spark):
    runs = spark.createDataFrame(
        [(1, 0, "failure", "f0"), (1, 1, "success", "s1"), (1, 2, "success", "s2"), (1, 3, "timeout", "t"), (2, 0, "failure", "x")],
        "func_id int, beam int, status string, code string",
    )
    assert [(r.failure, r.success) for r in joins.success_failure_pairs(runs).collect()] == [("f0", "s1")]


@pytest.mark.parametrize(
    "beams,near,constrained,restricted,expected",
    [
        ([("a", True)], [("n", True)], True, True, ("a", "beam0")),
        ([("a", False), ("b", True)], [("n", True)], True, True, ("b", "constrained")),
        ([("a", False), ("b", True)], [("n", False)], False, True, ("n", "neighbour")),
        ([("a", False)], [("n", False), ("m", True)], True, True, ("m", "neighbour")),
        ([("a", False)], [("n", False)], True, True, ("a", "beam0")),
        ([("a", True)], [("n", False)], False, False, ("n", "neighbour")),
        ([("a", True)], [], False, False, ("a", "beam0")),
    ],
)
def test_choose_candidate(spark, beams, near, constrained, restricted, expected):
    kind = "array<struct<code:string,compiles:boolean>>"
    df = spark.createDataFrame([(beams, near)], f"f {kind}, n {kind}")
    assert tuple(df.select(joins.choose_candidate("f", "n", constrained, restricted)).first()[0]) == expected


def test_beam_columns_must_be_consecutive(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "id int, t_0 string, t_1 string, t_3 string")
    assert joins.beam_columns(df, "t_") == ["t_0", "t_1"]


def test_repeated_group_member_is_found(spark):
    df = spark.createDataFrame([("g", ["a", "b"]), ("h", ["b"])], "g string, m array<string>")
    assert [r.repo for r in joins.repeated_members(joins.invert_groups(df, "g", "m")).collect()] == ["b"]


# --- vocabulary ---


def small_vocab(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("<pad>", 5)], "token string, count long")
    return vocab.build_vocab(counts)


def test_vocab_ids(spark):
    built = small_vocab(spark)
    ids = {r.token: r.id for r in built.collect()}
    assert vocab.FIRST_ORDINARY == 514 and ids["<pad>"] == 2
    assert (ids["CLASS_0"], ids["FUNC_0"], ids["VAR_0"], ids["VAR_199"]) == (14, 114, 314, 513)
    assert (ids["c"], ids["a"], ids["b"]) == (514, 515, 516)
    assert filters.check_vocab(built, 514).count() == 0
    assert filters.check_vocab(built.filter("id <> 515"), 514).count() == 1


@pytest.mark.parametrize("limit", [None, 1])
def test_index_corpus_edges(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(vocab, "LOOKUP_BYTES", limit)  # the join path
    df = spark.createDataFrame([(1, "c zzz a"), (2, ""), (3, "</s> <special0> b"), (4, "VAR_0 <unk>")], "id int, text string")
    indexed = vocab.index_corpus(df.select("id", words("text").alias("t")), "id", "t", small_vocab(spark))
    assert {r.id: r.ids for r in indexed.collect()} == {1: [514, 3, 515, 1], 2: [1], 3: [516, 1], 4: [314, 3, 1]}


def test_truncate_vocab_needs_a_maximum(spark):
    built = small_vocab(spark)
    assert vocab.truncate_vocab(built, None, 5).count() == 517
    assert vocab.truncate_vocab(built, 600, 5).count() == 515


def test_top_counts_beyond_the_small_limit(spark, monkeypatch):
    monkeypatch.setattr(vocab, "SMALL_TOP", 10)
    rows = [(f"w{i:04d}", 1 + (i * 37) % 90) for i in range(2000)]
    counts = spark.createDataFrame(rows, "token string, count long")
    top = {(r.token, r["count"]) for r in vocab._top(counts, 555).collect()}
    assert top == set(sorted(rows, key=lambda r: (-r[1], r[0]))[:555])


def learn_by_hand(counts, n):
    state = {tuple([*w[:-1], w[-1] + "</w>"]): c for w, c in counts.items()}
    merges = []
    for _ in range(n):
        pairs = {}
        for symbols, c in state.items():
            for p in zip(symbols, symbols[1:]):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((*best, pairs[best]))
        fresh = {}
        for symbols, c in state.items():
            out, i = [], 0
            while i < len(symbols):
                if symbols[i : i + 2] == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            fresh[tuple(out)] = fresh.get(tuple(out), 0) + c
        state = fresh
    return merges


@pytest.mark.parametrize(
    "counts",
    [
        {"low": 5, "lower": 2, "newest": 6, "widest": 3},
        {"aaaa": 4, "aaab": 3, "baaa": 3, "abab": 5, "b.a$": 2, "a\\b": 2},
        {f"w{i}x{i % 3}y": 1 + i % 4 for i in range(30)},
    ],
)
def test_learn_bpe_equals_one_merge_at_a_time(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    learned = [(r.left, r.right, r["count"]) for r in bpe.learn_bpe(df, 25).orderBy("rank").collect()]
    assert learned == learn_by_hand(counts, 25)


@pytest.mark.parametrize("alphabet, words, merges, candidates", [("ab", 60, 40, 500), ("abc<w>/", 80, 40, 40), ("etaoinsh", 600, 120, 500)])
def test_learn_bpe_in_batches(spark, alphabet, words, merges, candidates):
    draw = random.Random(1)
    counts = {}
    for _ in range(words):
        word = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 9)))
        counts[word] = counts.get(word, 0) + draw.choice([1, 1, 2, 5])
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    learned = [(r.left, r.right, r["count"]) for r in bpe.learn_bpe(df, merges, candidates=candidates).orderBy("rank").collect()]
    assert learned == learn_by_hand(counts, merges)


def test_learn_bpe_of_few_words(spark):
    df = spark.createDataFrame([("a", 5), ("", 2), ("ab", 1)], "word string, count long")
    assert [tuple(r) for r in bpe.learn_bpe(df, 9).collect()] == [(0, "a", "b</w>", 1)]
    assert bpe.learn_bpe(df.limit(0), 9).count() == 0


def test_apply_bpe_joins_codes_of_any_number(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 12))) for _ in range(200)]
    codes = bpe.learn_bpe(spark.createDataFrame([(w, 1) for w in set(words)], "word string, count long"), 40)
    rows = [(i, [draw.choice(words) for _ in range(draw.randint(0, 20))]) for i in range(30)] + [(90, ["", None, "zz"]), (91, None), (92, [words[0]] * 500), (0, ["dup"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    shared, joined = (sorted(map(tuple, bpe.apply_bpe(df, "id", "t", codes, most).collect()), key=str) for most in (1 << 20, 0))
    assert shared == joined and len(shared) == len(rows)


def test_apply_bpe(spark):
    codes = spark.createDataFrame([("l", "o", 0), ("lo", "w</w>", 1)], "left string, right string, rank int")
    df = spark.createDataFrame([(1, ["low", "lows"]), (2, []), (3, ["", None])], "id int, t array<string>")
    assert {r.id: r.text for r in bpe.apply_bpe(df, "id", "t", codes).collect()} == {1: "low lo@@ w@@ s", 2: "", 3: ""}


def test_weighted_draws_by_range_equal_the_literal_table(spark, monkeypatch):
    weights = spark.createDataFrame([(f"k{i:02}", 0.5 if i == 3 else 0.5 / 29) for i in range(30)], "k string, weight double")
    rows = spark.range(500)
    drawn = lambda: {r.id: r.choice for r in splits.weighted_choice(rows, weights, "k", 4, "id").collect()}
    literal = drawn()
    monkeypatch.setattr(splits, "LITERAL_KEYS", 5)
    assert len(literal) == 500 and drawn() == literal


def test_token_pieces_bound_what_is_held_at_once():
    import pyarrow as pa

    from corpusweave.operators.vocab import token_pieces

    lists = [["a"] * n for n in (3, 0, 4, 9, 1, 2)] + [None, ["b"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["id", "t"])
    found = list(token_pieces([batch], 1, 5))
    assert [p.column(0).to_pylist() for p in found] == [[0, 1], [2], [3], [4, 5, 6], [7]]
    assert [t for p in found for t in p.column(1).to_pylist()] == lists
    assert [p.num_rows for p in token_pieces([batch], 1)] == [8]


def test_apply_bpe_takes_a_bounded_number_of_tokens_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 3)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "tokens": [["low", "lo"], ["low"], [], ["lower", "w", "low", "o"]]})
    runs = list(bpe._segmented(iter([batch]), "id", {("l", "o"): 0, ("lo", "w</w>"): 1}))
    assert [b.column(0).to_pylist() for b in runs] == [[1, 2, 3], [4]]
    assert [t for b in runs for t in b.column(1).to_pylist()] == ["low l@@ o", "low", "", "lo@@ w@@ e@@ r w low o"]
