import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators import batching, datastore, fusion, ivf, neighbours, vocab


def store_of(spark, pairs, **options):
    df = spark.createDataFrame(pairs, "pair_id int, source string, target string")
    counts = spark.createDataFrame([("x", 3), ("y", 2), ("z", 1)], "token string, count long")
    return datastore.build_datastore(df, vocab.build_vocab(counts), **options)


def test_datastore_rows_and_cut(spark):
    rows = store_of(spark, [(1, "a b", "x y q"), (2, "", "x " * 40)]).orderBy("pair_id", "pos").collect()
    first = [(r.value, r.prefix) for r in rows if r.pair_id == 1]
    assert first == [(514, ""), (515, "x"), (3, "x y"), (1, "x y q")]
    second = [r.value for r in rows if r.pair_id == 2]
    assert len(second) == 16 and second[-1] == 1 and second.count(1) == 1


def context_by_hand(values):
    out = []
    for i, v in enumerate(values):
        if v[1] == 1:
            out += ([values[i - 1]] if i else []) + [v]
    return sorted(out)


@pytest.mark.parametrize("targets", [["x y", "z"], ["", "x", ""], ["x", "", "", "y"], [""]])
def test_eos_context_equals_the_flat_scan(spark, targets):
    store = store_of(spark, [(i, "a", t) for i, t in enumerate(targets)])
    rows = [((r.pair_id, r.pos), r.value) for r in store.orderBy("pair_id", "pos").collect()]
    found = sorted(((r.pair_id, r.pos), r.value) for r in datastore.eos_context(store).collect())
    assert found == context_by_hand(rows)
    before = sorted((r.pair_id, r.pos) for r in datastore.pre_eos_rows(store).collect())
    assert before == sorted({k for k, v in context_by_hand(rows) if v != 1})


def fragments(spark, *rows):
    df = spark.createDataFrame(rows, "fail_input string, succ_prefix string")
    return sorted(tuple(r) for r in datastore.fragment_pairs(df).collect())


def test_fragment_window(spark):
    fail = "a b c d e f g h i j k"
    assert fragments(spark, (fail, "1 2 3 4")) == [(fail, "1 2 3 4")]
    assert fragments(spark, (fail, "1 2 3 4 5")) == [("b c d e f g h i", "2 3 4 5")]
    assert fragments(spark, ("a b", "1 2 3 4 5 6 7 8")) == []
    assert fragments(spark, ("", "1")) == []
    assert len(fragments(spark, (fail, "1"), (fail, "1"))) == 1


def test_renumber_identifiers(spark):
    df = spark.createDataFrame(
        [(1, "FUNC_7 ( VAR_12 , VAR_1 ) VAR_12 = VAR_1 + CLASS_3", "CLASS_3 C | FUNC_7 f | VAR_1 a | VAR_12 b | VAR_5 z")],
        "id int, code string, dictionary string",
    )
    r = datastore.renumber_identifiers(df, "id", "code", "dictionary").first()
    assert r.code == "FUNC_0 ( VAR_0 , VAR_1 ) VAR_0 = VAR_1 + CLASS_0"
    assert r.dictionary == "CLASS_0 C | FUNC_0 f | VAR_0 b | VAR_1 a"


# --- neighbours ---


def vectors(spark, matrix, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


def knn_by_hand(q, s, k):
    d = ((q[:, None, :].astype(np.float32).astype(float) - s[None, :, :].astype(np.float32)) ** 2).sum(axis=2)
    return {(i, j, r) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(s)), d[i]))[:k], 1)}


@pytest.mark.parametrize("path", ["broadcast", "blocks"])
def test_knn_with_ties(spark, monkeypatch, path):
    rng = np.random.default_rng(0)
    s = rng.integers(0, 3, size=(120, 4)).astype(float)
    q = rng.integers(0, 3, size=(30, 4)).astype(float)
    if path == "blocks":
        monkeypatch.setattr(neighbours, "fits_broadcast", lambda *a: False)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 17)
        monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    found = neighbours.knn_exact(vectors(spark, q, "query_id"), vectors(spark, s, "row_id"), 5)
    assert {(r.query_id, r.row_id, r["rank"]) for r in found.collect()} == knn_by_hand(q, s, 5)


def test_knn_smaller_store_than_k(spark):
    q, s = np.zeros((2, 3)), np.ones((2, 3))
    found = neighbours.knn_exact(vectors(spark, q, "query_id"), vectors(spark, s, "row_id"), 5)
    assert found.count() == 4


def test_ivf_full_probe_and_pq_recall(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=(300, 16))
    store, queries = vectors(spark, s, "row_id"), vectors(spark, s[:40] + 0.01, "query_id")
    centroids = ivf.train_ivf(store, 6)
    postings = ivf.assign_lists(store, centroids)
    exact = neighbours.knn_exact(queries, store, 4)
    full = ivf.knn_ivf(queries, postings, centroids, 4, 6)
    key = lambda df: {(r.query_id, r.row_id, r["rank"]) for r in df.collect()}
    assert key(full) == key(exact)
    books = ivf.train_pq(postings, centroids, 16, 8, 16)
    coded = ivf.encode_pq(postings, centroids, books)
    assert all(len(r.codes) == 8 for r in coded.collect())
    near = ivf.knn_ivfpq(queries, coded, centroids, books, 4, 6, rerank_with=store)
    assert ivf.recall_at_k(near, exact, 4).first()["recall"] > 0.7


def fuse(spark, near, own, **params):
    n = spark.createDataFrame(near, "query_id int, rank int, token int, distance double")
    m = spark.createDataFrame(own, "query_id int, rank int, token int, score double")
    return [(r.token, round(r.score, 6)) for r in fusion.fuse_scores(n, m, **params).orderBy("rank").collect()]


def test_fusion_edges(spark):
    near = [(0, 1, 7, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0)]
    own = [(0, 1, 9, 2.0), (0, 2, 8, 2.0)]
    assert fuse(spark, near, own, lambda_=0.0)[0] == (8, 0.5)  # met first among the neighbours
    assert fuse(spark, near, own, lambda_=1.0)[0] == (7, round(2 / 3, 6))
    assert fuse(spark, [(0, 1, 5, 0.0)], [(0, 1, 6, 0.0)], n=2) == [(5, 0.5), (6, 0.5)]
    with pytest.raises(ValueError):
        fuse(spark, near, own, beam="rank")


# --- batches ---


def test_budget_smaller_than_a_sentence(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (3, 1)], "id int, n int")
    batches = {r.id: r.batch for r in batching.token_batches(df, "id", ["n"], 2).collect()}
    assert batches == {3: 1, 1: 4, 2: 7}


def test_near_equal_batches(spark):
    df = spark.range(11)
    sizes = [r["count"] for r in batching.count_batches(df, ["id"], 4).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [4, 4, 3]


def pack_by_hand(sentences, bptt, lanes):
    stream = [x for s in sentences for x in [*s, 1]]
    n = -(-len(stream) // (lanes * bptt))
    size = n * bptt
    buffer = [1] * (size * lanes - len(stream)) + stream
    columns = [[1, *buffer[i * size : (i + 1) * size]] for i in range(lanes)]
    return {(b, i): c[b * bptt : (b + 1) * bptt] for i, c in enumerate(columns) for b in range(n)}


@pytest.mark.parametrize("lengths,bptt,lanes", [([3, 0, 7, 2, 30], 4, 2), ([3, 3, 7], 4, 2), ([1], 5, 3), ([15], 4, 4), ([2, 4], 8, 1)])
def test_pack_stream(spark, lengths, bptt, lanes):
    sentences = [[100 * i + j + 10 for j in range(n)] for i, n in enumerate(lengths)]
    df = spark.createDataFrame(list(enumerate(sentences)), "id int, ids array<int>")
    packed = {(r.block, r.lane): r.ids for r in batching.pack_stream(df, ["id"], "ids", bptt, lanes).collect()}
    assert packed == pack_by_hand(sentences, bptt, lanes)


@pytest.mark.parametrize("budget,kept", [(100, [0, 1, 2, 3]), (11, [0]), (3, []), (8, [0]), (7, [])])
def test_cap_by_tokens(spark, budget, kept):
    df = spark.createDataFrame([(0, 4, 2), (1, 1, 1), (2, 1, 4), (3, 1, 1)], "id int, a int, b int")
    out = batching.cap_by_tokens(df, ["id"], F.col("a"), F.col("b"), budget)
    assert sorted(r.id for r in out.collect()) == kept


def test_replay_buffer_keeps_the_last(spark):
    out = batching.replay_buffer(spark.range(25).withColumnRenamed("id", "seq"), "seq", 10)
    assert sorted(r.seq for r in out.collect()) == list(range(15, 25))


def test_heavy_tokens_are_looked_up_apart(spark, monkeypatch):
    words_ = ["hot"] * 400 + ["odd"] * 300 + [f"w{i}" for i in range(300)] + [None] * 5
    rows = spark.createDataFrame(list(enumerate(words_)), "n long, word string")
    known = spark.createDataFrame([("hot", 7), *((f"w{i}", i) for i in range(0, 300, 2))], "token string, id int")
    expected = {n: 7 if w == "hot" else int(w[1:]) if w and w[0] == "w" and int(w[1:]) % 2 == 0 else None for n, w in enumerate(words_)}
    small = vocab.lookup_tokens(rows, "word", known, "id")
    monkeypatch.setattr(vocab, "LOOKUP_BYTES", 0)
    large = vocab.lookup_tokens(rows, "word", known, "id")
    for found in (small, large):
        assert found.columns == ["n", "word", "id"]
        assert {r.n: r.id for r in found.collect()} == expected and found.count() == len(words_)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "strategy=broadcast" in plan


def test_block_topk_measures_copies_in_pieces(monkeypatch):
    taken, measure = [], neighbours.PIECE_PAIRS

    class Rows(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype.kind == "i":
                taken.append(len(key))
            return super().__getitem__(key)

    rows = np.zeros((3000, 2)).view(Rows)  # copies: every pair ties
    found = neighbours.block_topk(np.arange(20), np.zeros((20, 2)), np.arange(3000), rows, 2)
    assert found["row_id"].tolist() == [0, 1] * 20 and max(taken) <= measure


def test_small_datastores_cut_fragments_from_pairs(spark):
    """Fragments of the pairs are those of the store's rows; the prefixes are not read for them."""
    from corpusweave.plans import correction

    rows = [(1, "a_b", "x y z", "p q r s t u v w"), (2, "a_b", "x y z", "p q r s t u v w"), (3, "b_a", "", "k"), (4, "b_a", "m", ""), (5, "b_a", "m n o p q r", "a b c d e f")]
    pairs = spark.createDataFrame(rows, "pair_id long, language_pair string, source string, target string")
    unique = correction.unique_pairs(pairs)
    assert unique.count() == 2  # the repeated pair and those with an empty side are gone
    store = correction.datastore_from_unique(unique)
    slow, fast = correction.small_datastores(store), correction.small_datastores(store, unique)
    for part in ("eos", "pre_eos", "fragments"):
        assert sorted(map(str, slow[part].collect())) == sorted(map(str, fast[part].collect()))
    assert "__id" not in fast["fragments"]._jdf.queryExecution().optimizedPlan().toString()
