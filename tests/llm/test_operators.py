"""Every operator against brute force on a small table with the awkward cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusweave.llm import attention as net
from corpusweave.llm import components as components_of
from corpusweave.llm import jaccard, language_model
from corpusweave.llm.components import components
from corpusweave.llm.encoding import Encoder, tokenizer_path
from corpusweave.llm.exact_dedup import exact_duplicates
from corpusweave.llm.language_model import held_out, score_texts
from corpusweave.llm.mixing import mix_sources
from corpusweave.llm.packing import pack_documents, plan_bins
from corpusweave.llm.quality import LONGS, SYMBOLS, keep_good, score_quality, train_quality
from corpusweave.llm.sharding import shard_by_bytes
from corpusweave.llm.token_counts import count_tokens, encode_in_chunks
from corpusweave.llm.token_files import read_token_files, write_token_files
from corpusweave.llm.warc import read_captures, write_archives

from .conftest import LOWER, WORD


def _key(x):
    return (x is not None, x)


def test_exact_duplicates(docs, rows_of, none):
    groups = collections.defaultdict(list)
    for i, t, _ in rows_of:
        groups[(t or "").translate(LOWER)].append(i)
    expected = sorted(((i, max(g, key=_key), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=str)
    found = exact_duplicates(docs, block_bytes=64).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == expected
    assert sum(r.kept for r in found) == len(groups) and all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_duplicates(none).count() == 0


def test_shards(docs, rows_of, none):
    found = shard_by_bytes(docs, 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows_of)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_bytes(none).count() == 0


def test_mix(docs, rows_of, none):
    found = mix_sources(docs).collect()
    assert len(found) == len(rows_of)
    assert sum(r.size for r in found) == sum(len(WORD.findall(t or "")) for _, t, _ in rows_of)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in found)
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mix_sources(none).count() == 0


@pytest.mark.parametrize("kind", ["files", "counts"])
def test_tokens(spark, docs, rows_of, none, kind):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {(i, t): own.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows_of}
    if kind == "counts":
        found = count_tokens(docs, chunk_chars=4096, overlap_chars=64).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted((str(i), len((t or "").encode()), len(ids[i, t]), len(ids[i, t]) > 512) for i, t, _ in rows_of)
        assert count_tokens(none).count() == 0
        return
    found = read_token_files(spark, write_token_files(docs), with_ids=True).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in found) == sorted((str(i), ids[i, t] + [2]) for i, t, _ in rows_of)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == list(np.cumsum([0] + [r.n_tokens for r in order[:-1]]))
    assert [_key(r.doc_id) for r in order] == sorted(_key(r.doc_id) for r in order)
    assert read_token_files(spark, write_token_files(none)).count() == 0


def test_chunks_equal_whole_texts():
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for text in ("it's  a test\n\n of chunks, isn't it? " * 40, "a" * 900, "x <|endoftext|>  y" * 50, " \n" * 300, "été " * 200):
        whole = own.encode(text, add_special_tokens=False).ids
        for chunk, overlap in ((20, 5), (64, 16), (200, 30)):
            assert [i for run in encode_in_chunks(own, text, chunk, overlap) for i in run] == whole


def test_packing(docs, rows_of, none):
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found = pack_documents(docs, capacity=256).collect()
    expected = []
    for i, t, _ in rows_of:
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        expected += [(str(i), k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0] + [n for _, n in places[:-1]])) and sum(n for _, n in places) <= 256
    assert len(bins) <= max(-(-sum(r.length for r in found) // 256), sum(r.length > 128 for r in found)) + 1
    assert pack_documents(none).count() == 0


def test_plan_uses_every_piece_once():
    draw = np.random.default_rng(1)
    counts = {int(k): int(n) for k, n in zip(*np.unique(draw.integers(1, 400, 3000), return_counts=True), strict=True)}
    plan, used = plan_bins(counts, 400), collections.Counter()
    for bins, combination in plan:
        assert sum(k * n for k, n in combination.items()) <= 400
        for k, n in combination.items():
            used[k] += n * bins
    assert used == counts


def _brute_components(rows):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[label[k]] = min(low.get(label[k], i), i)
    return sorted(str((i, len(sets[k]), low.get(label[k]))) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("side", [8, 1024])
def test_jaccard(docs, rows_of, none, monkeypatch, side):
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    found = jaccard.similar_documents(docs).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == _brute_components(rows_of)
    if side > 8:
        assert jaccard.similar_documents(none).count() == 0


def test_quality(spark, docs, rows_of, none):
    found = {(r.doc_id, r.n_words): r for r in score_quality(docs, None).collect()}
    for i, t, _ in rows_of:
        t = t or ""
        w = WORD.findall(t)
        often = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = found[i, len(w)]
        assert [r[c] for c in LONGS] == [len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)]
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert score_quality(none, None).count() == 0
    assert train_quality(docs, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")) is None
    assert keep_good(docs, None).columns == docs.columns


def test_quality_on_held_out_labels(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = train_quality(texts, labels.filter("doc_id % 2 = 0"))
    judged = score_quality(texts, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "base_failed", labels["quality"].alias("good")).collect()
    right = [r.kept == (r.good == 1) for r in judged if not r.base_failed]
    assert sum(right) >= 0.97 * len(right)


def test_tiles_in_batches_of_every_size(monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 10)
    tiles = {2: 3, 5: 30, 6: 8, 7: 1, 9: 9, 11: 27}
    g = np.concatenate([np.full(n, k) for k, n in tiles.items()])
    row = np.arange(len(g)) + 100
    table = pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), 50)), pa.array(row)], ["g", "n", "row"])
    expected = {(1, int(k), int(r)) for k, r in zip(g, row, strict=True) if tiles[k] > 8}
    expected |= {(0, int(a), int(b)) for i, a in enumerate(row) for j, b in enumerate(row) if a < b and g[i] == g[j] and tiles[g[i]] <= 8}
    for size in range(1, len(g) + 1):
        parts = jaccard._pairs_and_tiles(iter([table.slice(lo, size) for lo in range(0, len(g), size)]), 80)
        found = [tuple(r.values()) for part in parts for r in part.to_pylist()]
        assert len(found) == len(set(found)) and set(found) == expected, size


def test_heaps_of_few_links(spark, monkeypatch):
    """Most of a heap stays apart: links are found, and no task gets much more than two sides."""
    monkeypatch.setattr(jaccard, "SIDE", 16)
    draw, dealt = np.random.default_rng(1), []
    sets = [np.sort(draw.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(200)]
    alike = [(3, 150), (150, 77), (20, 21), (98, 199)]
    for a, b in alike:
        sets[b] = np.sort(np.append(sets[a][1:], np.uint64(b)))
    heaps = spark.createDataFrame([(i, 0) for i in range(200)], "row bigint, heap bigint")
    arrays = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "row bigint, data binary")
    deal = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda rows, *rest, **named: dealt.append(rows.groupBy("tile", "i", "j").count().agg({"count": "max"}).first()[0]) or deal(rows, *rest, **named))
    links = jaccard._join_heaps(heaps, arrays, 80)
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {3: 3, 77: 3, 150: 3, 20: 20, 21: 20, 98: 98, 199: 98}
    assert len(dealt) == 3 and max(dealt) < 5 * 16


def test_components_take_rounds_of_few_tasks(spark, monkeypatch):
    """Many shuffle partitions bring a small table no file and task each; equal links are one."""
    odd = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {key: spark.conf.get(key) for key in odd}
    try:
        for key, value in odd.items():
            spark.conf.set(key, value)
        draw = random.Random(5)
        chain = [(i, i + 1) for i in range(1, 40)]
        pairs = chain + chain[:20] + [(1000, 2000 + i) for i in range(300)] + [(draw.randrange(3000, 3300), draw.randrange(3300, 3600)) for _ in range(250)]
        draw.shuffle(pairs)
        top = {}

        def root(x):
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            top[high] = low
        landed, land = [], components_of.land
        monkeypatch.setattr(components_of, "land", lambda *a: landed.append(land(*a)) or landed[-1])
        links = spark.createDataFrame([draw.sample(p, 2) for p in pairs], "a long, b long").repartition(3)
        found = components(links).collect()
        assert sorted((r.node, r.component) for r in found) == sorted((x, root(x)) for x in list(top))
        assert max(len(t.inputFiles()) for t in landed) <= spark.sparkContext.defaultParallelism
        assert components(links.filter("a < 0")).count() == 0
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)


def test_language_model(docs, rows_of, none):
    found = sorted(score_texts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    counts, train = collections.Counter(), 0
    for i, t, _ in rows_of:
        if not held_out(i):
            own = WORD.findall((t or "").translate(LOWER)) + ["\n"]
            counts.update(own)
            train += len(own)
    for r, (i, t, _) in zip(found, sorted(rows_of, key=lambda x: (str(x[0]), len(WORD.findall(x[1] or "")))), strict=True):
        own = WORD.findall((t or "").translate(LOWER)) + ["\n"]
        base = sum(np.log10((counts[w] + 0.1) / (train + 0.1 * (len(counts) + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(own), sum(counts[w] > 0 for w in own), train)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert score_texts(none).count() == 0


def test_learning_leaves_an_id_out_of_all_its_own_counts():
    """The shares that an id learns from are those counted without it."""

    def counts(ids):
        classes = np.arange(5)
        pairs = np.zeros((net.CLASSES + 1, net.CLASSES))
        np.add.at(pairs, (classes[ids[:-1]], classes[ids[1:]]), 1)
        smooth = np.bincount(ids, minlength=5) + 0.5
        return smooth, pairs

    def shares(smooth, pairs, own):
        after = pairs.sum(1) + 5.0
        pair = ((pairs + 5 * own) / after[:, None]).astype(np.float32)
        totals = smooth.sum(), np.bincount(np.arange(5), smooth, net.CLASSES), after
        none, n = np.zeros(0, np.uint64), np.zeros(0)
        return net.Shares(np.arange(5), smooth / smooth.sum(), np.ones(5), pair, totals, np.ones(5, bool), none, n, none, n)

    ids = np.array([0, 1, 2, 1, 3, 4])
    smooth, pairs = counts(ids)
    own = np.full(net.CLASSES, 1 / net.CLASSES)
    lengths, rarer = np.array([len(ids)]), np.zeros((2, len(ids)), np.float32)
    learnt = net.describe(ids, lengths, shares(smooth, pairs, own), rarer, np.arange(len(ids)))[2]
    for at in range(1, len(ids)):
        less, without = smooth.copy(), pairs.copy()
        less[ids[at]] -= 1
        without[ids[at - 1], ids[at]] -= 1
        outside = net.describe(ids, lengths, shares(less, without, own), rarer)[2]
        assert np.allclose(learnt[at, 0], outside[at, 0], rtol=1e-5)
        assert np.allclose(learnt[at, 1], outside[at, 1], rtol=1e-4)


def test_language_model_knows_rarer_continuations(docs, monkeypatch):
    monkeypatch.setattr(language_model, "ROUNDS", 0)  # weights as they begin, the counts alone differ
    whole = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs).collect()}
    monkeypatch.setattr(language_model, "MOST_EDGES", 40)
    monkeypatch.setattr(language_model, "MOST_STARTS", 20, raising=False)
    found = {(r.doc_id, r.n_tokens): r.score for r in score_texts(docs).collect()}
    assert found.keys() == whole.keys() and all(abs(found[k] - x) < 1e-6 * abs(x) for k, x in whole.items())


def test_language_model_reads_every_window_in_one_round():
    lengths = np.array([1, 700, 5000, 48, 96000])
    names = np.array([5, -7, 9, 1 << 62, -(1 << 62)])
    text, at = net.windows(lengths)
    found = language_model.turns(names, text, at)
    assert set(found.tolist()) == set(range(language_model.ROUNDS)) and np.bincount(found.astype(int)).min() > len(at) / 4
    alone = np.concatenate([language_model.turns(names[[t]], np.zeros((text == t).sum(), int), at[text == t]) for t in range(5)])
    assert (found == alone).all()  # not by the rows around it


def test_language_model_learns_from_few_windows(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "one short text")], "doc_id long, text string")
    assert not held_out(1)
    learnt = score_texts(rows).first().score
    monkeypatch.setattr(language_model, "ROUNDS", 0)
    assert score_texts(rows).first().score != learnt


def test_warc(spark):
    rows = [(3, "http://a/b c?d", "<p>x</p>"), (1, "http://a/\r\nb", "<p>x</p>"), (1, "http://a/\r\nb", "<p>x</p>"), (2, None, None), (5, "http://[", ""), (None, "u", "é"), (7, "u", "same but\r\n\r\nnot")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(pages.repartition(2))
    found = read_captures(spark, manifest).collect()
    kept = sorted(str((r.page_id, r.response.record_type, r.response.payload_bytes, r.response.refers_to)) for r in found)
    expected = [(3, "revisit", 8, 1), (1, "response", 8, None), (1, "revisit", 8, 1), (2, "response", 0, None), (5, "revisit", 0, 2), (None, "response", 2, None), (7, "response", 15, None)]
    assert kept == sorted(map(str, expected))
    assert all(r.request and r.metadata for r in found)
    assert {r.page_id: r.response.payload for r in found if r.response.record_type == "response"}[None] == "é"
    assert read_captures(spark, write_archives(pages.filter("page_id < 0"))).count() == 0


def test_rows_are_added_as_one_by_one():
    draw = np.random.default_rng(3)
    for index in (draw.integers(0, 7, (5, 40)), np.zeros((0, 4), np.int64)):
        rows = draw.standard_normal((*index.shape, 3)).astype(np.float32)
        found, wanted = np.zeros((2, 9, 3), np.float32)
        net.add_rows(found, index, rows)
        for i, row in zip(index.ravel(), rows.reshape(-1, 3), strict=True):
            wanted[i] += row
        assert found.tobytes() == wanted.tobytes()


def test_learning_steps_are_those_of_each_weight_by_itself():
    draw = np.random.default_rng(5)
    lengths = np.array([1, 130, 2000])
    ids = draw.integers(0, 300, lengths.sum())
    counted = draw.random((len(ids), 3)).astype(np.float32)
    described = np.roll(ids, 1), ids, counted, draw.integers(0, net.LEVELS, len(ids)), np.cumsum(lengths) - lengths
    text, at = net.windows(lengths)
    start = net.initial()
    found = net.train(start, described, lengths, text, at, 0.02)
    own = {k: x.copy() for k, x in start.items()}
    m, s = ({k: np.zeros_like(x) for k, x in own.items()} for _ in range(2))
    for step, lo in enumerate(range(0, len(text), net.BATCH // 2), 1):
        part = slice(lo, lo + net.BATCH // 2)
        for k, g in net.gradients(own, net.gather(described, lengths, text[part], at[part])).items():
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
            own[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    assert {k: x.tobytes() for k, x in found.items()} == {k: x.tobytes() for k, x in own.items()}
    assert all((start[k] == x).all() for k, x in net.initial().items())


def test_pieces_go_to_the_library_together():
    own, sent = Encoder(tokenizer_path("word_bpe_49k.json")), []

    class Library:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **named):
            sent.extend(texts)
            return self.of.encode_batch_fast(texts, **named)

    draw = random.Random(7)
    signs = [chr(c) for c in [*range(33, 127), 0x301, 0x308, 0x1112, 0x1161, 0xA0, 0x212B, 0x37E, 0x200D, 0xFF5C, 0x4E00, *range(0xC0, 0x180)]]
    words = ["".join(draw.choice(signs) for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    pieces = [*words, *(" " + w for w in words), " ", "\t\n", "|", " ||", "a|b", "'s", ""]
    assert own._apart(pieces) == own._direct(pieces)
    own.tokenizer = Library(own.tokenizer)
    own.encode([" ".join(w for w in words if "|" not in w)])
    assert 0 < len(sent) < len(words) / 20


def test_windows_gathered_together_are_those_of_each_batch(monkeypatch):
    monkeypatch.setattr(net, "GATHERED", 12)
    draw = np.random.default_rng(9)
    lengths = np.array([1, 130, 2000, 3])
    ids = draw.integers(0, 20, lengths.sum())
    described = np.roll(ids, 1), ids, draw.random((len(ids), 3)).astype(np.float32), draw.integers(0, net.LEVELS, len(ids)), np.cumsum(lengths) - lengths
    text, at = net.windows(lengths)
    w, covered = net.initial(), []
    for part, batch in net.batches(described, lengths, text, at, 4):
        alone = net.gather(described, lengths, text[part], at[part])
        assert batch.keys() == alone.keys() and all((batch[k] == alone[k]).all() for k in alone)
        assert net.log_probability(w, batch).tobytes() == net.log_probability(w, alone).tobytes()
        pairs = set()
        for i, (t, begin) in enumerate(zip(text[part], at[part], strict=True)):
            own = ids[described[4][t] :][: lengths[t]]
            for q in range(begin, min(begin + net.SCORED, lengths[t])):
                pairs |= {(i * net.SCORED + q - begin) * net.WINDOW + p - begin + net.CONTEXT for p in range(max(0, begin - net.CONTEXT), q) if own[p] == own[q]}
        known = alone["real"][:, None, :] & alone["scored"][:, :, None]
        assert set(batch["same"][known.ravel()[batch["same"]]].tolist()) == pairs
        covered.append(part)
    assert covered[0].start == 0 and covered[-1].stop == len(text) and all(a.stop == b.start for a, b in zip(covered, covered[1:], strict=False))


def test_beginnings_of_words_and_lookups_one_by_one():
    draw = np.random.default_rng(11)
    lengths = np.array([1, 40, 500, 2])
    ids, first = draw.integers(0, 30, lengths.sum()), np.cumsum(lengths) - lengths
    ends_word = draw.random(31) < 0.3
    plain = np.zeros(len(ids), np.uint64)
    for i in range(len(ids)):
        if i not in first and not ends_word[ids[i - 1]]:
            plain[i] = net.follow(plain[i - 1 : i], ids[i - 1 : i])[0]
    assert (net.beginnings(ids, first, ends_word) == plain).all()
    wanted = np.flatnonzero(draw.random(len(ids)) < 0.2)
    assert (net.beginnings(ids, first, ends_word, wanted)[wanted] == plain[wanted]).all()
    for keys in (np.unique(draw.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)), np.zeros(0, np.uint64), np.array([0, 1, 2, (1 << 64) - 1], np.uint64)):
        asked = np.concatenate([keys, keys + np.uint64(1), draw.integers(0, 1 << 63, 50).astype(np.uint64)])
        at, hit = net.listed(keys, net.slots(keys), asked)
        assert hit.tolist() == np.isin(asked, keys).tolist() and (keys[at[hit]] == asked[hit]).all()


def test_places_of_windows():
    lengths = np.array([100, 0, 3])
    first = np.cumsum(lengths) - lengths
    text, at = np.array([0, 2]), np.array([48, 0])
    assert net.window_places(lengths, text, at).tolist() == [*range(first[0] + 32, first[0] + 96), *range(first[2], first[2] + 3)]
