"""Stages of the pipeline against brute force, and a whole run on a written table."""

import collections
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from corpusweave.llm.encoding import tokenizer_path
from corpusweave.llm.quality import train_quality

from .conftest import LOWER, WORD
from .test_operators import _brute_components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    """Documents with unique ids: good prose, junk, exact and near copies, null, empty and long texts."""
    draw = random.Random(9)
    good = [f"wort{i}" for i in range(400)]
    prose = lambda n: " ".join(draw.choice(good) for _ in range(n))
    texts = [prose(draw.randint(80, 160)) for _ in range(120)]
    texts += [t.upper() for t in texts[:10]] + texts[10:20]
    for t in texts[20:35]:
        words = t.split()
        words[draw.randrange(len(words))] = "anders"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "kurz", prose(30000), "## $$ " * 60] + ["%% && " + prose(60) for _ in range(10)]
    return [(i, t, "de", f"s{i % 3}" if i % 8 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def written(spark, corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("%%" not in (t or "%%")), 0) for i, t, *_ in corpus if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_brute_force(spark, corpus, written):
    docs = spark.read.parquet(f"{written}/documents.parquet")
    kept = pipeline.quality(spark, docs, written)
    model = train_quality(docs, spark.read.parquet(f"{written}/labels.parquet"))
    assert model is not None and kept.columns == docs.columns
    good = {r[0] for r in kept.collect()}
    for i, text, *_ in corpus:
        words = WORD.findall(text or "")
        if len(words) < 50:
            assert i not in good
        elif "%%" not in text and "$" not in text:
            windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
            if not any(n > 1 for n in windows.values()):
                assert i in good  # clean documents stay

    left = pipeline.exact(spark, docs, written)
    best = {}
    for row in corpus:
        best[(row[1] or "").translate(LOWER)] = row
    assert _rows(left) == sorted(best.values(), key=str)

    apart = pipeline.near(spark, left, written)
    component = {i: c for i, _, c in (eval(x) for x in _brute_components([r[:3] for r in best.values()]))}
    assert _rows(apart) == sorted((r for r in best.values() if component[r[0]] == r[0]), key=str)

    mixed = collections.Counter(map(tuple, pipeline.mix(spark, apart, written).collect()))
    size = collections.defaultdict(int)
    taken = collections.defaultdict(int)
    for row in apart.collect():
        n = len(WORD.findall(row.text or ""))
        size[row.source] += n
        taken[row.source] += n * mixed[tuple(row)]
    assert set(mixed) <= set(map(tuple, apart.collect())) and max(mixed.values()) <= 2
    longest = max(len(WORD.findall(r.text or "")) for r in apart.collect())
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    target, open_, rest = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, 1.5 * sum(size.values())
    while open_:
        share = rest / sum(open_.values())
        capped = [s for s, w in open_.items() if w * share >= 2 * size[s]]
        if not capped:
            target |= {s: w * share for s, w in open_.items()}
            break
        for s in capped:
            target[s] = 2 * size[s]
            rest -= target[s]
            del open_[s]
    assert all(abs(taken[s] - target[s]) <= longest for s in sources)


def test_run_on_a_written_table(spark, written):
    pieces = pipeline.run(spark, written).collect()
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{written}/documents.parquet").collect()}
    copies = collections.Counter(r.doc_id for r in pieces if r.piece == 0)
    assert copies and max(copies.values()) <= 2
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    for i, n in copies.items():
        assert total[i] == n * (len(own.encode(texts[i] or "", add_special_tokens=False).ids) + 1)
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 4096


def test_awkward_rows_and_empty_tables(spark, docs):
    rows = docs.select("doc_id", "text", "source", "size", "row")
    kept = pipeline.exact(spark, rows, "")
    texts = [(r.text or "").lower() for r in kept.collect()]
    assert kept.columns == rows.columns and len(texts) == len(set(texts)) == len({(r.text or "").lower() for r in rows.collect()})
    apart = pipeline.near(spark, kept, "")
    assert 0 < apart.count() < len(texts) and apart.columns == rows.columns
    mixed = pipeline.mix(spark, apart, "")
    assert mixed.columns == rows.columns and max(r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()) <= 2
    none = rows.limit(0)
    for stage in (pipeline.exact, pipeline.near, pipeline.mix, pipeline.pack):
        assert stage(spark, none, "").count() == 0


def test_stage_names_and_rows():
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]
