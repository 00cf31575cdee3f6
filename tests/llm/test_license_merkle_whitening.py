"""License scan, Merkle manifest and whitening against brute force, with the awkward cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.llm import whitening
from corpusweave.llm.license_scan import BASE_PHRASES, NOTICES, allowed_edits, find_notices, license_digest, plain_words, scan_words, seeds
from corpusweave.llm.merkle import fold, merkle_manifest, sweep_down, sweep_up
from corpusweave.llm.whitening import eigenvectors, whiten

from .conftest import LOWER

# --- license scan ------------------------------------------------------------------------

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _distances(notice, text):
    """Fewest edits of the notice for a stretch of the text that ends at each place."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j - 1] + (c != d), before[j] + 1, row[-1] + 1))
        before = row
    return before


def _edited(draw, notice, edits):
    s = list(notice)
    for _ in range(edits):
        i, kind = draw.randrange(len(s)), draw.random()
        if kind < 0.33:
            s[i] = draw.choice("abcde ")
        elif kind < 0.66:
            s.insert(i, draw.choice("abcde "))
        else:
            del s[i]
    return "".join(s)


def test_seeds_cover_the_notice():
    for notice, _ in NOTICES:
        pieces = seeds(notice, allowed_edits(notice))
        assert "".join(p for _, p in pieces) == notice and len(pieces) == allowed_edits(notice) + 1
        assert all(notice[o : o + len(p)] == p for o, p in pieces)


def test_spans_have_the_fewest_edits():
    draw = random.Random(11)
    for _ in range(400):
        number = draw.randrange(len(NOTICES))
        notice = NOTICES[number][0]
        words = plain_words("aa the und " * draw.randint(0, 2) + _edited(draw, notice, draw.randint(0, allowed_edits(notice) + 1)) + " bb or" * draw.randint(0, 2))
        spans, padded = scan_words(words)[1], f" {words} "
        least = min(_distances(notice, padded))
        own = [s for s in spans if s[3] == number]
        if least <= allowed_edits(notice):  # found, or another notice fits better there
            assert any(s[4] == least for s in own) or any(s[0] < least / len(notice) for s in spans)
        else:
            assert not own
        for _, start, end, _, edits in own:
            assert _distances(notice, padded[start:end])[-1] <= edits <= allowed_edits(notice)


def test_better_notice_wins_and_repeats_count():
    labels = lambda t: [NOTICES[s[3]][1] for s in scan_words(plain_words(t))[1]]
    assert labels("Licensed under CC BY-SA 4.0.") == ["cc-by-sa"]
    assert labels("Licenced under CC-BY-NC, 4.0") == ["cc-by-nc"]
    assert labels("Released under the MIT License.\n" * 3) == ["mit"] * 3
    assert labels("the mit released under a license by the way") == []


@pytest.fixture(scope="module")
def license_docs(spark):
    draw = random.Random(7)
    filler = ["wald", "haus", "mit", "license", "apache", "general", "public", "the", "under", "été", "x9"]
    texts = [" ".join(draw.choice(filler) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    texts += [_edited(draw, n, 1).upper() + "!" for n, _ in NOTICES]
    texts += [None, "", " \n", "MIT-License mit_license MIT  LICENSE", "mitlicense permit license", "mit license mit license", "GNU General\nPublic License"]
    texts += ["word " * 60000 + "Released under teh MIT License " + "word " * 1000, "mit license " * 5000]
    rows = [(i, t, i, i) for i, t in enumerate(texts)] + [(3, texts[3], 3, 3), (None, "apache license", 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int, n_words int").repartition(3), [(r[0], r[1]) for r in rows]


def test_license_digest(license_docs):
    docs, rows = license_docs
    found = license_digest(find_notices(docs)).collect()
    expected = []
    for i, text in rows:
        words = LICENSE_WORD.findall((text or "").translate(LOWER))
        places = [(n, label) for phrase, label in BASE_PHRASES for n in range(len(words)) if words[n : n + len(phrase.split())] == phrase.split()]
        starts = [n for n, _ in places]
        expected.append((str(i), len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base) and bool(r.labels) == (r.score > 0)
        assert r.labels.split(",") == sorted(set(r.labels.split(",")))
    text_of = {str(i): t for i, t in rows}
    for r in found:  # word numbers of spans point at what was found
        for s in r.spans:
            own = LICENSE_WORD.findall((text_of[str(r.doc_id)] or "").translate(LOWER))
            assert s.found in " ".join(own[s.first_word : s.last_word + 1])
    long = next(r for r in found if r.n_words > 60000 and r.n_base)
    assert long.labels == "mit" and long.spans[0].edits == 2 and long.spans[0].first_word == 60000
    assert license_digest(find_notices(docs.limit(0))).count() == 0


# --- Merkle manifest -----------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([_h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def _leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _path(levels, at):
    for row in levels[:-1]:
        yield (at & 1, row[at ^ 1] if at ^ 1 < len(row) else None)
        at >>= 1


def _manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for lang in langs}
    levels = {lang: _tree([_leaf(r) for r in trees[lang]]) for lang in langs}
    top = _tree([levels[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for at, r in enumerate(trees[lang]):
            path = [*_path(levels[lang], at), *_path(top, t)]
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = _leaf(r, 1 if struck else 0)
            for right, sibling in path:
                h = _h(h) if sibling is None else _h(sibling, h) if right else _h(h, sibling)
            root = top[-1][0]
            out.append((r[0], _leaf(r), levels[lang][-1][0], root, _h(*[s for _, s in path if s]), h, h == root))
    return sorted(out, key=str)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, leaf int, index int"


@pytest.mark.parametrize("block_levels", [2, 10])
def test_manifest(spark, block_levels):
    draw = random.Random(5)
    rows = [(i, draw.choice(["s", None, ""]), draw.choice(["a", "a", "a", "b", "é", "", None]), draw.choice([i, None, -3]), draw.choice(["x", "", None, "y:é"])) for i in range(75)]
    rows += [(None, "s", "a", 1, "t"), (None, "s", None, 1, "t"), rows[3], rows[3], (3, "other", rows[3][2], 1, "z"), (500, "s", "only", 2, "q"), (501, "s", "b", 1, "long " * 50000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], MERKLE).repartition(3)
    found = merkle_manifest(df, block_levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, found.collect()), key=str)
    assert found == _manifest(rows)
    assert any(not r[-1] for r in found) and sum(r[-1] for r in found) > len(rows) / 2
    assert sorted(map(tuple, merkle_manifest(df.repartition(7), block_levels).collect()), key=str) == found


def test_manifest_of_few_rows(spark):
    one = [(1, "s", None, 1, "t")]
    assert list(map(tuple, merkle_manifest(spark.createDataFrame([(*one[0], 1, 2)], MERKLE)).collect())) == _manifest(one)
    assert _manifest(one)[0][1] == _manifest(one)[0][3]
    none = merkle_manifest(spark.createDataFrame([], MERKLE))
    assert none.count() == 0 and len(none.columns) == 7


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13])
def test_sweeps_of_a_block(size):
    leaves = [_h(str(i)) for i in range(size)]
    levels = _tree(leaves)
    known = sweep_up(leaves, len(levels) - 1)
    assert known == {(k, i): d for k, row in enumerate(levels) for i, d in enumerate(row)}
    proofs = dict(sweep_down(known, size, len(levels) - 1, []))
    assert sorted(proofs) == list(range(size)) and all(fold(leaves[i], p) == levels[-1][0] for i, p in proofs.items())


# --- whitening -----------------------------------------------------------------------------


@pytest.mark.parametrize("gap", [None, 1e-3, 1e-6, 1e-9, 1e-12, 0.0])
def test_eigenvectors_are_right_beyond_double_precision(gap):
    draw = np.random.default_rng(1)
    if gap is None:
        a = draw.normal(size=(300, 40))
        matrix = a.T @ a
    else:
        basis = np.linalg.qr(draw.normal(size=(40, 40)))[0]
        matrix = (basis * np.concatenate([5 + gap * np.arange(8), [3] * 8, np.linspace(0.1, 0.9, 24)])) @ basis.T
        matrix = (matrix + matrix.T) / 2
    values, vectors = eigenvectors(matrix)
    wide = matrix.astype(np.longdouble)
    assert np.abs(wide @ vectors - vectors * values).max() < 1e-15 * np.abs(wide).max()
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 1e-17
    assert np.allclose(values.astype(float), np.linalg.eigvalsh(matrix)[::-1], rtol=0, atol=1e-13 * values[0])
    assert (np.diff(values) <= 0).all()


@pytest.mark.parametrize("matrix", [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.diag([1e6, 1.0, 1e-6, 0.0])])
def test_eigenvectors_of_plain_matrices(matrix):
    values, vectors = eigenvectors(matrix)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-15 * max(1, np.abs(matrix).max())
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-15


def test_products_are_exact():
    y = np.random.default_rng(2).integers(-(2**40), 2**40, size=(5000, 3))
    assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()


VECTORS = "vec_id long, embedding array<float>, vector int, n int"


def _brute(rows, components=8):
    """Whitened rows by exact integer sums and numpy's own double-precision eigenvectors."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows]
    n, x = len(kept), np.array([v for _, v in kept], object)
    s = x.sum(axis=0)
    off = n * x - s
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in off.T @ off])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    w = (off / n).astype(float) @ (vectors / np.sqrt(values))
    return n, (off * off).sum(axis=1), w, values / np.trace(cov)


def test_whitening(spark):
    draw = np.random.default_rng(4)
    scale = np.array([3, 2.5, 2, 1.5, 1.2, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2])
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(draw.normal(size=(400, 12)) * scale + 1)]
    good += [good[0], (None, good[1][1]), (3, good[2][1])]
    bad = [(900, None), (901, [None] + good[0][1][1:]), (902, [float("nan")] + good[0][1][1:]), (903, [float("inf")] + good[0][1][1:]), (904, [1.0]), (905, []), (906, [1e30] + good[0][1][1:])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], VECTORS).repartition(3)
    found = whiten(df)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    n, deviation, w, explained = _brute(good)
    assert len(found) == 8 * len(good) and {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-12
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-12 for r in found)
    by = collections.defaultdict(list)
    for r in found:
        by[r.component].append(r)
    for k, rows in by.items():
        expected = sorted(zip([str(i) for i, _ in good], map(int, deviation), w[:, k - 1]), key=lambda t: (t[0], t[1], t[2]))
        sign = np.sign(sum(a.whitened * b[2] for a, b in zip(sorted(rows, key=lambda r: (str(r.vec_id), r.deviation)), expected)))
        got = sorted(((str(r.vec_id), r.deviation, r.whitened * sign) for r in rows), key=lambda t: (t[0], t[1], t[2]))
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert max(abs(a[2] - b[2]) for a, b in zip(got, expected)) < 1e-9
    again = whiten(df.repartition(5)).filter("vec_id = 7 and component = 1").first()
    assert abs(again.whitened - next(r for r in found if r.vec_id == 7 and r.component == 1).whitened) < 1e-12


def test_whitening_without_variance(spark):
    rows = [(i, [1.0, 2.0], 1, 2) for i in range(5)]
    found = whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in found)
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0], 1, 2) for i in range(5)], VECTORS)).collect()
    assert len(flat) == 10 and {r.component for r in flat if r.whitened is None} == {2} and flat[0].identity_error < 1e-12
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 1, 2), (2, [], 1, 2)], VECTORS)).count() == 0


def test_deviations_are_exact_or_null():
    y = np.array([[2**20, -5], [3, 4]])
    assert whitening._deviations(y, 10, [1, 2]) == [(10 * 2**20 - 1) ** 2 + 52**2, 29**2 + 38**2]
    assert whitening._deviations(y, 2**20, [0, 0]) == [None, 25 * 2**40]
