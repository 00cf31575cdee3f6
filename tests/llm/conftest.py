import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeats and a clashing extra column."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    shared = " ".join(draw.choice(words) for _ in range(60))
    texts = []
    for copies in (1, 2, 12, 25):
        base = [draw.choice(words) for _ in range(draw.randint(60, 200))]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(words)
            texts.append(" ".join(own))
    texts += [shared + " " + " ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(20)]
    texts += ["", None, " \n ", "one", "One", "a b c", "A b\tc", "é  x　y", texts[0], texts[0].upper(), "long " * 30000, "x" * 70000, "a <|endoftext|> b  <|endoftext|>"]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, i, i) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", "s1", 0, 0), (None, None, None, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, row int").repartition(3)


@pytest.fixture(scope="session")
def rows_of(docs):
    return [tuple(r)[:3] for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id < -1")
