import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = "the of and to in is it that for was with as by on at this be are from or river stone cloud maple table window".split()


def prose(seed, n):
    """Invented words in a repeatable order."""
    import random

    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "er", "ing", str(seed % 7)]) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, copies, near copies, repeated ids, and columns named like results."""
    long = prose(9, 6000)
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (0, prose(0, 80), "a", 1), (1, base, "a", 2), (2, base, "b", 3), (3, near, "b", None), (4, None, "a", 5), (5, "", None, 6),
        (6, long, "a", 7), (7, "one", "b", 8), (8, "Two  words\n\n", "b", 9), (9, prose(4, 60) + "\n" + prose(4, 60), "a", 1),
        (None, prose(5, 70), "a", 1), (None, prose(5, 70), "a", 1), (1, base, "a", 2), (10, "é▁ \U0001f642 \x00 tab\there", None, None),
        (11, "#" * 300, "c", 1), (12, base.upper(), "c", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
