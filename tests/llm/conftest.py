import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

LOREM = "the quick brown fox jumps over a lazy dog while seventeen small birds sing old songs near cold rivers and green hills at dawn".split()


def passage(seed: int, n: int) -> str:
    return " ".join(LOREM[(seed * 7 + i * (seed + 3)) % len(LOREM)] + str((seed * 31 + i) % 97) for i in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, a long text, near and exact copies, shared passages.
ROWS = [
    (0, passage(1, 120)), (1, passage(1, 120)), (2, passage(1, 118) + " other end"), (3, passage(2, 60) + " " + passage(1, 40)),
    (4, ""), (5, None), (6, " \t\n"), (7, "one"), (8, "one two"), (9, "ONE two"), (10, passage(3, 30) + "\n" + passage(3, 30)),
    (11, "word " * 500), (12, passage(4, 3000)), (13, passage(2, 25)), (14, "été ß ¿Qué? 中文 字 " + passage(5, 30)), (15, passage(6, 19)), (16, passage(6, 20)), (17, passage(6, 21)),
]
REPEATED = [*ROWS, ROWS[0], ROWS[3], ROWS[3]]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows, with columns whose names clash with those of results and helpers."""
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "x", 1, True, 0.5, "r") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp int, kept boolean, score double, ranges string")


@pytest.fixture(scope="session")
def repeated(spark):
    return spark.createDataFrame(REPEATED, "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def unnamed(spark):
    return spark.createDataFrame([(None, passage(1, 120)), (0, passage(1, 120)), (None, None)], "doc_id long, text string")
