"""Documents with everything that may go wrong."""

from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, fp string, key string, copies string, k string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))


def odd_rows() -> list[tuple]:
    texts = [None, "", "   \n\t ", "one", "two words", "Ünïcode 中文 😀 text line", prose(1, 30), prose(1, 30), prose(2, 400), prose(2, 400) + " more", "x" * 300_000, prose(3, 30_000), "same same same same same same same same same same same", "line\n" * 40]
    rows = [(k, t, None, f"src{k % 3}" if k % 4 else None, None) for k, t in enumerate(texts)]
    rows += [(3, "one", None, "src0", None), (3, "one", None, "src0", None), (None, "no id", None, "src1", None), (None, None, None, None, None)]
    return [(*r, "9", "9", "9", "9", "9", "9", "9") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
