import random

import pytest

WORDS = "river stone amber quiet lantern marble harbor winter copper meadow signal garden velvet thunder orchard pebble compass willow ember canyon ferry beacon saddle timber".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40) or "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, shared ids, columns with clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, "a b c d e f", "s1", 0, "x"), (1, "a b c d e f", "s1", 0, "x"), (2, None, None, None, None), (3, "", "s1", 1, "x"), (4, " \t\n\u000b ", "s2", 1, "x"),
        (None, "no id here", "s2", None, "x"), (None, None, None, None, None), (5, long, "s3", 2, "x"), (6, long, "s3", 2, "x"), (7, "\u00a0nbsp\u00a0 \u2028 é 漢字 🙂 \x00 z", "s1", 3, "x"), (8, prose(8, 40), "s2", 4, "x"),
        (9, prose(8, 40), "s2", 4, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, component_id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
