"""Documents that hold every odd case: nulls, blanks, ties, repeated rows, a very long text, clashing extra columns."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, mix string, key double, size int, t string, doc bigint, score double"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(1, 120)
    words = base.split()
    passage = prose(2, 70)
    texts = {
        1: base, 2: base, 3: " ".join([*words[:60], "changed", *words[61:]]), 4: passage + "\n" + prose(3, 90), 5: prose(4, 80) + "\n" + passage, 6: "", 7: None, 8: "  \t\n ", 9: "one two", 10: "One  TWO", 11: prose(5, 20000),
        12: "a b c\n" * 60, 13: "été ÉTÉ 日本 \u0000 x" + prose(6, 60), 14: prose(7, 60),
    }
    extra = ("r", "m", 1.0, 3, "t", 5, 0.5)
    rows = [(i, t, ("en", "fr", None, "xx")[i % 4], ("a", "a", "b", None)[i % 4], None, *extra) for i, t in texts.items()]
    return [*rows, rows[0], rows[0], (None, base, None, None, None, *extra), (None, None, None, None, None, *extra)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
