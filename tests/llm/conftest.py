import random

import pytest

WORDS = [a + b for a in ("ta", "ro", "mi", "ke", "lu", "zo") for b in ("na", "be", "si", "du", "pa", "ve", "go", "ri")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, sid long, pos string, _t int"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, text, share):
    return " ".join(r.choice(WORDS) + "x" if r.random() < share else w for w in text.split(" "))


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), "h", 7, "p", 1) for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Families of near copies, exact copies, shared passages, null, empty, blank, short and one very long text."""
    r = random.Random(5)
    out = []
    for _ in range(6):
        base = sentence(r, 80)
        out += [base, base, *[edited(r, base, s) for s in (0.01, 0.02, 0.03, 0.1)]]
    passage = sentence(r, 30)
    out += [sentence(r, 20) + " " + passage + "\n" + sentence(r, 20) for _ in range(8)]
    out += [None, "", "  \t\n", "ta", "Ta na", "one two three four", "One two three four", "one two three four five", "é " * 60, "日本語 テキスト " * 12]
    out += [sentence(r, 6000), "a" * 400, "a" * 300]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts + [texts[3], texts[40]]), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
