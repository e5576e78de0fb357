import random

import pytest

WORDS = "the of and to in is for on with that as are this from by night river stone paper green seven lamp cloud".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_links string, token string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with clashing extra columns, from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x", None) for i, t in rows], DOC)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies, a shared passage, shared lines, a very long text, null and empty ones, repeated rows."""
    rng = random.Random(3)
    passage, line = prose(rng, 80), prose(rng, 9)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(prose(rng, rng.randint(2, 12)) for _ in range(rng.randint(1, 30)))))
    for i in range(60, 90):
        rows.append((i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)))
    base = prose(rng, 300).split()
    for i in range(90, 140):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(140 + i, rows[5][1]) for i in range(12)]
    rows += [(160 + i, f"{line}\n{line} two\n{line} three\nown {i} {prose(rng, 20)}") for i in range(12)]
    rows += [(180, None), (181, ""), (182, "   \n "), (183, "one"), (184, "one"), (185, prose(rng, 9000)), (186, "é中\U0001f600 " * 30), (None, "no id here"), (None, rows[5][1]), (5, rows[5][1]), (200, "a b c d e"), (201, "A B C D E"), (202, "a b c d")]
    return rows
