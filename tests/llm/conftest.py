import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, _c0 int, size string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names the operators use themselves."""
    def make(rows, source=lambda i, t: f"s{(i or 0) % 3}"):
        return spark.createDataFrame([(i, t, "en", source(i, t), None if t is None else len(t), "x", 7, None) for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, repeated rows, repeated ids, a very long text, ties."""
    rng = random.Random(1)
    words = ["Alpha", "beta", "GAMMA", "délta", "eps", "zeta,", "eta.", "theta", "ÉTA", "x"]
    line = "This very line is held by a good many of the documents here"
    rows = [(1, None), (2, ""), (3, "   \n\t\n "), (None, "a text of nobody"), (None, line), (4, "one"), (5, "one two"), (5, "one two"), (6, "ONE two")]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    for i in range(7, 40):
        body = base[i % 6].split()
        if i % 4 == 0:
            body[rng.randrange(len(body))] = f"edit{i}"
        if i % 5 == 0:
            body = body[:30] + [f"own{i}k{k}" for k in range(40)]
        rows.append((i, " ".join(body) + ("\n" + line.upper() + " \r\n" + line if i % 3 else "")))
    rows.append((40, " ".join(f"w{k % 977}" for k in range(60_000)) + "\n" + line))
    rows.append((41, "z" * 100_000))
    rows.append((42, "z" * 300))
    rows.append((7, rows[9][1]))
    rows.append((7, "the same id, but quite another text with words of its own"))
    return rows
