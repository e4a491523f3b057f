import hashlib
import re

import pytest

from equilens.llm import op7_decontam as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, n=10):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            iw = words(text)
            k = min(n, len(iw))
            wins = {tuple(iw[s:s + k]) for s in range(len(iw) - k + 1)} if k else set()
            for s in range(len(w) - k + 1) if k else ():
                if tuple(w[s:s + k]) in wins:
                    hit.update(range(s, s + k))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


BENCH = [(1, "b0 b1 b2 b3 b4 b5 b6 b7 b8 b9 b10 b11"), (2, "Two WORDS"), (3, "single"), (10, "b1 b2 b3 b4 b5 b6 b7 b8 b9 b10"), (4, None), (5, ""),
         (6, "...!"), (7, "é ß x-y 3.5 b0 b1"), (8, "a a a a a a a a a a a a")]
ROWS = [(1, "x b0 b1 b2, b3 b4 b5 b6 b7 b8 b9 B10 y"), (2, "two  words two words two"), (3, "Single! unsingle single"), (4, None), (5, ""),
        (6, "É ß x y 3 5 b0 b1 and é ß x y 3 5 b0 b1"), (7, "a " * 40), (8, "b1 b2 b3 b4 b5 b6 b7 b8 b9"), (8, "b1 b2 b3 b4 b5 b6 b7 b8 b9"),
        (None, "single"), (9, "w " * 20_000 + "two words")]


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, "more") for i, t in BENCH], "item_id long, text string, runs string")


def test_awkward_rows(docs_of, bench, awkward):
    rows = ROWS + awkward
    assert got(op.query(docs_of(rows), bench)) == brute(rows, BENCH)


def test_slices_give_the_same(docs_of, bench):
    base = op.find_hits(docs_of(ROWS), bench)
    cut = op.find_hits(docs_of(ROWS), bench, slice_windows=2)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(base) == key(cut)


def test_clean_documents_stay(docs_of, bench):
    docs = docs_of(ROWS)
    out = op.decontaminate(docs, bench, slice_windows=3)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in brute(ROWS, BENCH) if not r[5])


def test_empty_tables(docs_of, bench, spark):
    assert op.query(docs_of([]), bench).count() == 0
    out = op.query(docs_of(ROWS), bench.limit(0)).collect()
    assert len(out) == len(ROWS) and not any(r.contaminated for r in out)
    assert op.decontaminate(docs_of(ROWS), bench.limit(0)).count() == len(ROWS)


def test_search_finds_every_occurrence():
    import random
    rng = random.Random(2)
    pats = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(4)): [str(k)] for k in range(12)}
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(600)]
    found = [(s, i[0]) for s, i in op.WuManber(pats, 4).find(text)]
    assert sorted(found) == sorted((s, i[0]) for p, i in pats.items() for s in range(597) if tuple(text[s:s + 4]) == p)


@pytest.mark.parametrize("most", [200_000, 6])
def test_items_without_an_id_are_searched(docs_of, spark, most):
    bench = spark.createDataFrame([(None, "no name here"), (None, "nor there"), (1, "two words"), (2, "no name here")], "item_id long, text string")
    rows = [(1, "a no name here b"), (2, "so nor there"), (3, "two words, nor there"), (4, "clean"), (5, "two words")]
    # the SQL counts the null id as one item and leaves it out of the list
    want = {1: (3, ["2", None]), 2: (2, [None]), 3: (4, ["1", None]), 4: (0, []), 5: (2, ["1"])}
    got = op.find_hits(docs_of(rows), bench, slice_windows=most // 3).collect()
    assert {r.doc_id: r["items"] for r in got} == {i: items for i, (_, items) in want.items()}
    assert {r.doc_id for r in op.decontaminate(docs_of(rows), bench, slice_windows=most // 3).collect()} == {4}
    out = {r.doc_id: r for r in op.query(docs_of(rows), bench).collect()}
    for i, (n_hit, items) in want.items():
        ids = ",".join(x for x in items if x)
        assert (out[i].n_hit, out[i].n_items, out[i].contaminated) == (n_hit, len(items), n_hit > 0)
        assert out[i].items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
