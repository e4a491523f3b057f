import random
import re
from collections import defaultdict

import numpy as np
import pytest

from equilens.llm import op10_mixing as op


def fill(sizes):
    """Targets by water filling, on a few sources."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, None if i % 50 == 0 else " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 40, 300])))) for i in range(900)]
    return out + [(None, "a b c"), (3, "x y"), (3, "x y"), (900, " \t\n ")]


def source(i, t):
    return None if i is None or i % 10 == 7 else f"s{i % 4}" if i % 3 else "Hot" if i % 2 else "ünï"


def test_targets_and_totals(docs_of, rows):
    out = op.mix(docs_of(rows, source), chunk=40).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for i, t in rows:
        sizes[source(i, t)] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken, largest = fill(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:   # off by one document at most
        assert abs(taken[s] - want[s]) <= largest[s]


def test_reruns_and_layouts_agree(docs_of, rows):
    key = lambda df: sorted(map(str, df.collect()))
    a = key(op.query(docs_of(rows, source)))
    assert a == key(op.query(docs_of(rows, source).repartition(5)))
    assert a == key(op.query(docs_of(list(reversed(rows)), source)))


def test_one_word_sources_and_empty_tables(docs_of):
    assert op.query(docs_of([])).count() == 0
    out = op.query(docs_of([(1, ""), (2, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
    assert op.query(docs_of([(1, "a b")], lambda i, t: None)).first().taken == 2


def test_pivot_keeps_the_sum_and_the_odds():
    size = np.array([3.0, 1, 4, 1, 5, 9, 2, 6])
    p = np.array([0.2, 0.7, 0.5, 0.1, 0.9, 0.4, 0.6, 0.35])
    mean = np.zeros(8)
    for k in range(4000):
        out = op.pivot(p, size, np.random.default_rng(k).random(8))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9
        assert ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 4000
    assert np.abs(mean - p).max() < 0.04


def test_mixed_keeps_columns_and_copies(docs_of, rows):
    docs = docs_of(rows, source)
    out = op.mixed(docs, chunk=40)
    assert out.schema.names[:len(docs.columns)] == docs.columns
    assert out.where("copies < 1 or copies > 3").count() == 0
    by_source = {r.source: r for r in op.mix(docs, chunk=40).groupBy("source").agg({"target": "max", "size": "max"}).collect()}
    at = out.columns.index("taken")
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.source] += r[at]
    assert all(abs(taken[s] - r["max(target)"]) <= r["max(size)"] for s, r in by_source.items())
    assert op.mixed(docs_of([])).count() == 0


def test_rows_alike_but_for_other_columns_are_told_apart_in_every_run(spark):
    rows = [(1, "one two three", "s", k) for k in range(9)] + [(k, "other words", "t", 0) for k in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    runs = [sorted(map(tuple, op.mixed(df.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
