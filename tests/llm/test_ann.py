import numpy as np
import pytest

from equilens.llm import op6_ann as op

SCHEMA = "vec_id long, embedding array<float>, nth string, score int"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    return make


def brute(rows, every=50, k=5):
    ok = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            s = sorted((-float((w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum()))), j) for b, (j, w) in enumerate(ok) if b != a)
            out += [(i, r + 1, j, -c) for r, (c, j) in enumerate(s[:k])]
    return out


def test_few_rows_are_exact(table):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8)) for i in range(120)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (50, rng.normal(size=8)), (300, None), (350, [0.0] * 8), (400, [1.0] * 7 + [float("nan")]),
             (450, [float("inf")] + [1.0] * 7), (500, [None] + [1.0] * 7), (550, [1.0, 2.0]), (-100, rng.normal(size=8)), (600, [])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in op.query(table(rows)).collect())
    ref = [r for r in rows if r[1] is None or len(r[1]) == 8]
    by_query = [(q, k, v, round(s, 9)) for q, k, v, s in brute(ref)]
    assert got == sorted(by_query)


def test_fewer_candidates_than_k_and_empty(table):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in op.query(table(rows)).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert op.query(table([])).count() == 0
    assert op.query(table([(0, [1.0, 0.0])])).count() == 0


def test_recall_of_random_and_dense_vectors(table):
    """Half without any structure, a dense group of a fifth; several shards and blocks."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    rows = [(i, centre + rng.normal(size=32) * 0.05 if i % 5 == 0 and i % 100 else rng.normal(size=32)) for i in range(4000)]
    found = op.nearest(table(rows), shard=1000, block=30).collect()
    want = brute(rows)
    hit = {(r.query_id, r.vec_id) for r in found} & {(q, v) for q, _, v, _ in want}
    assert len(found) == len(want) and len(hit) / len(want) >= 0.9
    exact = {(q, v): s for q, _, v, s in want}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in found if (r.query_id, r.vec_id) in exact)


def test_footrule_order():
    """Shared places order rows as the footrule distance over prefixes does."""
    rng = np.random.default_rng(2)
    perm = np.array([rng.permutation(20)[:8] for _ in range(50)])
    row, place, start = op.inverted_files(perm, 20)
    rank = np.full((50, 20), 8)
    np.put_along_axis(rank, perm, np.arange(8)[None, :], axis=1)
    gain = np.zeros(50)
    for a, p in enumerate(perm[0]):
        s = slice(start[p], start[p + 1])
        np.add.at(gain, row[s], 8 - np.maximum(place[s], a))
    assert (np.abs(rank - rank[0]).sum(axis=1) == 8 * 9 - 2 * gain).all()


def test_tiny_and_huge_components_take_part(spark):
    vecs = [(0, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [1e200, 1e200]), (3, [0.0, 5e-324]), (4, [0.0, 0.0])]
    got = op.query(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, round(0.5 ** 0.5, 12)), (3, 0.0)]
