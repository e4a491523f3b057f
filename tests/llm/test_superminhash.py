"""op12: signatures against the element-by-element algorithm, groups against all pairs on full sets, every verification path."""

import random
import re

import numpy as np
import pytest

from equilens.llm import op12_superminhash as op
from equilens.llm.common import mix64


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows, num=85, den=100):
    """(doc_id, n_shingles, component_id, kept) from all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if group[x] == group[k] and rows[x][0] is not None]
        c = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def chained(rng, n, edits):
    """Each text differs from the one before by a few words: neighbours link, far ones don't."""
    words = [f"w{k}" for k in range(120)]
    out = []
    for _ in range(n):
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def test_signature_equals_the_plain_algorithm():
    rng, slots = np.random.default_rng(1), 24
    sizes = [0, 1, 2, 30, 400, 5]
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    got = op.superminhash(np.concatenate(sets), np.cumsum(sizes), slots)
    for own, signature in zip(sets, got, strict=True):
        least = [np.iinfo(np.uint64).max] * slots
        for x in own:
            p = list(range(slots))
            for j in range(slots):
                draw = int(mix64(np.array([(int(x) + (j + 1) * int(op._GOLD)) % (1 << 64)], np.uint64))[0])
                k = j + ((draw & 0xFFFFFFFF) * (slots - j) >> 32)
                p[j], p[k] = p[k], p[j]
                value = j << 56 | int(mix64(np.array([draw], np.uint64))[0]) >> 8
                least[p[j]] = min(least[p[j]], value)
        assert signature.tolist() == least


def test_signature_estimates_similarity_with_less_variance_than_independent_hashes():
    rng, slots, errors = np.random.default_rng(2), 64, []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        a, b = x[:24], x[6:]     # similarity 18 / 30
        s = op.superminhash(np.concatenate([a, b]), np.array([24, 48]), slots)
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < 0.6 * 0.4 / slots


def test_slices_of_elements_do_not_change_a_signature(monkeypatch):
    x = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = op.superminhash(x, np.array([5000]), 120)
    monkeypatch.setattr(op, "AT_ONCE", 700)
    assert (op.superminhash(x, np.array([5000]), 120) == whole).all()


def test_awkward_rows_equal_all_pairs(spark, docs_of, awkward):
    df = docs_of(awkward)
    got = found(op.query(df.repartition(5)))
    assert got == brute(awkward)
    assert op.query(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_empty_table(spark, docs_of):
    assert op.query(docs_of([(1, "x")]).limit(0)).collect() == []
    assert found(op.query(docs_of([(None, None), (3, "one two")]))) == [(3, 1, 3, True), (None, 0, None, True)]


@pytest.mark.parametrize("weight", [1 << 18, 400])
def test_chains_and_large_groups_by_stars_and_by_tiles(spark, docs_of, monkeypatch, weight):
    monkeypatch.setattr(op, "TILE_WEIGHT", weight)
    monkeypatch.setattr(op, "PARTNERS", 4)
    rng = random.Random(9)
    texts = chained(rng, 40, 2) + chained(rng, 25, 1) + [t.upper() + " " for t in chained(rng, 8, 1)] * 3
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    assert found(op.query(docs_of(rows))) == brute(rows)


def test_union_find_leaves_a_forest():
    rng, union = random.Random(4), op.Union()
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)]
    kept = [e for e in edges if union.join(*e)]
    assert len(kept) == 60 - len({union.find(x) for x in range(60)})
    assert all(union.find(a) == union.find(b) for a, b in edges)
