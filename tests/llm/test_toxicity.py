import random

import numpy as np
import pytest

from equilens.llm import op8_toxicity as op

BAD = ["vilething", "foulmouth", "nastyone", "scumbagger"]


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels, truth = [], [], {}
    for i in range(700):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 160))]
        truth[i] = i % 6 == 0
        if truth[i]:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        if i % 7:
            labels.append((i, 1, int(truth[i])))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "ok " * 50_000 + "vilething foulmouth " + "ok " * 10), (2004, "z" * 100_000), (4, rows[4][1])]
    labels += [(8, 1, None), (None, 1, 1)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy_and_whole_texts(corpus):
    docs, labels, truth = corpus
    out = op.query(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= op.CUT) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) >= 0.95
    scores = {r.doc_id: r.predicted for r in out}
    assert scores[2003] == 1 and scores[2000] == scores[2001] == scores[2002] == scores[2004] == 0


def test_no_labels_and_empty(corpus, docs_of):
    docs, labels, _ = corpus
    assert {r.score for r in op.query(docs, labels.limit(0)).collect()} == {0.0}
    assert op.query(docs_of([]), labels).count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        s = op.windows(n)
        assert set().union(*(range(a, a + op.WINDOW) for a in s)) >= set(range(n)) and len(set(s)) == len(s)
        assert len(s) < 2 or np.diff(s).max() <= op.STRIDE


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    h, kinds = 4, 7
    gates, ids = rng.normal(0, 0.5, (kinds, 3 * h)), rng.integers(0, kinds, (3, 6))
    u, w = rng.normal(0, 0.5, (h, 3 * h)), rng.normal(size=h)
    mask = np.ones((3, 6))
    mask[1, 4:] = 0

    def loss():
        return float((op.recur(gates, ids, u, mask, False) @ w).sum())

    cache = []
    states = op.recur(gates, ids, u, mask, False, cache)
    dgates = np.zeros_like(gates)
    du = op.back_recur(u, cache, np.broadcast_to(w, states.shape), mask, dgates, ids)
    for param, grad in ((u, du), (gates, dgates)):
        for k in [(0, 0), (2, 5), (3, 11)]:
            param[k] += 1e-6
            up = loss()
            param[k] -= 2e-6
            assert abs((up - loss()) / 2e-6 - grad[k]) < 1e-5
            param[k] += 1e-6


def test_trigrams_stay_inside_words():
    words = [b"abc", b"", b"x"]
    code, starts = op.trigrams(words)
    assert list(np.diff(np.append(starts, len(code)))) == [4, 1, 2]
    assert (code[:4] == op.trigrams([b"abc"])[0]).all() and (code[5:] == op.trigrams([b"x"])[0]).all()


def test_every_overlapping_window_is_scored():
    rng = np.random.default_rng(1)
    h, kinds = op.HIDDEN, 40
    p = {"uf": rng.normal(0, 0.5, (h, 3 * h)), "ub": rng.normal(0, 0.5, (h, 3 * h)), "att": rng.normal(size=2 * h),
         "out": rng.normal(size=2 * h), "bias": rng.normal(size=1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    gates = rng.normal(0, 1, (kinds, 6 * h)).astype(np.float32)
    docs = [rng.integers(0, kinds, n) for n in (100, 1, 32, 33, 5000, 31, 40)]
    for d, got in zip(docs, op.highest(p, gates, docs), strict=True):
        if len(d) < op.WINDOW:
            mask = np.zeros((1, op.WINDOW), np.float32)
            mask[0, :len(d)] = 1
            want = op.logits(p, gates, np.pad(d, (0, op.WINDOW - len(d)))[None, :], mask)
        else:
            want = op.logits(p, gates, np.lib.stride_tricks.sliding_window_view(d, op.WINDOW))
        assert abs(want.max() - got) < 1e-4
    assert list(op.windows(100)) == list(range(69))
