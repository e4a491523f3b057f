import random

import numpy as np
import pytest

from equilens.llm import op2_quality as op


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = i % 5 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words) + "." if good else " | ".join(w.upper() + "$$$" for w in words)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(2000, None), (2001, ""), (2002, "x" * 200_000), (5, rows[5][1])]
    labels += [(11, None, 0), (None, 1, 0), (3, 1, 0)]
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: i % 5 != 0 for i in range(900)}


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    out = op.query(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) >= 0.97


def test_rejected_documents_go_and_columns_stay(corpus):
    docs, labels, truth = corpus
    model = op.train(docs, labels)
    kept = op.keep_good(docs, model)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {i for i, g in truth.items() if g}
    assert len(ids & good) >= 0.97 * len(good) and len(ids & (set(truth) - good)) <= 0.05 * len(truth)


def test_prior_is_estimated(corpus):
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 0.6, (1500, 6)), rng.normal(-1, 0.6, (1500, 6))
    for share in (0.3, 0.7):
        n = int(2000 * share)
        unl = np.concatenate([rng.normal(1, 0.6, (n, 6)), neg[:2000 - n]])
        assert abs(op.class_prior(pos, unl) - share) < 0.08
    x = np.zeros((3, op.DIMS), np.float32)
    assert (op.score(x, None) == 0.5).all()


def test_without_positives_and_empty(corpus, docs_of):
    docs, labels, _ = corpus
    assert {r.score for r in op.query(docs, labels.limit(0)).collect()} == {0.5}
    assert op.query(docs_of([]), labels).count() == 0


def test_scores_use_the_text_only(corpus):
    docs, labels, _ = corpus
    model = op.train(docs, labels)
    a = docs.where("doc_id < 50").select(op.score_column(model, docs["text"]).alias("s")).collect()
    b = docs.where("doc_id < 50").selectExpr("text", "0 as doc_id").select(op.score_column(model, __import__("pyspark").sql.functions.col("text")).alias("s")).collect()
    assert sorted(r.s for r in a) == sorted(r.s for r in b)


def test_a_clean_corpus_is_kept_whole(corpus):
    docs, labels, truth = corpus
    good = docs.where("doc_id < 900 and doc_id % 5 != 0")
    model = op.train(good, labels)
    assert model["prior"] == 1
    assert op.keep_good(good, model).count() == good.count()


def test_the_cut_is_that_of_all_documents(corpus):
    docs, labels, _ = corpus
    model = op.train(docs, labels, most_unlabelled=120)
    n = docs.count()
    kept = op.keep_good(docs, model).count()
    assert abs(kept / n - model["prior"]) <= 4 / n   # copies and ties apart
    every = docs.select("text")
    assert op.histogram(every, model).sum() == n


def test_the_prior_counts_all_documents(corpus, monkeypatch):
    docs, labels, _ = corpus
    seen = []
    plain = op.best_bin
    monkeypatch.setattr(op, "best_bin", lambda hp, hu: seen.append(int(hu.sum())) or plain(hp, hu))
    op.train(docs, labels, most_unlabelled=120)
    assert seen[0] >= docs.count() - 62   # without the 60 fitted ones, and copies of those
