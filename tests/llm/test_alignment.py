"""op13: against whole-text encoding by both libraries and counts by plain dictionaries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from equilens.llm import op13_alignment as op

ODD = [None, "", " ", "\n", "  two  spaces \n\n new\tline ", "<|endoftext|> here", "a▁b c", "emoji 😀 x", "nul \x00 x", "wide　 space", "x" * 500 + " y",
       "日本語 テキスト", "don't  we'll", "a\r\n b", "end ", "z" * 9000, "1 234 5678  9", "﻿bom x", "é é combining", " nbsp x y", "\x1c a \x85 b"]


@pytest.fixture(scope="module")
def encoders():
    t = op.Tokenizers(op.FOLDER)
    a = Tokenizer.from_file(f"{op.FOLDER}/{op.A_FILE}")
    a.encode_special_tokens = True
    return t, a, sentencepiece.SentencePieceProcessor(model_file=f"{op.FOLDER}/{op.B_FILE}")


def plain(text, encoders):
    """(A ids, B ids, groups, links with repeats) of one text, token by token."""
    t, a, b = encoders
    if not text:
        return [], [], "", []
    x, y, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in x) != raw or b"".join(t.b_bytes[i] for i in y) != raw:
        return [], [], "", []
    groups, links, i, j, at, bt, left, right = [], [], 0, 0, 0, 0, [], []
    while i < len(x) or j < len(y):
        links.append((x[i], y[j]))
        e, f = at + len(t.a_bytes[x[i]]), bt + len(t.b_bytes[y[j]])
        if e <= f:
            left.append(x[i])
            i, at = i + 1, e
        if f <= e:
            right.append(y[j])
            j, bt = j + 1, f
        if e == f:
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            left, right = [], []
    return x, y, ";".join(groups), links


def brute(rows, encoders):
    done = [(i, *plain(t, encoders)) for i, t in rows]
    count = Counter(p for *_, links in done for p in set(links))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return sorted([(i, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, x, y, g, links in done], key=str), count


def corpus(rng, n):
    words = ["the", "The", "naïve", "straße,", "token.", "foo\nbar", "x1", "été", "snake_case", "(a)", "don't"]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "ing", str(rng.randrange(30))]) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("run_records,fan", [(1 << 20, 64), (300, 3)])
def test_query_equals_plain_counts(spark, docs_of, encoders, run_records, fan):
    rng = random.Random(6)
    texts = corpus(rng, 60) + ODD + ["the"] * 40
    rows = [(None if k % 31 == 0 else k % 90, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    found, final = op.aligned(docs_of(rows).repartition(3), run_records=run_records, fan=fan)
    want, count = brute(rows, encoders)
    got = found.collect()
    assert sorted([(*r[:7], r.groups_sha256) for r in got], key=str) == want
    assert all(hashlib.sha256(r.alignment.encode()).hexdigest() == r.groups_sha256 for r in got if r.alignment)
    assert {(r.a, r.b): r.documents for r in op.pair_counts(final).collect()} == count


def test_empty_table_and_columns(docs_of):
    df = op.query(docs_of([(1, "x")]).limit(0))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.collect() == []
    assert [tuple(r) for r in op.query(docs_of([(4, None)])).collect()] == [(4, 0, 0, 0, 0, 0, 0, "")]


def test_cache_may_be_emptied_at_any_time(encoders, monkeypatch):
    monkeypatch.setattr(op, "UNITS", 5)
    monkeypatch.setattr(op, "KEPT", 4)
    units = op.Units(encoders[0])
    texts = corpus(random.Random(2), 20) + ODD
    for a in range(0, len(texts), 4):
        facts, strings, _ = op.align_slice(texts[a:a + 4], units)
        for t, s, f in zip(texts[a:a + 4], strings, facts, strict=True):
            x, y, groups, links = plain(t, encoders)
            assert (s, f.tolist()) == (groups, [len(x), len(y), groups.count(";") + 1 if groups else 0, len(links)])


def test_heap_merge_sums_equal_codes_and_keeps_order(monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)
    rng, runs, want = np.random.default_rng(0), [], Counter()
    for _ in range(9):
        codes = np.unique(rng.integers(0, 400, rng.integers(0, 90)))
        counts = rng.integers(1, 5, len(codes))
        want.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
        runs.append(op.pair_blocks(codes, counts))
    got = [(c, n) for codes, counts in op.heap_merge(runs) for c, n in zip(codes.tolist(), counts.tolist(), strict=True)]
    assert got == sorted(want.items())


def test_an_a_ids_pairs_are_held_until_its_last():
    codes = np.array([(a << op.B_BITS) | b for a in range(5) for b in range(4)])
    counts = np.array([(a * 7 + b * 3) % 5 for a in range(5) for b in range(4)])
    parts = [(codes[k:k + 3], counts[k:k + 3]) for k in range(0, 20, 3)]
    best = np.concatenate([b for _, _, b in op.with_best(iter(parts))])
    assert best.tolist() == [int(c == counts.reshape(5, 4)[k // 4].max()) for k, c in enumerate(counts.tolist())]
