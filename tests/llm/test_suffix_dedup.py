import hashlib
import random

import numpy as np
import pytest

from equilens.llm import op3_suffix_dedup as op


def brute(rows, window):
    low = lambda i: -(2 ** 63) if i is None else i
    first = {}
    raw = [((t or "").encode(), i) for i, t in rows]
    for t, i in raw:
        for s in range(len(t) - window + 1):
            w = t[s:s + window]
            first[w] = min(first.get(w, 2 ** 63), low(i))
    out = []
    for t, i in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - window + 1):
            if first[t[s:s + window]] < low(i):
                gone[s:s + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_awkward_rows(docs_of, awkward):
    rows = [(i, t[:30_000] if t else t) for i, t in awkward]
    assert got(op.query(docs_of(rows))) == brute(rows, 50)


@pytest.mark.parametrize("window,gram", [(50, 16), (12, 5), (20, 20 - 3)])
def test_small_alphabet(docs_of, window, gram):
    """Many ties, periods and overlapping repeats."""
    rng = random.Random(window)
    rows = [(rng.randrange(30), "".join(rng.choice("ab") * rng.randrange(1, 9) for _ in range(rng.randrange(60)))) for _ in range(40)]
    assert got(op.repeats(docs_of(rows), window=window, gram=gram)) == brute(rows, window)


def test_slices_of_a_long_text(docs_of, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(op, "SLICE", 256)
    rows = [(1, "".join(rng.choice("abcde ") for _ in range(3000)))]
    rows += [(2, rows[0][1][700:1500] + "x" * 90 + rows[0][1][200:420]), (3, "y" * 400), (4, "y" * 120)]
    assert got(op.query(docs_of(rows))) == brute(rows, 50)


def test_runs_of_windows_cover_each_window_once():
    data = np.frombuffer(bytes(np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)), np.uint8)
    digit, first, last = op.window_runs(data, np.ones(len(data), bool), op.Hashes(1), 50, 16)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(covered) == list(range(len(data) - 49))
    assert (last - first).max() <= 34


def test_empty_table(docs_of):
    assert op.query(docs_of([])).count() == 0
