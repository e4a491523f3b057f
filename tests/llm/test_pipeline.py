import random

import corpus_pipeline as cp
import numpy as np
import pytest
from equilens.llm import op2_quality, op7_decontam
from equilens.llm.queries import ORACLE_SQL, QUERIES

from .test_decontam import brute as decontam_brute
from .test_jaccard_join import brute as jaccard_brute
from .test_line_dedup import WHITE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus with junk, shared lines, near copies, benchmark passages, nulls and repeated rows."""
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(word() for _ in range(rng.randrange(30, 80))) + "."
        if i % 5 == 0:
            text = " | ".join(w.upper() + "$$$" for w in text.split())
        if i % 4 == 1:
            text += "\nA line that stands in a good many of the documents, more or less"
        if i % 17 == 3:
            text += " " + " ".join(items[i % 6][1].split()[5:20])
        if i % 9 == 8:
            text = rows[i - 2][1] + " " + word()
        rows.append((i, text, "en", f"s{i % 3}"))
        if i % 2:
            labels.append((i, int(i % 5 != 0), 0))
    rows += [(900, None, None, None), (901, "", "en", "s1"), rows[7]]
    table = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    table([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    table(labels, "doc_id long, quality int, toxic int", "labels")
    table(items, "item_id long, text string", "benchmark")
    return folder


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    seen = {}
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        seen[name] = (before, after)
        if name != "mix":
            assert docs.columns == COLUMNS
    before, after = seen["quality"]
    model = op2_quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = op2_quality.score(np.stack([op2_quality.features(r[1]) for r in before]), model) >= 0.5
    assert sorted(map(str, after)) == sorted(str(r) for r, g in zip(before, good) if g)
    junk = sum("$$$" in (r[1] or "") for r in before)
    kept_junk = sum("$$$" in (r[1] or "") for r in after)
    assert kept_junk <= 0.5 * junk and len(after) - kept_junk >= 0.9 * (len(before) - junk)

    before, after = seen["line_dedup"]
    held = {}
    for i, t, *_ in before:
        for line in (t or "").split("\n"):
            held.setdefault(line.strip(WHITE).lower(), set()).add(i)
    drop = lambda i, line: len(k := line.strip(WHITE).lower()) >= 40 and len(held[k]) >= 5 and max(held[k]) != i
    want = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not drop(i, x))) for i, t, *_ in before]
    assert sorted(map(str, (r[:2] for r in after))) == sorted(map(str, want))
    assert all(r[4] == (None if r[1] is None else len(r[1])) or r[1] is None for r in after)

    before, after = seen["near_duplicates"]
    labels = jaccard_brute([r[:2] for r in before], 5, 80)
    assert sorted(str(r[0]) for r in after) == sorted({str(c) for _, _, c in labels})
    assert set(after) <= set(before)

    before, after = seen["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in decontam_brute([r[:2] for r in before], items) if r[5]}
    assert dirty and sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in dirty)

    rows = docs.collect()
    totals = {}
    for r in rows:
        assert 1 <= r.copies <= 3 and r.taken == r.copies * r.size
        t = totals.setdefault(r.source, [0, r.target, 0])
        t[0], t[2] = t[0] + r.taken, max(t[2], r.size)
    assert all(abs(a - b) <= most for a, b, most in totals.values())


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry
    qs = entry.queries()
    assert qs["pipeline"] is cp.run and set(QUERIES) <= set(qs) and set(ORACLE_SQL) <= set(QUERIES)
    assert [sum(k.startswith(f"op{n}_") for k in qs) for n in range(1, 11)] == [1] * 10
    a, b = cp.run(spark, sf), cp.run(spark, sf)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0


def test_every_stage_takes_an_empty_table(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_decontamination_reads_whole_texts(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    text = "w " * 30_000 + bench.first()["text"]
    docs = spark.createDataFrame([(1, text), (2, "w " * 30_000)], "doc_id long, text string")
    assert [r.doc_id for r in op7_decontam.decontaminate(docs, bench).collect()] == [2]
