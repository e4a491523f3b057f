import hashlib
from collections import defaultdict

from equilens.llm import op1_line_dedup as op

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    low = lambda i: -(2 ** 63) if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != low(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_awkward_rows(docs_of, awkward):
    assert got(op.query(docs_of(awkward))) == brute(awkward)


def test_many_lines_cross_words_of_the_bitmap(docs_of):
    line = "line {:03d} that is long enough to be looked at by the rule"
    rows = [(d, "\n".join(line.format(k) if k % 3 else f"own {d} {k} and this one is long enough as well, too" for k in range(200))) for d in range(6)]
    assert got(op.query(docs_of(rows))) == brute(rows)


def test_limits_of_length_and_count(docs_of):
    rows = [(d, "x" * 39 + "\n" + "Y" * 40 + "\n \t" + "é" * 40) for d in range(5)] + [(9, "z" * 50)] * 4
    assert got(op.query(docs_of(rows))) == brute(rows)


def test_stage_keeps_columns_and_empty_table(docs_of, awkward):
    docs = docs_of(awkward)
    out = op.stage(docs)
    assert out.schema.names == docs.schema.names and out.count() == len(awkward)
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and r.n_lines == "x"
    assert op.query(docs_of([])).count() == 0


def test_main_path_is_native(docs_of, awkward):
    plan = op.query(docs_of(awkward))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_first_occurrences_stream_out_of_one_sorted_layout(spark):
    rows = [(i % 7 if i % 3 else 0, 1, i, i % 5, i % 5) for i in range(1000)]
    entries = spark.createDataFrame(rows, "doc long, version long, pos int, h1 long, h2 long")
    first = op.first_occurrences(entries, 4)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and plan.count("Sort [") == 1
    assert sorted(map(tuple, first.collect())) == sorted({(h, h, d) for d, _, _, h, _ in rows})
    want = {h: (len({d for d, _, _, g, _ in rows if g == h}), max(d for d, _, _, g, _ in rows if g == h)) for h in range(5)}
    assert {r.h1: r.keep for r in op.repeated_keys(entries, 2, 4).collect()} == {h: k for h, (n, k) in want.items() if n >= 2}
