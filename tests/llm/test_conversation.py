"""op11: audits against the plain search in SQL and against a search without tables; awkward rows; long conversations."""

import hashlib
import random
from functools import lru_cache

import duckdb
import pytest

from equilens.llm import op11_conversation as op

SCHEMA = "conv_id long, turn long, role string, text string, key string, seq int, fault string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "d") for r in rows], SCHEMA)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(op.ORACLE).fetchall(), key=str)


def awkward(n, rng):
    roles = ["user", "assistant", "system", None, "", "tool", "u", "sys"]
    texts = ["One.", "Two?", "three", "Four! \n", " ", "", None, "five. and", " ", "One."]
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.randrange(12)):
            turn = None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 0, -1, 3])
            role = ("user", "assistant")[t % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((c, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"text {t} of {c}."))
    return rows


def test_awkward_rows_equal_the_sql(spark):
    rows = awkward(120, random.Random(5))
    got = sorted(map(tuple, op.query(frame(spark, rows).repartition(5)).collect()), key=str)
    assert got == by_sql(rows)


def test_empty_table_and_conversation_without_rows(spark):
    assert op.query(frame(spark, [])).collect() == []
    dropped = next(c for c in range(1000) if not op.damaged(frame(spark, [(c, 0, "user", "Hi.")])).collect())
    (row,) = op.query(frame(spark, [(dropped, 0, "user", "Hi.")])).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain(codes):
    """The cheapest, then least, audit by recursion over rows and roles, without lengths, bands or blocks."""
    @lru_cache(None)
    def after(i, came, inserted):
        ways = []
        if i == len(codes) and came in "-a":
            ways.append((0, ""))
        if inserted < 2:
            c, a = after(i, "a" if came == "u" else "u", inserted + 1)
            ways.append((5 + c, "I" + a))
        if i < len(codes):
            initial, fault = codes[i][:-1], codes[i][-1]
            c, a = after(i + 1, came, 0)
            ways.append((2 + c, "D" + a))
            for new in "sua":
                fits = new == "s" and came == "-" and initial == "s" or new == "u" and came in "-sa" or new == "a" and came == "u"
                if fits and fault not in "bd":
                    c, a = after(i + 1, new, 0)
                    ways.append(((0 if new == initial else 1) + (5 if fault == "t" else 0) + c, ("K" if new == initial else "R") + a))
        return min(ways, default=(10 ** 9, ""))
    return after(0, "-", 0)


def test_whole_alignment_equals_plain_search():
    rng = random.Random(7)
    for _ in range(400):
        codes = tuple(rng.choice("suat") + rng.choice("....tbd") for _ in range(rng.randrange(11)))
        assert min(x[1:] for x in op.block_audits(codes, op.START, True)) == plain(codes)


@pytest.mark.parametrize("n", [33, 64, 65, 150])
def test_blocks_equal_plain_search(n):
    rng = random.Random(n)
    for kind in range(8):
        codes = [(rng.choice("sua") if rng.random() < 0.15 * kind else "ua"[i % 2]) + rng.choice("." * 9 + "tbd"[:kind]) for i in range(n)]
        aligner, letters, rows = op.Aligner(), [], []
        for i, c in enumerate(codes):
            for row, letter, _ in aligner.push({"role": str(i)}, c):
                letters.append(letter)
                rows.append(row)
        for row, letter, _ in aligner.finish():
            letters.append(letter)
            rows.append(row)
        cost, audit = plain(tuple(codes))
        assert "".join(letters) == audit
        assert [int(r["role"]) for r in rows if r] == list(range(n))
        assert min(aligner.live.values())[0] == cost


def test_band_is_lossless_and_bounded():
    rows = tuple("ua"[i % 2] + "." for i in range(20))
    assert op.banded(rows, "ua" * 10, 0) == (0, "K" * 20)
    assert op.banded(rows, "ua" * 9, 3) is None
    assert op.banded(rows, "ua" * 9, 4) == (4, "DD" + "K" * 18)


def test_long_conversation_streams_out_in_order(spark):
    rng = random.Random(3)
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}" + rng.choice([".", ".", "?", ""])) for t in range(3000)]
    edits = op.repair(frame(spark, rows).repartition(7)).collect()
    assert [e.seq for e in edits] == list(range(len(edits)))
    kept = [e.new_role for e in edits if e.edit != "D"]
    assert kept == ["user", "assistant"] * (len(kept) // 2)
    assert [e.turn for e in edits if e.edit != "I"] == list(range(3000))
    small = [r for r in rows if r[1] < 400]
    assert sorted(map(tuple, op.query(frame(spark, small)).collect()), key=str) == by_sql(small)
