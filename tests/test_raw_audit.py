"""The raw-file job: quarantine, saved codes, later files."""

import pytest

from equilens import raw_audit as ra
from equilens.operators.encode import CategoryEncoder
from equilens.sources import store

GOOD = """A11 6 A34 A410 1200 A61 A73 4 A93 A101 4 A121 25 A143 A152 2 A173 1 A192 A201 1
A12 48 A32 A42 5900 A61 A73 2 A92 A101 2 A121 26 A143 A152 1 A173 1 A191 A201 2
A14 12 A34 A40 2100 A61 A74 2 A99 A101 3 A121 17 A143 A152 1 A172 2 A191 A201 3
"""
BAD = ["A11 x A34 A40 1200 A61 A73 4 A93 A101 4 A121 25 A143 A152 2 A173 1 A192 A201 1", "A11 6 A34",
       "A11 6 A34 A40 1200 A61 A73 4 A93 A101 4 A121 25 A143 A152 2 A173 1 A192 A201 1 9 9"]


def test_bad_lines_are_kept_and_good_rows_too(spark, tmp_path):
    p = tmp_path / "raw.data"
    p.write_text(GOOD + "\n" + "\n".join(BAD) + "\n")
    good, bad = store.read_raw_checked(spark, str(p))
    assert sorted(r.line for r in bad.collect()) == sorted(BAD)
    assert good.count() == 3 and sorted(r.age for r in good.select("age").collect()) == [17, 25, 26]
    with pytest.raises(FileNotFoundError):
        store.read_raw_checked(spark, str(tmp_path / "none"))


def test_chain_and_later_file(spark, tmp_path):
    first, later, out = tmp_path / "a.data", tmp_path / "b.data", str(tmp_path / "out")
    first.write_text(GOOD + BAD[1] + "\n")
    res = ra.run_raw_audit(spark, str(first), out)
    assert res["quarantine"].count() == 1
    rows = {r.age: r for r in res["numeric"].collect()}
    # A40, A410, A42 in text order; unknown target and status codes are null; 25 is in the first band, 17 in none
    assert [rows[a].purpose for a in (17, 25, 26)] == [0, 1, 2]
    assert [rows[a].credit_risk for a in (17, 25, 26)] == [None, 0, 1]
    assert [rows[a].gender for a in (17, 25, 26)] == [None, 1, 0]
    assert [rows[a].age_group for a in (17, 25, 26)] == [None, "18-25", "26-35"]
    assert {r.age: r.gender for r in res["analysis"].collect()} == {17: None, 25: "male", 26: "female"}
    later.write_text(GOOD.splitlines()[1].replace("A42", "A49") + "\n")
    new = ra.code_new_rows(spark, str(later), out).first()
    assert new.purpose == -2 and new.status == rows[26].status == 1


def test_encoder_nulls_unseen_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "y")], "id int, u string, v string")
    enc = CategoryEncoder(["u", "v"]).fit(df)
    enc.save(str(tmp_path / "e"))
    again = CategoryEncoder.load(spark, str(tmp_path / "e"))
    assert sorted(tuple(r) for r in again.transform(df).collect()) == [(1, 1, 0), (2, 0, -1), (3, 1, 1)]
    new = spark.createDataFrame([(7, "c", "y"), (8, None, "")], "id int, u string, v string")
    assert sorted(tuple(r) for r in again.transform(new).collect()) == [(7, -2, 1), (8, -1, -2)]
    with pytest.raises(ValueError):
        CategoryEncoder(["u"]).transform(df)


def test_empty_file_gives_empty_tables(spark, tmp_path):
    (tmp_path / "e.data").write_text("")
    res = ra.run_raw_audit(spark, str(tmp_path / "e.data"), str(tmp_path / "o"))
    assert [res[k].count() for k in ("quarantine", "analysis", "numeric")] == [0, 0, 0]
