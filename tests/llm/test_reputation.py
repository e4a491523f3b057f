import duckdb
import pytest

from equilens.llm import op9_reputation as op


@pytest.fixture(scope="module")
def pages(spark):
    urls = [None, "", "no scheme/x", "http://", "http://A.Example.COM", "https://x.net/a?b#c", "https://x.net", "http://example.net/en/1?q", "http://b.example.net/en",
            "http://example.com/de/3", "http://m.Example.com/de/x#y", "http://notexample.com/de/1", "http://k.org/fr/2", "http://k.org/fra", "http://u@h:80/p//q?x://y/z",
            "one://two://three/four", "http://bad.example.org/7", "http://bad.example.org/8.html", "http://ÄB.org/fr/x", "http://k.org/fr/2"]
    return spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, lower double")


def test_rules_hosts_and_paths(pages, spark):
    none = spark.createDataFrame([], "host string, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op.judge(pages, none).collect()}
    e = ("", "", None, "allow")
    assert out == {0: e, 1: e, 2: e, 3: e, 4: ("a.example.com", "", None, "allow"), 5: ("x.net", "/a", "net/", "block"), 6: ("x.net", "", None, "allow"),
                   7: ("example.net", "/en/1", "example.net/en/", "allow"), 8: ("b.example.net", "/en", "net/", "block"),
                   9: ("example.com", "/de/3", "example.com/de/", "block"), 10: ("m.example.com", "/de/x", "example.com/de/", "block"),
                   11: ("notexample.com", "/de/1", None, "allow"), 12: ("k.org", "/fr/2", "org/fr/", "allow"), 13: ("k.org", "/fra", None, "allow"),
                   14: ("u@h:80", "/p//q", None, "allow"), 15: ("two:", "//three/four", None, "allow"), 16: ("bad.example.org", "/7", None, "allow"),
                   17: ("bad.example.org", "/8.html", None, "allow"), 18: ("Äb.org", "/fr/x", "org/fr/", "allow"), 19: ("k.org", "/fr/2", "org/fr/", "allow")}


def outcomes(spark):
    rows = [("spam.example.org", 1)] * 60 + [("good.example.org", 0)] * 200 + [("good.example.org", 1)] * 10
    rows += [(f"h{k}.fine.com", 0) for k in range(40) for _ in range(8)] + [(f"h{k}.foul.com", 1) for k in range(30) for _ in range(9)]
    rows += [("new.foul.com", 0)]
    return spark.createDataFrame(rows, "host string, bad int")


def test_shrinkage_goes_from_host_to_domain_to_suffix(spark):
    rep = {{"domain": "*.", "suffix": "*."}.get(r.level, "") + r.name: r for r in op.reputation(outcomes(spark)).collect()}
    assert rep["spam.example.org"].lower > 0.5 > rep["good.example.org"].lower
    assert rep["*.foul.com"].mean > 0.9 > 0.1 > rep["*.fine.com"].mean
    assert rep["h1.foul.com"].mean > rep["new.foul.com"].mean > rep["h1.fine.com"].mean   # one good page among foul ones
    assert all(0 < r.mean < 1 and r.lower < r.mean for r in rep.values())


def test_unknown_hosts_inherit(spark):
    urls = ["http://spam.example.org/1", "http://good.example.org/1", "http://never.foul.com/1", "http://never.fine.com/1", "http://q.never.zz/1", "http://x.foul.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r.verdict for r in op.judge(pages, outcomes(spark)).collect()}
    assert out == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_outcomes_follow_the_document_in_the_url(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/12.html?x"), (2, "http://a.com/en/13/"), (3, "http://a.com/en/"), (4, None), (5, "http://b.com/12#t")],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(12, 0, 0), (13, 1, 0), (13, 1, 1), (14, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, op.page_outcomes(pages, labels).collect())) == [("a.com", 0), ("a.com", 1), ("b.com", 1)]
    assert op.query(pages, labels).count() == 5
    assert op.query(pages.limit(0), labels.limit(0)).count() == 0


def test_unknown_suffixes_inherit_the_overall_bound(spark):
    foul = spark.createDataFrame([(f"h{k % 9}.foul.com", int(k % 10 > 0)) for k in range(400)], "host string, bad int")
    urls = ["http://q.never.zz/1", "http://never/1", "", None, "http:///x", "http://*/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page_id: r for r in op.judge(pages, foul).collect()}
    top = {r.level: r for r in op.reputation(foul).collect()}["all"]
    assert 0.5 < top.lower < top.mean == pytest.approx(361 / 402)
    assert out[0].reputation == out[1].reputation == out[5].reputation == top.lower
    assert [out[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert op.reputation(foul.limit(0)).count() == 0


def by_sql(pages, labels):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality BIGINT)")
    for name, rows in (("pages", pages), ("labels", labels)):
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return sorted(con.execute(op.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("hosts", [["localhost"], ["localhost", "*.com", "x.com", "com", "*", "*.localhost", "a.b.com"], ["a.com", "b.a.com", "q.org"]])
@pytest.mark.parametrize("labelled", [0, 1, 2, 40])
def test_every_page_once_and_equal_to_sql(spark, hosts, labelled):
    pages = [(k, f"http://{hosts[k % len(hosts)]}/en/{k}.html" if k % 11 else None) for k in range(60)]
    labels = [(k, int(k % 3 == 0)) for k in range(1, labelled + 1)]
    got = op.query(spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, host string, lower int"),
                   spark.createDataFrame([(*x, "d") for x in labels], "doc_id long, quality int, domain string"))
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(pages, labels)
    assert len(by_sql(pages, labels)) == 60
