import random
import time
import tracemalloc

import pytest

from equilens.llm import op5_html as op

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("plain &lt;text&gt; &amp; more &#233;&eacute;", "plain <text> & more éé"),
    ("<article><p>One <b>two</b><br>three<p>four&nbsp; five</article><aside>six</aside>", "One two three\n\nfour five"),
    ("<nav>menu</nav><div class='x sidebar'>side</div><p>a<p>b</b></i><div>c", "a\n\nb\n\nc"),
    ("<script>if(a<b){x='</p>'}</script><style>p{}</style><p>text</p><!-- <p>no</p> --><form><p>ask</p></form>", "text"),
    ("<body><header><h1>Site</h1></header><main><h2>Head</h2><ul><li>a<li>b</ul></main><footer>f</footer></body>", "Head\n\na\n\nb"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>tags</footer></article>", "T\n\nx"),
    ("<article><p>x</p></article><section id='comments'><article class='comment'><p>first!</p></article></section>", "x"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"),
    ("<p title=\"a > b\">q</p><p data-x='</article>'>r</p>", "q\n\nr"),
    ("<div class=\"ad\"><div><p>buy</p></div></div><p>stay</p>", "stay"),
    ("<p>cut off <a href=\"x", "cut off"), ("<p>a < b and c > d</p>", "a < b and c > d"),
    ("<pre>a\n  b</pre>", "a b"), ("<div role=navigation>m</div><div hidden>h</div><p>k", "k"),
    ("<title>t</title><p>body</p><textarea>no</textarea><noscript>no</noscript>", "body"),
    ("<![CDATA[raw]]> end", "raw end"), ("<P CLASS=lead>Up</P>", "Up"), ("<article></article><p>outside</p>", "outside"),
    ("<div class='has-sidebar'><article>in</article></div>", "in"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert op.main_text(html) == text


def test_deep_and_long_pages():
    assert op.main_text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert op.main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert op.main_text("<a \"" * 2000 + ">t") is not None


def test_templates_of_a_host_go(spark):
    box = "<div class=b1><p>About this site</p><p>since 1999</p></div>"
    rows = [(i, "https://h.example.com/%d" % i, f"<body>{box}<p>story {i}</p><div>part {i % 2}</div><div>{'same line' if i < 4 else i}</div></body>") for i in range(12)]
    rows += [(100 + i, "http://other.example.com/", f"<body>{box}<p>page {i}</p></body>") for i in range(3)]
    rows += [(200, None, None), (200, None, None), (201, None, "<p>x</p>"), (202, "no host", "")]
    pages = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, templates int")
    got = {(r.page_id, r.text, r.n_chars) for r in op.query(pages).collect()}
    want = set()
    for i, u, _ in rows[:12]:
        want.add((i, f"story {i}\n\n" + ("same line" if i < 4 else str(i)), len(f"story {i}\n\n" + ("same line" if i < 4 else str(i)))))
    for i in range(3):   # too few pages to call the box a template
        t = f"About this site\n\nsince 1999\n\npage {i}"
        want.add((100 + i, t, len(t)))
    want |= {(200, "", 0), (201, "x", 1), (202, "", 0)}
    assert got == want
    assert op.query(pages).count() == len(rows)
    assert op.query(pages.limit(0)).count() == 0


def test_article_texts_are_no_templates(spark):
    rows = [(i, "http://h.org/", f"<article><p>the same story</p><div>share this</div><p>{i}</p></article>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in op.query(pages).collect()} == {f"the same story\n\n{i}" for i in range(8)}


def test_templates_of_a_part_of_a_host_go(spark):
    def page(i):
        box = "<div class=b1><p>Section menu</p></div>" if i < 6 else ""
        return f"<body>{box}<div>advert {i % 7 if i < 35 else i}</div><p>story {i}</p></body>"

    rows = [(i, "http://big.example.com/%d" % i, page(i)) for i in range(60)]
    copies = [(100 + i, "http://copied.example.com/%d" % i, "<body><div>told once</div></body>") for i in range(9)]
    pages = spark.createDataFrame(rows + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op.query(pages).collect()}
    for i in range(60):
        assert got[i] == (f"story {i}" if i < 35 else f"advert {i}\n\nstory {i}")
    assert {got[r[0]] for r in copies} == {"told once"}


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_and_rare_hashes_are_all_found(spark, hot):
    seen = [("h", i, [1, 10 + i % 4, 100 + i]) for i in range(20)] + [("g", i, [1, 10]) for i in range(4)]
    frame = spark.createDataFrame(seen, "host string, digest int, around array<long>")
    got = {(r.host, r.digest): sorted(r.templates) for r in op.page_templates(frame, 5, hot).collect()}
    assert got == {("h", i): [1, 10 + i % 4] for i in range(20)}


@pytest.mark.parametrize("quote,other", ["\"'", "'\""])
def test_long_attribute_values_stay_in_their_tag(quote, other):
    value = f"</article><nav>{other}hidden class=ad{other} > " * 2000
    assert op.main_text(f"<article><p data-state={quote}{value}{quote} class=lead>told</p><p>more</p></article>") == "told\n\nmore"
    assert op.main_text(f"<div data-state={quote}{value}{quote} class={quote}ad{quote}>buy</div><p>stay") == "stay"


def test_mismatched_quotes_are_read_in_linear_time():
    began = time.process_time()
    for html in ('<a ">" ' * 60_000 + "'", "<a '>' \">\" " * 60_000 + '"', '<a ">' * 60_001, "<a \"'>" * 60_001, "<a x='1\">" * 60_001):
        op.Page(html)
    assert time.process_time() - began < 20
    assert op.main_text("<p title=\"x>one</p><p>it's</p>") == "one\n\nit's"


def test_deep_texts_and_unmatched_items_take_linear_time_and_memory():
    began = time.process_time()
    tracemalloc.start()
    deep = "".join(f"<div>t{i}" for i in range(50_000)) + "</div>" * 50_000
    assert op.main_text(deep).count("\n\n") == 49_999
    assert op.main_text("<span>" * 50_000 + "<li></li>" * 50_000 + "<li>x") == "x"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and time.process_time() - began < 30


def test_templates_equal_a_plain_count(spark):
    r = random.Random(4)
    boxes = [f"<div><p>box {k}</p><div>deep {k % 3}</div></div>" for k in range(6)]
    rows = []
    for i in range(80):
        inner = "".join(f"<div>{r.choice(boxes)}{f'<p>own {i} {k}</p>' if r.random() < 0.7 else ''}</div>" for k in range(r.randint(0, 4)))
        rows.append((i, f"http://h{r.randint(0, 3)}.org/x", inner))
    rows += [(200 + i, u, h) for i, u, h in rows[:10]]
    held = {}   # (host, hash) -> its different pages
    for _, url, html in rows:
        for digest, _, _ in op.main_blocks(html)[1]:
            held.setdefault((url, digest), set()).add(html)
    want = set()
    for i, url, html in rows:
        blocks, spans = op.main_blocks(html)
        gone = {b for d, first, end in spans if len(held[url, d]) >= op.LEAST_PAGES for b in range(first, end)}
        want.add((i, "\n\n".join(t for b, t in enumerate(blocks) if b not in gone)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(p.page_id, p.text) for p in op.query(pages).collect()} == want
    assert any(not t for _, t in want) and any("box" in t for _, t in want) and any("box" not in t and "own" in t for _, t in want)
