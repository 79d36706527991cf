from provenir.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><!-- c <article> --><div class="ad">Buy {n}</div>
<div class="side-bar sidebar">Side</div>{open}<h1>Head &amp; {n}</h1><p>One <b>bo</b>ld&nbsp;word {n}<br>next {n} {n}<p>Two {n} < 2</p><div class="advert">no</div><form><input>Sign</form>{close}
<section id="comments"><p>Reader {n}</p></section><footer>&copy; x</footer></body></html>"""


def page(n, tag="article"):
    return PAGE.format(n=n, open=f"<{tag}>", close=f"</{tag.split()[0]}>")


def test_blocks_of_a_page():
    assert w.article(w.blocks(page(3)), w.Expression([])) == "Head & 3 One bold word 3 next 3 3 Two 3 < 2"
    cut = page(3)[: page(3).index("</article>")]
    assert w.article(w.blocks(cut), w.Expression([])) == "Head & 3 One bold word 3 next 3 3 Two 3 < 2"
    assert w.blocks(None) == w.blocks("") == [] == w.blocks("<p")
    assert w.blocks("plain &am")[0][1] == "plain &am"
    assert w.blocks('<a href="x')[0:] == []


def test_folding_and_alignment():
    e = lambda p: [p, False, False, 5, 0]
    assert [(x[0], x[2]) for x in w.folded([e(p) for p in "a h p h p h p z".split()])] == [("a", False), ("h", True), ("p", True), ("z", False)]
    got = w.aligned([e(p) for p in "abd"], [e(p) for p in "acd"])
    assert [(x[0], x[1]) for x in got] == [("a", False), ("b", True), ("c", True), ("d", False)]


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"http://plain.example/{i}", page(i * 7919 + 12345, 'div class="body-text"') ) for i in range(30)]
    rows += [(200, None, None), (201, "http://[bad", ""), (None, "http://h0.example/0", page(0)), (0, "http://h0.example/0", page(0))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    for limit in (w.BROADCAST, -1):
        w.BROADCAST, kept = limit, w.BROADCAST
        out = w.main_texts(df).collect()
        w.BROADCAST = kept
        assert len(out) == len(rows)
        for r in out:
            assert r.n_chars == len(r.text)
            if r.page_id is None or r.page_id < 40:
                assert r.text == (lambda n: f"Head & {n} One bold word {n} next {n} {n} Two {n} < 2")(r.page_id or 0)
            elif r.page_id < 200:
                n = (r.page_id - 100) * 7919 + 12345
                assert r.text == f"Head & {n} One bold word {n} next {n} {n} Two {n} < 2"
            else:
                assert r.text == ""
    assert w.main_texts(df.limit(0)).count() == 0


BARE = "<html><body><div class=top>Our site</div><ul>{menu}</ul><h1>Title {n}</h1><div class=text><p>{a}</p><p>Read this notice first.</p><p>{b}</p></div><div class=end>All rights</div></body></html>"


def bare(n, menu=3):
    words = " ".join(f"w{n * k}" for k in range(30))
    return BARE.format(n=n, a=words, b=words[::-1], menu="".join(f"<li><a href=/{k}>Item {n} {k}</a></li>" for k in range(menu)))


def test_the_expression_decides_where_no_element_marks_the_article(spark):
    rows = [(n, f"http://bare.example/{n}", bare(n, n % 4)) for n in range(1, 41)]
    inside = PAGE.replace("<p>Two", "<p>The same notice on each page.</p><p>Two")
    rows += [(100 + n, f"http://main.example/{n}", inside.format(n=n, open="<main>", close=f"<p>own {' words' * n}</p></main>")) for n in range(12)]
    out = {r.page_id: r.text for r in w.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(1, 41):
        words = " ".join(f"w{n * k}" for k in range(30))
        assert out[n] == f"Title {n} {words} {words[::-1]}"
    for n in range(12):
        assert out[100 + n].startswith(f"Head & {n} One bold word {n} next {n} {n} Two {n} < 2") and "notice" not in out[100 + n]


def test_equal_pages_are_no_template(spark):
    rows = [(n, "http://few.example/x", bare(7)) for n in range(4)] + [(9, "http://single.example/", "<body><h1>Only title</h1><div><p>Some text of some length that is the body.</p></div></body>")]
    rows += [(20 + n, "http://copies.example/x", "<body><article><p>A passage that is the same.</p><p>" + "long text " * 40 + f"</p><p>{n}</p></article></body>") for n in range(30)]
    out = {r.page_id: r.text for r in w.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Title 7" in out[n] and "w7 w14" in out[n] and "Read this notice first." in out[n] for n in range(4))
    assert out[9] == "Only title Some text of some length that is the body."
    assert all(out[20 + n].startswith("A passage that is the same. long text") and out[20 + n].endswith(f" {n}") for n in range(30))
