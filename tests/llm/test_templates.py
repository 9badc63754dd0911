import re
from html import unescape

from pairlab.llm import templates

from .conftest import TABLES

SHELL = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a = "</p><p>x";</script></head>
<body><header><div class="logo">Site</div></header><nav><ul><li><a href="/a">Menu {t}</a><li>Other</ul></nav>
<div class="cookie-notice">We use cookies</div>{main}<aside>Side {t}</aside>
<form><input name="q"><button>Go</button></form><section id="comments"><p>First! {t}</p></section>
<footer>&copy; Site</footer>{end}"""
BODY = """<h1>Title {t} &amp; more</h1><p><b>Bold {t}<br><p>A&nbsp;b <i>c</i>d &lt;tag&gt; &#8364;&eacute;
   text {t}<!-- <p>hidden</p> --><div class="ad">Buy {t}</div><ul><li>one<li>two {t}</ul><p style="display:none">no</p>"""
WANT = "Title {t} & more Bold {t} A b cd <tag> €é text {t} one two {t}"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "host", "p", "t") for k, u, h in rows], "page_id long, url string, html string, host string, path string, text string")


def test_layouts(spark):
    wraps = {
        "a.example": "<article>{}</article>", "b.example": "<main><div class='x'>{}</div></main>",
        "c.example": "<div id='wrap'><div class='post-content'>{}</div></div>", "d.example": "<div class='q1'><div class='q2'>{}</div></div>",
    }
    rows, want = [], {}
    for host, wrap in wraps.items():
        for t in ("eins", "zwei", "drei"):
            long = " ".join(f"{t}{i}" for i in range(60))
            inner = (BODY + f"<p>{long}</p>").replace("{t}", t)
            html = SHELL.format(t=t, main=wrap.format(inner), end="</body></html>" if t != "drei" else "")
            rows.append((len(rows), f"https://{host}/{t}", html))
            want[len(rows) - 1] = f"{WANT.format(t=t)} {long}"
    out = {r["page_id"]: r["text"] for r in templates.extract(pages(spark, rows), "page_id", "url", "html").collect()}
    assert out == want
    salted = templates.extract(pages(spark, rows), "page_id", "url", "html", few_hosts=1, salts=3).collect()
    assert {r["page_id"]: r["text"] for r in salted} == want


def test_pages_table(spark):
    df = spark.read.parquet(f"{TABLES}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in templates.extract(df, "page_id", "url", "html").collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", article)))
        assert got[r["page_id"]] == " ".join(plain.split())


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "", ""), (3, "no url", "plain text, no markup"), (4, "http://x.y/", "<p>only"),
        (5, "http://x.y/", "<"), (6, "HTTP://U@X.Y:80/z", "</article><article>ok &bogus; &amp"), (7, None, deep),
        (None, "http://x.y/", "<article>a</article>"), (8, "http://x.y/", "<article>" + "long text " * 30_000 + "</article>"),
        (9, "http://z/", "<article>same</article>"), (9, "http://z/", "<article>same</article>"),
        (10, "http://n/", "<body><nav>menu</nav><footer>end</footer>"), (11, "http://q/", "<p title='unclosed>text"),
    ]
    out = templates.extract(pages(spark, rows), "page_id", "url", "html").collect()
    assert len(out) == len(rows)
    text = {r["page_id"]: r["text"] for r in out}
    assert text[1] == text[2] == text[10] == "" and text[3] == "plain text, no markup" and text[4] == "only"
    assert text[6] == "ok &bogus; &" and text[7] == "deep" and text[None] == "a" and len(text[8]) == 299_999
    assert [r["text"] for r in out if r["page_id"] == 9] == ["same", "same"]
    assert templates.extract(pages(spark, rows).limit(0), "page_id", "url", "html").count() == 0


def test_copies_are_no_template(spark):
    """All pages of a host hold the same article: it is text all the same."""
    rows = [(k, "http://h/", "<body><nav>m</nav><article><h1>Same</h1><p>words here</p></article>") for k in range(9)]
    assert {r["text"] for r in templates.extract(pages(spark, rows), "page_id", "url", "html").collect()} == {"Same words here"}


def read(spark, rows, **limits):
    out = templates.extract(pages(spark, rows), "page_id", "url", "html", **limits).collect()
    return {r["page_id"]: r["text"] for r in out}


def test_names_never_drop_most_of_the_text(spark):
    """Listed words in class or id choose between slots; they do not drop what holds the article."""
    wraps = [
        "<div class='page has-sidebar'><div class='sidebar'>Side</div>{}</div>", "<div class='content with-nav'>{}</div>",
        "<article class='post comments-open'>{}</article>", "<div class='story social-post'>{}</div>",
        "<form id='aspnetForm'><div class='menu'>Menu</div><div>{}</div></form>", "<div id='search'><main>{}</main></div>",
    ]
    rows, want = [], {}
    for w, wrap in enumerate(wraps):
        for k in range(3):
            article = " ".join(f"w{w}x{k}y{i}" for i in range(30))
            main = wrap.format(f"<p>{article}</p>")
            want[len(rows)] = article
            rows.append((len(rows), f"http://h{w}/", f"<body><nav>m</nav>{main}<div class='share'>Share {k}</div></body>"))
    assert read(spark, rows) == want


def test_texts_of_every_page_are_template(spark):
    """Nothing but the deduction tells the claim, the hint and the legal text from the article."""
    rows, want = [], {}
    for k in range(6):
        article = " ".join(f"w{k}y{i}" for i in range(40))
        more = "<p>again</p>" * k
        rows.append((k, "http://h/", f"<body><div class='x1'>Our claim</div><div class='x2'><h1>T{k}</h1><p>{article}</p>"
                     f"<p>Read on</p>{more}</div><div class='x3'>All rights <b>ours</b></div></body>"))
        want[k] = " ".join([f"T{k}", article, *["again"] * k])
    assert read(spark, rows) == want
    assert read(spark, rows, few_hosts=0, salts=3) == want
    near = [(k, "http://h/", f"<body><div class='t'>at {k}</div><div class='x'><p>{want[0]}</p></div></body>") for k in range(6)]
    assert read(spark, near) == {k: f"at {k} {want[0]}" for k in range(6)}


def test_siblings_hold_one_article(spark):
    """Without an element around them, all slots are text, not the largest alone."""
    rows, want = [], {}
    for h, (first, second) in enumerate((("entry-header", "entry-content"), ("post-body", "post-more"), ("q1", "q2"))):
        for k in range(5):
            head, rest = (" ".join(f"{a}{h}x{k}y{i}" for i in range(n)) for a, n in (("a", 20), ("b", 40)))
            want[len(rows)] = f"{head} {rest}"
            rows.append((len(rows), f"http://h{h}/", f"<body><nav>m</nav><div class='z'>Claim</div><div class='{first}'><h1>{head}</h1></div>"
                         f"<div class='{second}'><p>{rest}</p></div><div class='sidebar'>Side {k}</div></body>"))
    assert read(spark, rows) == want


def test_template_per_layout(spark):
    """Three layouts of one host, none on half of its pages; two use the third's element for something small."""
    wraps = [
        "<div class='content'><p>{}</p></div>", "<div class='content'>Claim 1</div><div class='gallery'><p>{}</p></div>",
        "<div class='content'>Claim 2</div><div class='q'><div class='r'>{}</div></div>",
    ]
    rows, want = [], {}
    for k in range(15):
        w = k % 3
        want[k] = " ".join(f"w{w}x{k}y{i}" for i in range(30))
        rows.append((k, "http://h/", f"<body>{wraps[w].format(want[k])}<div class='s'>Legal text {w}</div></body>"))
    assert read(spark, rows) == want
    assert read(spark, rows, few_hosts=0, salts=3) == want
    assert read(spark, [*rows, (99, "http://h/", "<body><div class='content'>x</div><div class='u'>a page alone</div></body>")]) == {
        **want, 99: "x a page alone"}
