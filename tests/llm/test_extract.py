"""Main texts of pages: made pages with known articles, and the driver's pages against a plain reading of their one template."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import extract as x


def own(source):
    page = x.Page(source)
    return page.text(page.chosen())


SENTENCES = [f"This is sentence number {i} of a text that goes on for a while, as texts do." for i in range(60)]


def paragraphs(r, n):
    return [" ".join(r.sample(SENTENCES, 3)) for _ in range(n)]


def around(body, r):
    """Menus, headers, footers, notices, adverts, forms, sidebars and comments around ``body``."""
    links = "".join(f'<li><a href="/{i}">Go to page {i}</a></li>' for i in range(8))
    note = r.choice(['<div class="cookie-notice">', '<div id="gdprConsent">', '<section role="alert">'])
    return f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar page-{r.randint(1, 999)}">
    <header><h1>The Site</h1><p>A motto that is not news.</p></header><nav><ul>{links}</ul></nav>{note}<p>We use cookies, as everyone does. Accept them now.</p></div></section>
    <div class="layout-{r.randint(1, 99)}"><div class="ad-slot"><p>Buy now and save a lot of money today.</p></div>{body}<aside><p>Something else that was read by many people last week.</p></aside>
    <div id="sidebar-{r.randint(1, 9)}"><p>Not a part of it, not a part of it, not a part of it.</p></div></div>
    <section class="comments"><h3>2 comments</h3>{"".join(f'<div class="comment-body"><p>I think {s}</p></div>' for s in SENTENCES[: r.choice([2, 2, 2, 30])])}</section>
    <form action="/s"><label>Search this site for words</label><select><option>one<option>two</select><textarea>text</textarea><button>Go</button></form>
    <footer>&copy; 2024 The Site. All rights reserved.</footer></body></html>"""


TEMPLATES = {
    "article": lambda ps, t, r: f"<article><h1>{t}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</article>",
    "numbered": lambda ps, t, r: f'<div class="post-{r.randint(1, 10**6)} entry"><h1>{t}</h1>{"".join(f"<p>{p}" for p in ps)}</div>',
    "sections": lambda ps, t, r: f'<main><h1>{t}</h1>{"".join(f"<section><p>{p}</p></section>" for p in ps)}</main>',
    "title outside": lambda ps, t, r: f'<div class="story"><h1>{t}</h1><div class="text">{"".join(f"<p>{p}</p>" for p in ps)}</div></div>',
    "header in article": lambda ps, t, r: f'<article><header><h1>{t}</h1><p>By someone</p></header>{"".join(f"<p>{p}</p>" for p in ps)}<footer>Tags: a, b</footer></article>',
    "lists": lambda ps, t, r: f'<div id="c{r.randint(1, 99)}" class="x"><h1>{t}</h1><ul>{"".join(f"<li>{p}" for p in ps)}</ul></div>',
}


def made():
    r, rows, want = random.Random(8), [], {}
    for k, (name, make) in enumerate(TEMPLATES.items()):
        for i in range(12):
            ps, title = paragraphs(r, 1 if i == 11 else r.randint(3, 8)), f"A title of page {k}/{i}"
            key = 100 * k + i
            rows.append((key, f"https://{name.replace(' ', '-')}.example.org:80/{i}?q", around(make(ps, title, r), r)))
            want[key] = "\n".join([title, *ps])
    return rows, want


@pytest.mark.parametrize("most", [8 << 20, -1])
def test_articles_are_found_by_consensus(spark, monkeypatch, most):
    monkeypatch.setattr(x, "MOST", most)
    rows, want = made()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in x.extract(df).collect()}
    assert got == want


def test_votes_and_winners_equal_plain_loops(spark):
    rows, _ = made()
    rows += [(900 + i, "http://Mixed.example.org", own) for i, own in enumerate(["<article><p>a b c</p></article>"] * 15 + ["<div class=k7><p>d e f</p></div>"] * 4 + ["<section>once</section>"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    cast = Counter()
    for _, url, source in rows:
        page = x.Page(source)
        cast[re.match(r"https?://([^/:]*)", url.lower()).group(1), page.told(page.chosen())] += 1
    got = x.votes(df)
    assert {(r["host"], r["path"]): r["votes"] for r in got.collect()} == cast
    total = Counter()
    for (host, _), n in cast.items():
        total[host] += n
    best = defaultdict(list)
    for (host, path), n in cast.items():
        if n >= 0.1 * total[host]:
            best[host].append((-n, path))
    told = {r["host"]: r["paths"] for r in x.winners(got).collect()}
    assert set(told) == set(best) and all(set(told[h]) == {p for _, p in best[h]} for h in best)
    assert told["mixed.example.org"] == ["article", "div.k"]


def test_a_page_with_long_comments_follows_its_host(spark):
    page = lambda text, more: f'<body><div class="b{len(text)}"><p>{text}</p></div><div class="r"><p>{more}</p></div></body>'
    rows = [(i, "http://h.example.org/", page(SENTENCES[i] * 9, "Yes.")) for i in range(9)] + [(9, "http://h.example.org/9", page(SENTENCES[9], "I say so. " * 90))]
    got = {r["page_id"]: r["text"] for r in x.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(([SENTENCES[i] * 9, SENTENCES[9]][i == 9]).split()) for i in range(10)}


def test_markup():
    assert own("") == own(None) == own("   ") == own("<!-- only a comment") == own("<p></p><br>") == ""
    assert own("just text") == "just text" and own("<p>a &lt;b&gt; &amp;amp; &#233;&#x4e2d; &copy; &nbsp; c</p>") == "a <b> &amp; é中 © c"
    assert own("<article><p>one<p>two<br>lines<div>three</div>four</article>") == "one\ntwo lines\nthree\nfour"
    assert own("<article>a<b>b</b>c <i>d</i>\n\t e</article>") == "abc d e"
    assert own("<article><p>5 < 6 and 7 > 3</p></article>") == "5 < 6 and 7 > 3"
    assert own('<article><p title="a > b" data-x=\'</p>\'>kept</p><script>if (a<b) "</p>"</script><style>p{}</style></article>') == "kept"
    assert own("<ARTICLE><P>Loud</P><SCRIPT>x</script  ></ARTICLE>") == "Loud"
    assert own("<article><p>cut off <b>here <a hre") == "cut off here"
    assert own("<article><p>a <span class='ad'>buy</span> b</p><p hidden>no</p><p style='display: none'>no</p><div class='share-buttons'>Share</div></article>") == "a b"
    assert own("<article><p>x</p><ul><li><a>One link</a><li><a>Two links</a></ul><ul><li>A point <a>of</a> it.<li>Another point.</ul></article>") == "x\nA point of it.\nAnother point."
    assert own("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert own("<nav>menu</nav><footer>foot</footer>") == ""
    assert own("<div></div></div></p></b>text</article>") == "text"
    assert own("<body><article class='comment'><p>A comment</p></article><article><p>The article.</p></article></body>") == "The article."


def test_long_and_deep_pages():
    n = 20_000
    assert own("<div>" * n + "deep" + "</div>" * n) == "deep"
    assert own("<b>" * n + "bold") == "bold"
    assert own("<article>" + "<p>word" * n + "</article>") == "\n".join(["word"] * n)
    assert own("<a <" * n + "x") is not None and own("<p a='" * n) is not None and own("&" * n) == "&" * n


def test_query_reads_the_drivers_template(spark):
    """Every page has the article element; its blocks are cut at p, h1 and nothing else."""
    got = x.query(spark, "/root/testdata/sf0.001").collect()
    rows = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(got) == len(rows)
    for r in got:
        source = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", rows[r["page_id"]]["html"]).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", source)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


@pytest.mark.parametrize("most", [8 << 20, -1])
def test_nulls_repeats_and_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(x, "MOST", most)
    rows = [(1, None, "<p>a"), (2, "", "<p>b"), (3, "no host", "<article>c</article>"), (4, "http://h/", None), (None, "http://h/", "<p>e</p>"), (5, "//h:1/x", ""), (5, "//h:1/x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("text", "path", "_text", "_path", "_paths", "_host", "_html", "_salt", "host", "paths")})
    got = x.extract(df)
    assert Counter((r["page_id"], r["text"]) for r in got.collect()) == Counter([(1, "a"), (2, "b"), (3, "c"), (4, ""), (None, "e"), (5, ""), (5, "")])
    assert set(got.columns) == set(df.columns) and {r["_text"] for r in got.collect()} == {"_text"}
    assert x.extract(df.where("false")).count() == 0
