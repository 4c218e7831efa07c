import itertools
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from sparsewright.llm import html_extract
from sparsewright.llm.html_extract import blocks, extract, main_text, minimum_cut, network

PROSE = "This is a sentence of the article that goes on for some time, as prose does."


def _cost(label, scores, links):
    unary = sum(abs(s) for s, k in zip(scores, label, strict=True) if s and (s > 0) != k)
    return unary + sum(c for i, j, c in links if label[i] != label[j])


def test_minimum_cut_has_the_least_cost():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(1, 9)
        scores = [r.choice([-2, -1, -0.5, 0, 0.5, 1, 3]) * r.random() for _ in range(n)]
        links = [(i, j, r.random() * 1.5) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        got = minimum_cut(scores, links)
        least = min(_cost(label, scores, links) for label in itertools.product((False, True), repeat=n))
        assert abs(_cost(got, scores, links) - least) < 1e-9


def test_every_kind_of_boilerplate_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a> Site name</header><div class="cookie-notice">We use cookies.</div><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div id="sidebar"><p>{PROSE} Side.</p></div><!-- <p>hidden</p> --><article class="post"><h1>Head &amp; line</h1><p>{PROSE}<br>One&nbsp;more   &lt;line&gt;
    <p><b>{PROSE}</b><ul><li>An item of a list in the text.</ul><div class='ad'>Buy now.</div><form><input><label>Name</label> Send</form>
    <section id="comments"><p>{PROSE} says a reader.</p></section></article><aside>{PROSE}</aside><footer>&copy; 2020 Site</footer></body></html>"""
    assert main_text(page) == f"Head & line {PROSE} One more <line> {PROSE} An item of a list in the text."


class Plain(HTMLParser):
    """An independent reader: all blocks, and the article's, of pages with these block elements only."""

    BLOCK = ("html", "body", "nav", "ul", "li", "div", "article", "h1", "p", "footer", "head", "title")

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.every, self.main, self.now, self.inside, self.silent = [], [], [], False, 0
        self.feed(page)
        self.flush()

    def flush(self):
        if words := " ".join("".join(self.now).split()):
            self.every.append(words)
            if self.inside:
                self.main.append(words)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.flush()
        self.inside |= tag == "article"
        self.silent += tag in ("head", "script", "style")
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.flush()
        self.inside &= tag != "article"
        self.silent -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.silent:
            self.now.append(data)


def test_an_independent_parser_agrees_and_the_cut_turns_blocks(spark, monkeypatch):
    flows, turned, real = [], 0, html_extract._source_side
    monkeypatch.setattr(html_extract, "_source_side", lambda nodes, *rest: flows.append(len(nodes)) or real(nodes, *rest))
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        found, holders = blocks(page)
        plain = Plain(page)
        assert [b.words for b in found] == plain.every
        assert main_text(page) == " ".join(plain.main)
        costs, links = network(found, holders)
        label = minimum_cut(costs, links)
        turned += sum((c > 0) != k for c, k, _ in zip(costs, label, found, strict=False))
    assert turned > 100 and len(flows) > 100


def test_names_of_holders_are_whole_words():
    for start in ('div class="entry-header"', 'div class="content has-sidebar"', 'div class="article-share"', 'article data-id="ad"', 'article data-id="77"', 'div title="class=ad"'):
        tag = start.split()[0]
        assert main_text(f"<body><{start}><p>{PROSE}</p></{tag}>") == PROSE, start
    for start in ('div class="cookie-notice"', "div id=sidebar", 'div class="site-footer"', 'section id="comments"', 'div role="navigation"', 'aside class="content"'):
        tag = start.split()[0]
        inner = f"<{start}>" + f"<p>{PROSE} Other.</p>" * 12 + f"</{tag}>"
        assert main_text(f"<body>{inner}") == "" and main_text(f"<article><p>{PROSE}</p>{inner}<p>{PROSE}</p></article>") == f"{PROSE} {PROSE}", start


def test_odd_pages():
    assert main_text("") == "" and main_text("<p") == "" and main_text("<nav>a</nav>") == ""
    assert main_text(f"<p>{PROSE}<script>x") == PROSE
    assert [b.words for b in blocks("<p>a<p>b<div>c<b>d</b></div>e")[0]] == ["a", "b", "cd", "e"]
    assert main_text("<article><ul>" + "<li><a href=x>An item</a>" * 9 + "</ul></article>") == ""
    deep = "<div>" * 20000 + PROSE
    assert main_text("<article>" + deep) == PROSE
    assert len(main_text("<article><p>" + "word " * 300000)) == 5 * 300000 - 1


def test_query_on_the_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    out = extract(pages).collect()
    assert len(out) == len(whole) and all(r["text"] == main_text(whole[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in out)
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in extract(odd).collect()] == [("", 0)] * 3
    assert extract(odd.filter(F.lit(False))).count() == 0
