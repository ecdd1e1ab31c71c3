"""URL filter and main-text extraction."""

import html
import re

import pytest
from shroud.llm import queries, templates, urls

SF = "/root/testdata/sf0.01"


def parse(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(r, v) for r, v in urls.RULES for site, _, rest in [r.partition("/")]
            if (host == site or host.endswith("." + site)) and path.startswith("/" + rest)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def check_rows(rows, source):
    for r in rows:
        host, path = parse(source[r.page_id])
        text, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def test_query(spark):
    rows = queries.op1_url_filter(spark, SF).collect()
    source = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    check_rows(rows, source)
    for r in rows:
        if r.rule is None:
            assert r.verdict == ("block" if re.search("adult|casino|pills|bets|spam-|ads-", r.host) else "allow"), r


def test_edge_urls(spark):
    cases = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://a.example.org/en/12?q#f", "http://example.org",
             "http://xorg/", "https://org/es/", "x://Ünï.com/de/é\n/b?c", "http://h.com/de", "http://h.com/de/", "a://b://c/d",
             "http://" + "z" * 400 + "/" + "q" * 3000, "http://casinobonus.net/x", "http://casinobonus.net/x"]
    pages = spark.createDataFrame([(i, u, "s", "w", 1) for i, u in enumerate(cases)],
                                  "page_id long, url string, side string, word string, host int").repartition(3)
    rows = urls.judge(pages).withColumnRenamed("id", "page_id").collect()
    assert len(rows) == len(cases)
    check_rows(rows, dict(enumerate(cases)))
    assert {r.verdict for r in rows if r.host == "casinobonus.net"} == {"block"}
    assert next(set(r.words) for r in rows if r.host == "casinobonus.net") == {"casino", "bonus", "net"}
    assert urls.judge(pages.where("page_id < 0")).count() == 0


def test_a_very_long_path(spark):
    """A path of a hundred thousand letters takes seconds, for only window-sized pieces of it travel."""
    import time

    path = "freecasinopage" * 7_143
    pages = spark.createDataFrame([(1, f"http://plain.example.com/{path}"), (2, "http://casinobonus.net/x"), (3, f"http://h.com/{path}/y")], "page_id long, url string")
    start = time.time()
    rows = {r.id: r for r in urls.judge(pages).collect()}
    assert time.time() - start < 60
    assert rows[1].path == f"/{path}" and rows[2].verdict == "block"


def test_best_split_against_all_splits():
    import itertools
    import math

    counts = {"free": 40, "bets": 30, "be": 9, "ts": 2, "fr": 1}
    total = float(sum(counts.values()))

    def cost(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

    for run in ("freebets", "bets", "xfree", "tsbe"):
        known = {}
        for a, b in itertools.combinations(range(len(run) + 1), 2):
            if run[a:b] in counts:
                known.setdefault(b, []).append((a, math.log(counts[run[a:b]] / total)))
        every = [[run[a:b] for a, b in zip((0, *cut), (*cut, len(run)))] for n in range(len(run))
                 for cut in itertools.combinations(range(1, len(run)), n)]
        assert cost(urls.best_split(run, known, total)) == pytest.approx(max(map(cost, every)))


def text_of(source, recurring=frozenset()):
    return templates.Page(source).text(recurring)


def test_article_text():
    assert text_of("<title>T</title><nav>menu</nav><article><h1>A &amp;  B</h1><p>one\n two<p>three <b>bold</b>face<br>x"
                   "<script>no('</p>')</script></article><footer>f</footer>") == "A & B\none two\nthree boldface x"
    assert text_of("<body><div id='sidebar'>s</div><p>a&nbsp;&nbsp;b &lt;c&gt;</p><form>q<input></form><!-- c --><p>d") == "a b <c>\nd"
    assert text_of("<article>x<aside>y</aside><div class='reader-comments'>z</div><ul><li>1<li>2</ul></article>") == "x\n1\n2"
    assert text_of("") == "" and text_of("plain") == "plain" and text_of("a < b <p") == "a < b"
    assert text_of("<div class=\"ad\"><p>x</p></div><main><header><h1>t</h1></header>y</main>") == "t\ny"
    assert text_of("<article><style>p{}</style><p>v<!-- unclosed") == "v"
    assert text_of("<p title='a>b'>t</p><p class=\"x>") == "t"


def pages_of(spark, n=12):
    box = "<div><p>Welcome to our site</p><p>Call us</p></div>"
    rows = [(i, f"http://h.com/{i}", f"<body>{box}<div><p>Story {i} begins</p><p>and ends {i}</p></div><div>Copyright</div>") for i in range(n)]
    rows += [(100, "http://other.com/", f"<body>{box}<p>alone"), (101, None, None), (102, "http://h.com/x", ""),
             (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    rows += [(200 + i, f"http://art.com/{i}", f"<article><p>Same line</p><p>own {i}</p><div>Subscribe now</div></article><p>foot") for i in range(8)]
    return spark.createDataFrame([(*r, "k", 7) for r in rows], "page_id long, url string, html string, host string, key int").repartition(4)


def test_template_removal(spark):
    rows = templates.extract(pages_of(spark)).collect()
    got = {r.id: r for r in rows}
    assert len(rows) == 25 and all(r.n_chars == len(r.text) for r in rows)
    assert got[3].text == "Story 3 begins\nand ends 3" and got[0].text == "Story 0 begins\nand ends 0"
    assert got[100].text == "Welcome to our site\nCall us\nalone"  # one page of its host is no template
    assert got[101].text == "" and got[102].text == ""
    assert got[203].text == "Same line\nown 3"  # the article's own paragraphs stay, boxes that recur go
    assert templates.extract(pages_of(spark).where("page_id < 0")).count() == 0


def test_query_keeps_whole_articles(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_template_removal(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert r.text == "\n".join(filter(None, blocks))


def test_copies_under_other_urls_are_no_template(spark):
    article = "<link rel='canonical' href='{u}'><div>Top {u}</div><article><h1>T</h1><div>Own box</div><ul><li>a</li><li>b</li></ul></article>"
    plain = "<body><div><h2>Only</h2><p>one story</p></div><section>and its end</section></body>"
    box = "<div>Welcome</div>"
    urls_of = lambda host: [f"http://{host}/{i}" for i in range(36)]
    rows = [(u, article.format(u=u), "T\nOwn box\na\nb") for u in urls_of("copies.com")]
    rows += [(u, plain, "Only\none story\nand its end") for u in urls_of("plain.com")]
    # A box of many different pages is template on copies, too.
    rows += [(u, f"<body>{box}<div>Story</div>", "Story") for u in urls_of("mixed.com")]
    rows += [(f"http://mixed.com/own/{i}", f"<body>{box}<div>Text {i}</div>", f"Text {i}") for i in range(5)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = {r.id: r.text for r in templates.extract(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def near_copies(n, article):
    """Pages of one long text that differ in one line."""
    lines = [f"<p>Line {k} of the common story, long enough to count.</p>" for k in range(12)]
    for i in range(n):
        body = "".join([*lines[:6], f"<p>Only here {i}</p>", "<ul><li>one</li><li>two</li></ul><div><p>A box of its own</p></div>", *lines[6:]])
        text = [re.sub("<[^>]*>", "", x) for x in lines[:6]] + [f"Only here {i}", "one", "two", "A box of its own"] + [re.sub("<[^>]*>", "", x) for x in lines[6:]]
        yield f"<body>{'<article>' * article}<div>{body}</div>{'</article>' * article}</body>", "\n".join(text)


@pytest.mark.parametrize("article", [False, True])
def test_near_copies_keep_their_text(spark, article):
    rows = [(f"http://four.com/{i}", h, t) for i, (h, t) in enumerate(near_copies(4, article))]
    rows += [(f"http://forty.com/{i}", h, t) for i, (h, t) in enumerate(near_copies(40, article))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    assert {r.id: r.text for r in templates.extract(df).collect()} == {i: t for i, (_, _, t) in enumerate(rows)}


def test_shared_tables_and_subjects_stay_in_articles(spark):
    page = ("<article><h1>Match {i}</h1><p>Report number {i} on what happened in the game between teams {i} and more.</p>"
            "<table><tr><td>Draw 1-1</td></tr></table><div class='related-work'><p>Work of {i}</p></div><section id='social'>Life {i}</section>"
            "<div class='related-posts'>Read on</div><div class='share-buttons'>Share</div><p class='comments'>first!</p></article>")
    rows = [(i, f"http://sport.com/{i}", page.format(i=i)) for i in range(4)]
    # A box that only a few of the host's many articles share stays, one of most of them goes.
    rows += [(10 + i, f"http://big.com/{i}", f"<article><p>Story {i} has its own words {i}</p><div>{'Score 2-0' if i < 4 else f'Score {i}'}</div>"
              f"<div>Subscribe now</div></article>") for i in range(40)]
    got = {r.id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i] == f"Match {i}\nReport number {i} on what happened in the game between teams {i} and more.\nDraw 1-1\nWork of {i}\nLife {i}"
    for i in range(40):
        assert got[10 + i] == f"Story {i} has its own words {i}\n{'Score 2-0' if i < 4 else f'Score {i}'}"


def test_deep_pages_take_linear_time():
    import time

    start = time.time()
    assert text_of("<div>x" * 100_000) == "\n".join(["x"] * 100_000)
    assert text_of("<center>x</b></i></li></table>" * 50_000).count("x") == 50_000
    assert time.time() - start < 20
