"""URL filters and main text of pages."""

import pytest

from gaitworks.llm import html, url_filter

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
    ("a.org", "", "block"), ("b.org", "/x", "block"), ("b.org", "/x", "allow"), (None, "/", "block"),
]
URLS = [
    "http://example.net/en/1", "https://sub.EXAMPLE.net/de/", "http://example.net", "http://notexample.com/de/x", "x://example.com/de/x?y#z",
    "http://www.example.com/DE/", "http://a.org", "http://q.a.org/fr/", "http://b.org/xyz", "http://b.org/y?http://net/", "no scheme net/",
    None, "", "://", "://net/", "http://net:80/", "http://u@net/", "http://" + "a." * 500 + "net/" + "p/" * 500, "http://É.net/ü",
    "http://net#x", "http://net?x", "http://..net/", "a\n://net/\nb/c",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    return host, path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def verdict(url, default):
    host, path = parts(url)
    able = [r for r in RULES if r[0] is not None and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not able:
        return host, path, None, default
    best = max(able, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"))
    return host, path, best[0] + best[1], best[2]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rules_against_plain_python(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    rows = [(i if i % 5 else None, u, "h", {"k": 1}) for i, u in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, m map<string, int>")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    found = url_filter.judge(pages, rules, default="review")
    assert found.columns == ["page_id", "url", "m", "host", "path", "rule", "verdict"]
    got = sorted((r["url"] or "", r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found.collect())
    expected = [(u, *verdict(u, "review")) for u in URLS + URLS[:4]]
    assert got == sorted((u or "", h, p, r or "", v) for u, h, p, r, v in expected)


def test_no_pages_and_no_rules(spark):
    pages = spark.createDataFrame([("http://net/",)], "url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.judge(pages, rules.limit(0)).collect()] == [("http://net/", "net", "/", None, "allow")]


def test_the_judgement_stays_in_the_engine(spark):
    pages = spark.createDataFrame([("http://net/",)], "url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


ARTICLE = "<p>First &amp; <b>bold</b>\n text.</p><p>Second<br>line &eacute;&#33; with words enough to win.<ul><li>one<li>two</ul>"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><article>x';</script></head><body class=x>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav><!-- <p>no --><div class='cookie-notice'>We use cookies</div>"
    "<div id=main class='post-17'>{}<div class=ads>Buy</div><aside><p>side</p></aside><form><p>mail</p></form>"
    "<section class='comments'><p>A reader wrote a very long comment, much longer than the article, over and over and over and over.</p></section>"
    "</div><footer>&copy; x</footer></body></html>"
)
TEXT = "First & bold text.\nSecond line é! with words enough to win.\none\ntwo"


def test_main_text_of_a_page():
    assert html.extract(PAGE.replace("{}", ARTICLE), None) == TEXT


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        ("<p>only a block</p>", ""),
        ("<body>bare &lt;text&gt;", "bare <text>"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <b", "cut"),
        ("<article><p>a</p><scr", "a"),
        ("<article>a<script>b", "a"),
        ("<article><nav>menu</article>", ""),
        ("<body><article><p>words<nav>menu</article><p>tail</body>", "words"),
        ("<article><p title='a>b'>q</p><p title=\"x>y\">r</p></article>", "q\nr"),
        ("<article><p>broken 'quote <i title='x>y</i> z</p></article>", "broken 'quote y z"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>a\u00a0\t b&nbsp;c</p></article>", "a b c"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article><p>" + "word " * 200000 + "</p></article>", ("word " * 200000).strip()),
    ],
)
def test_odd_pages(page, text):
    assert html.extract(page, None) == text


def test_hosts_vote_and_pages_follow(spark):
    good = PAGE.replace("{}", ARTICLE)
    # on this page alone a list of offers would win
    odd = good.replace("</div><footer>", "</div><div class=offers>" + "<p>offer and text</p>" * 30 + "</div><footer>").replace("post-17", "post-4")
    rows = [(1, "http://h/1", good, 5), (2, "http://H/2", good, 5), (3, "http://h/3", odd, 5), (4, "http://other/", odd, 5), (None, None, None, None)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text int")
    found = html.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found.collect())
    offers = "\n".join(["offer and text"] * 30)
    assert got == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, TEXT, len(TEXT)), (3, TEXT, len(TEXT)), (4, offers, len(offers))]
    assert html.main_text(pages.limit(0)).count() == 0


LONG = "Many words of the text that make it the longest part. " * 8


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body><article><h1>Head</h1><p>lead</p><div class=body><p>{}</p></div></article>", "Head\nlead\n{}"),
        ("<body><article><section id=intro><p>short</p></section><section id=methods><p>{}</p></section></article>", "short\n{}"),
        ("<body><article><p>before</p><table><tr><td>{}</table><p>after</p></article>", "before\n{}\nafter"),
        ("<body><div class=a><h1>Head</h1><table><tr><td>{}</table></div><div class=offers>offer</div>", "Head\n{}"),
        ("<body><h1>Head</h1><a href=x>top</a><div class=text><p>{}</p></div><div class=offers>offer</div>", "Head\n{}"),
        ("<body><main><h1>Head</h1><article><p>{}</p></article></main><p>tail", "Head\n{}"),
        ("<body><div class=a>" + "".join(f"<section id=s{c}><p>part {c} of many</p></section>" for c in "abcdef") + "</div><div class=box>some other box</div>", "\n".join(f"part {c} of many" for c in "abcdef")),
    ],
)
def test_the_whole_text_around_the_longest_part(page, text):
    assert html.extract(page.replace("{}", LONG), None) == text.replace("{}", LONG.strip())


def test_pages_without_a_body_tag_have_their_text(spark):
    bare = "<!DOCTYPE html><title>T</title><h1>Head</h1><nav><a href=x>menu</a></nav><p>First.<p>Second."
    rows = [(1, "http://bare/1", bare), (2, "http://bare/2", "<html>" + bare), (3, "http://mixed/1", bare), (4, "http://mixed/2", bare)]
    rows += [(5, "http://mixed/3", PAGE.replace("{}", ARTICLE)), (6, "http://words/", "plain words")]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    whole = "Head\nFirst.\nSecond."
    assert {r["page_id"]: r["text"] for r in found.collect()} == {1: whole, 2: whole, 3: whole, 4: whole, 5: TEXT, 6: "plain words"}


@pytest.mark.parametrize(
    "wrapper",
    [
        "main class='content has-sidebar'", "div id='page-with-sidebar'", "div class='no-comments'", "article class='post category-social tag-search'",
        "div class='search-results'", "section id=widget-area", "div class='comments'",
    ],
)
def test_a_word_in_a_name_does_not_remove_the_text(wrapper):
    tag = wrapper.split()[0]
    page = f"<body><{wrapper}><h1>Head</h1><p>{LONG}</p><div class=related>more</div></{tag}><div class=sidebar><p>side</p></div></body>"
    assert html.extract(page, None) == "Head\n" + LONG.strip()


def test_a_name_on_the_path_of_the_host_stays(spark):
    page = "<body><div class='search-results'><h1>Head</h1><p>{}</p></div><div class=sidebar><p>" + "side " * 20 + "</p></div></body>"
    rows = [(i, "http://h/", page.replace("{}", text)) for i, text in enumerate([LONG, LONG, "short"])]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {0: "Head\n" + LONG.strip(), 1: "Head\n" + LONG.strip(), 2: "Head\nshort"}


@pytest.mark.parametrize("name", ["ad", "comments", "cookie-notice"])
def test_a_box_longer_than_the_article_goes(name):
    page = f"<body><div class={name}><p>{LONG}</p></div><article><h1>Head</h1><p>{{}}</p></article></body>"
    assert html.extract(page.replace("{}", "short"), None) == "Head\nshort"
    assert html.extract("<body><article></article>" + page.split("<article>")[0][6:], None) == ""
