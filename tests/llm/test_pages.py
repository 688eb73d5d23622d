"""Main text of pages and the URL filter."""

from skein.llm.htmltext import extract_text, main_text
from skein.llm.urls import best_split, judge_urls

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def test_article_without_side_parts():
    page = (
        '<html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>a</a></nav></header><!-- <p>no</p> -->'
        '<article><header><h1>Title &amp; more</h1></header><p><b>First   para.<br><p>Second\npara &lt;3 <i>x</i>y.<ul><li>One<li>Two</ul>'
        '<div class="ad">Buy now</div><p>Of.</p><div id="comments"><p>Nice post, long comment text here to be dropped.</p></div></article>'
        "<aside>Side</aside><form><label>mail</label></form><footer>foot</footer><script>if (a<b) '</p>'</script></body>"
    )
    assert main_text(page) == "Title & more\nFirst para.\nSecond para <3 xy.\nOne\nTwo\nOf."


def test_core_without_article():
    page = "<body><div class=menu><a href=1>One</a><a href=2>Two</a></div><div id=wrap>" + "".join(
        f"<p>Paragraph {i} with quite a few words in it, enough to count as text.</p>" for i in range(4)
    ) + "<p>Short.</p></div><div>Copyright <a href=3>us</a></div></body>"
    lines = main_text(page).split("\n")
    assert lines[0].startswith("Paragraph 0") and lines[-1] == "Short." and len(lines) == 5


def test_odd_pages(spark):
    cases = {"": "", "plain": "plain", "<p>a<p>b": "a\nb", "<!-- x": "", "<script>x": "", "<div>1 < 2</div>": "1 < 2", "<a": "<a"}
    rows = [(i, "u", h, 1) for i, h in enumerate(cases)] + [(99, None, None, 1), (99, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect())
    assert got == sorted([(i, t, len(t)) for i, t in enumerate(cases.values())] + [(99, "", 0)] * 2)
    assert extract_text(df.limit(0)).count() == 0


def test_viterbi_splits():
    words = {"cheap": 50, "pills": 40, "pill": 10, "s": 5, "chea": 1}
    word = "cheappills"
    cuts = [(a, b - a, words[word[a:b]]) for a in range(10) for b in range(a + 1, 11) if word[a:b] in words]
    assert best_split(word, *zip(*cuts, strict=True), total=1000.0) == ["cheap", "pills"]
    assert best_split("", (), (), (), 10.0) == []
    assert "".join(best_split("zzzzq", (), (), (), 10.0)) == "zzzzq"


def test_rules_and_spam(spark):
    urls = {
        1: "http://a.b.net/x", 2: "https://Example.NET/en/1?q", 3: "http://example.com/de/", 4: "http://x.org/fr/#a", 5: None,
        6: "no scheme", 7: "http://notnet/x", 8: "http://www.net", 9: "http://casino-win.example.com/en/2", 10: "http://",
    }
    rows = [(i, u, "<p>casino win quiet river</p>", "h") for i, u in urls.items()]
    rows += [(100 + i, f"http://river{i % 7}.example.org/en/{i}", "<p>quiet river</p>", "h") for i in range(60)]
    rows += [(200 + i, f"http://casino-win.example.org/en/{i}", None, "h") for i in range(6)] + [(300, "http://casinowin.example.com/es/1", None, "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in judge_urls(df, RULES).collect()}
    assert {i: got[i].rule for i in urls} == {1: "net/", 2: "example.net/en/", 3: "example.com/de/", 4: "org/fr/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: None}
    assert (got[2].host, got[2].path, got[2].verdict) == ("example.net", "/en/1", "allow")
    assert (got[5].host, got[5].path, got[6].host, got[8].path) == ("", "", "", "")
    assert got[9].verdict == got[300].verdict == "block" and got[300].host_words[:2] == ["casino", "win"]
    assert {got[100 + i].verdict for i in range(60)} == {"allow"}
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_weak_labels_see_joined_words_and_leave_everyday_words(spark):
    text = "<p>best casino win quiet river family farm</p>"
    hosts = [f"river{i % 20}.example.org" for i in range(60)] + ["bestcasinowin.example.com"] * 40
    hosts += ["casino-win.example.org"] * 2 + ["family-farm.example.com"] * 3
    rows = [(i, f"http://{h}/en/{i}", text) for i, h in enumerate(hosts)]
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    blocked = {r.host for r in got if r.verdict == "block"}
    assert blocked == {"bestcasinowin.example.com", "casino-win.example.org"}
    # Without a host that has the words set apart, the joined ones are learned from all the same.
    rows = [r for r in rows if "casino-win" not in r[1]]
    got = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.host for r in got if r.verdict == "block"} == {"bestcasinowin.example.com"}


def _paragraphs(first, count):
    return "".join(f"<p>Paragraph {first + i} with quite a few words in it, enough to count as text.</p>" for i in range(count))


def test_text_beside_article_teasers():
    cards = "".join(f"<article><h3><a href=x>Teaser {i}</a></h3><p>Some <a href=y>more</a></p></article>" for i in range(3))
    lines = main_text(f"<html><body><div id=story>{_paragraphs(0, 8)}</div>{cards}</body></html>").split("\n")
    assert [x.split(" with")[0] for x in lines if x.startswith("Paragraph")] == [f"Paragraph {i}" for i in range(8)]


def test_sibling_articles_are_kept():
    parts = "".join(f"<article><h2>Part {k}</h2>{_paragraphs(10 * k, 4 - k)}<p>So.</p></article>" for k in range(3))
    lines = main_text(f"<html><body><div class=top><a href=1>One</a></div><div id=live>{parts}</div></body></html>").split("\n")
    assert [x.split(" with")[0] for x in lines] == [
        *("Part 0", *(f"Paragraph {i}" for i in range(4)), "So."),
        *("Part 1", *(f"Paragraph {i}" for i in range(10, 13)), "So."),
        *("Part 2", "Paragraph 20", "Paragraph 21", "So."),
    ]


def test_forms_around_a_page():
    """A form that wraps the article or most of the page is no form of the page; comments end at --!>, too."""
    from skein.llm.htmltext import main_text

    body = "".join(f"<p>Paragraph {i} of the article, with enough words to count as text.</p>" for i in range(6))
    small = "<form><input><label>Your mail address</label></form>"
    want = [f"Paragraph {i} of the article, with enough words to count as text." for i in range(6)]
    for page in (
        f"<body><form action='/'><div>{body}</div></form></body>",
        f"<body><form><nav><a href='/'>Home</a></nav><article>{body}</article>{small}</form></body>",
        f"<body><!-- note --!><article>{body}</article>{small}</body>",
    ):
        assert main_text(page).split("\n") == want, page
