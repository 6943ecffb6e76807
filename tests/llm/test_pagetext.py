import random
from xml.etree import ElementTree

from hammerline.llm import pagetext

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="home"><header class="top"><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work, please accept them all now.</div>
<article class="post"><header><h1>Head &amp; line</h1></header><p>First <b>bold\n\tpart</b><br>of a
paragraph&nbsp;with &#8212; marks<p>Second, unclosed.<div class="ad">Buy our many fine things right here, they are cheap and good for you.</div>
<p>The.</p><form><label>Mail</label><input><button>Send it</button></form>
<section id="comments"><h2>Comments</h2><p>I think this is a very long reader comment about the article above it.</p></section></article>
<aside>Related words that go on for some time, to look like a text of the page.</aside>
<footer>&copy; us &middot; A closing line of the page that nobody reads.</footer></body></html>"""


def test_article_without_what_is_around_it():
    tree = pagetext.trained_tree()
    assert pagetext.main_text(PAGE, tree) == "Head & line\n\nFirst bold part of a paragraph with — marks\n\nSecond, unclosed.\n\nThe."


def test_pages_without_an_article_element():
    tree = pagetext.trained_tree()
    words = "some words of the text that make a paragraph long enough to read as one " * 2
    page = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div>{words}</div><div>{words}</div><div class=sidebar>{words}</div><a href=3>Next</a>"
    assert pagetext.main_text(page, tree) == f"{words.strip()}\n\n{words.strip()}"


def test_odd_rows(spark):
    long = "<article>" + "<p>word " * 20_000
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "plain words without any markup at all, just a line", "x"), (2, "v", "<<a b <p", "x"), (3, "w", "<div>" * 30_000, "x"), (4, "w", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in pagetext.extract(df).collect()), key=str)
    assert len(got) == 6 and got[-1][2] == "plain words without any markup at all, just a line"
    assert {t for k, _, t in got if k == 1} == {""}
    assert next(t for k, _, t in got if k == 4) == "\n\n".join(["word"] * 20_000)
    assert pagetext.extract(df.limit(0)).count() == 0


def test_tree_separates_its_table():
    import numpy as np

    table = np.array(pagetext.LABELLED, dtype=float)
    right = [pagetext.is_main(pagetext.trained_tree(), list(r[:-1])) == bool(r[-1]) for r in table]
    assert sum(right) >= 0.97 * len(table)


def test_malformed_pages_are_read_as_far_as_they_go(spark):
    rng = random.Random(6)
    bits = ["<", ">", "<!", "<![", "<![foo[ x ]]>", "<![CDATA[ y ]]>", "<!--", "-->", "<?", "?>", "</", "/>", "<p", "<p>", "</p>", "<div class=", '"', "'", "=", "&", "&#", "&#x110000;",
            "&amp", "word ", "<article>", "</article>", "<script>", "</script>", "<title>", "<head>", "<svg", "\x00", "é", "]]>", "<a href=x>", "<textarea>", "<br/>", "<!DOCTYPE", "[", "]"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    tree = pagetext.trained_tree()
    assert all(isinstance(pagetext.main_text(p, tree), str) for p in pages)
    rows = [(k, "u", p, "t") for k, p in enumerate(["<![foo[ x ]]>", "<![ x", *pages[:50]])]
    assert pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).filter("text is null").count() == 0


def test_names_inside_an_article_and_an_unclosed_head():
    tree, words = pagetext.trained_tree(), "some words of the article that go on for a while and tell a story to its end"
    page = f'<html><head><title>t</title><body><article><p>{words}</p><p class="share-price">{words} again</p><div class="share">share this</div></article></body></html>'
    assert pagetext.main_text(page, tree) == f"{words}\n\n{words} again"


def _text(html):
    return [b.text() for b in pagetext.flat_blocks(html) if not b.aside]


def test_names_of_any_element_count_as_whole_words():
    gone = ['<p class="advert">x</p>', '<figure class="ad">x</figure>', '<blockquote class="promo">x</blockquote>', '<p class="comment">x</p>', '<span class="ad">x</span>', '<div id="cookie-notice">x</div>', '<div class="y ad_slot_2">x</div>']
    stays = ['<div class="social-history">x</div>', '<div class="form-of-words">x</div>', '<div class="header-image">x</div>', '<p class="lead">x</p>', '<div class="adder">x</div>']
    assert [_text(f"<article>{h}</article>") for h in gone] == [[]] * len(gone)
    assert [_text(f"<article>{h}</article>") for h in stays] == [["x"]] * len(stays)


def test_malformed_pages_take_linear_time():
    import time

    for html in ('<a b="' * 170_000, "<p>a</p>" + '<a b="' * 170_000, "<span>" * 40_000 + "<hr>" * 40_000):
        start = time.process_time()
        pagetext.flat_blocks(html)
        assert time.process_time() - start < 5


def test_neighbours_decide_where_no_article_is_marked():
    used = set()

    def walk(tree):
        if isinstance(tree, tuple):
            used.add(pagetext.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(pagetext.trained_tree())
    assert {"words_before", "links_before", "links_after"} & used and len(used & set(pagetext.FEATURES[2:6])) >= 2
    long = "a long paragraph of the text with many words in it " * 4
    link = '<p><a href="x">more of this</a></p>'
    page = f"<body>{link}<p>three word label</p>{link}<p>{long}</p><p>three word line</p><p>{long}</p></body>"
    assert pagetext.main_text(page, pagetext.trained_tree()).split("\n\n") == [long.strip(), "three word line", long.strip()]


def test_teasers_as_articles_are_not_the_text():
    teaser = '<article><h2><a href="x">another piece of news</a></h2><p>a few words that say what it is about</p></article>'
    long = "a long paragraph of the text with many words in it " * 4
    page = f'<body>{teaser * 3}<div class="box"><a href="y">all the news</a></div><div id="content"><p>{long}</p><p>{long}</p></div></body>'
    assert pagetext.main_text(page, pagetext.trained_tree()).split("\n\n") == [long.strip()] * 2


def _plain_main_text(html):
    """The text blocks of the one article of a well-formed page, read as XML; None where it has another form."""
    try:
        root = ElementTree.fromstring(html)
    except ElementTree.ParseError:
        return None
    found = []

    def walk(element, inside, aside):
        aside = aside or element.tag in pagetext.AROUND or any(pagetext.names_an_aside(element.get(k, "")) for k in ("class", "id") if element.tag != "article")
        inside = inside or element.tag == "article"
        if element.tag in ("p", "h1", "li", "nav", "footer", "td"):
            text = " ".join("".join(element.itertext()).split())
            if inside and not aside and text:
                found.append(text)
            return
        for child in element:
            walk(child, inside, aside)

    walk(root, False, False)
    return "\n\n".join(found)


def test_random_marked_pages_against_a_plain_reading():
    rng, words = random.Random(4), "one two three & four five".replace("&", "&amp;").split()
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 5, 30))))
    leaf = lambda: rng.choice(("<p>{}</p>", "<h1>{}</h1>", "<ul><li>{}</li><li>x</li></ul>", '<p class="{}">{}</p>', "<p>a <a>{}</a> b</p>", "<table><tr><td>{}</td></tr></table>", "<nav>{}</nav>"))

    def block(depth):
        form, name = leaf(), rng.choice(("ad", "comments", "social-history", "lead", "cookie-box"))
        one = form.format(name, say()) if form.count("{}") == 2 else form.format(say())
        return one if depth == 0 or rng.random() < 0.6 else f'<div class="{name}">' + "".join(block(depth - 1) for _ in range(rng.randint(0, 3))) + "</div>"

    tree = pagetext.trained_tree()
    for _ in range(300):
        html = "<body>" + "".join(block(2) for _ in range(3)) + "<article>" + "".join(block(3) for _ in range(4)) + "<p>end</p></article>" + block(1) + "</body>"
        assert pagetext.main_text(html, tree) == _plain_main_text(html), html
