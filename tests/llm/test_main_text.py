import time

import pytest

from taxaloom.llm import main_text as M

ARTICLE = "<h1>A &amp; B</h1><p>First   <b>bold</b>\n text.<br>more<p>Second &eacute; &#x41; one.</p><ul><li>item <a href=x>one</a> of it</li></ul>"
WANT = "A & B First bold text. more Second é A one. item one of it"
AROUND = (
    '<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a> header</header><nav><ul><li><a href=/a>a</a></li></ul></nav><script>var t="</p><p>no</p>";</script><!-- x <p>no -->'
    '<div class="cookie-notice">We use cookies on this site.</div><div class="ad-slot">Buy now.</div>%s<aside>Side text here.</aside><form>Name <input> <button>Go</button></form>'
    '<div id="comments"><p>Great article, I liked it very much indeed!</p></div><footer>&copy; us</footer></body></html>'
)


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<main class="x1">%s</main>', '<div class="wrap"><div class="post-content c12">%s</div></div>', '<div id="page"><div class="row">%s</div></div>', '<section><article class="a">%s</article></section>'])
def test_layouts(wrap):
    assert M.Page(AROUND % (wrap % ARTICLE)).text_at(None) == WANT


def test_host_consensus(spark):
    long, short = "This is a long sentence of an article, with many words. " * 10, "Short."
    teaser = "A very long teaser that tells of something else, with many words. " * 3
    page = lambda t, n: f'<body><div class="story s{n}"><p>{t}</p></div><div class="extra"><p>{teaser}</p></div></body>'
    rows = [(i, f"http://Host.example/{i}", page(long, i)) for i in range(8)] + [(8, "http://host.example:80/x", page(short, 8)), (9, "http://host.example/none", "<p>No containers</p>"), (10, None, page(short, 1)), (None, "x", None), (11, "http://host.example/", ""), (11, "http://host.example/", "")]
    table = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in M.extract(table).collect()}
    assert got[0] == " ".join(long.split())
    assert got[8] == short
    assert got[9] == "No containers"
    assert got[10] == " ".join(teaser.split())
    assert got[None] == got[11] == ""
    assert M.extract(table).count() == len(rows)
    assert M.extract(table.limit(0)).count() == 0


def test_broken_markup():
    assert M.Page("<body><article><p>a < b & c &lt;d <b>e<p>f</div></article>g</body>").text_at(None) == "a < b & c <d e f"
    assert M.Page("<!-- open").blocks == []
    assert M.Page("<article>" + "<div>" * 3000 + "x" + "</div>" * 3000).text_at(None) == "x"
    assert M.Page("plain text only").text_at(None) == "plain text only"
    assert M.Page("<article><p>x" + " y" * 100_000).text_at(None) == "x" + " y" * 100_000


@pytest.mark.parametrize("classes", ["content has-sidebar", "post-content comments-open", "entry side-padding", "page search-enabled", "article-body share", "[&>p]:mt-4", "topStory"])
def test_an_article_is_not_lost_to_a_word_of_its_classes(spark, classes):
    page = f'<body><div class="{classes}">{ARTICLE}<div class="share-buttons">Share this</div></div><div class="related-posts">Other posts to read.</div><ol class="commentlist"><li>{"A reader says a lot about it. " * 9}</li></ol></body>'
    assert M.Page(page).text_at(None) == WANT
    rows = spark.createDataFrame([(i, "http://h.example/", page) for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in M.extract(rows).collect()] == [WANT] * 3


def test_work_is_linear():
    began = time.time()
    page = M.Page('<div class="x">' * 10_000 + "text" + "</ul>" * 10_000 + "<td>" * 1000 + "</div>" * 1000)
    assert page.text_at(next(iter(page.scores()))) == "text"
    assert time.time() - began < 5


LONG = "This sentence belongs to the article and tells of something at some length. " * 8
TALK = "I am a reader and I think something else about it, at great length as readers do. " * 6


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "story-comments", "discussion", "comments-area", "comment-list", "author-bio", "email-signup", "dfp-ad", "paywall-notice", "most-read", "mostPopular", "responses", "you-may-also-like", "trending-stories", "newsletter-signup-form"])
@pytest.mark.parametrize("tag", ["div", "section", "ul"])
def test_what_stands_around_an_article(name, tag):
    inner = f"<li>{TALK}</li>" if tag == "ul" else f"<p>{TALK}</p>"
    for page in (f'<body><article><h1>Title</h1><p>{LONG}</p><{tag} class="{name}">{inner}</{tag}></article></body>', f'<body><div class="post-body"><h1>Title</h1><p>{LONG}</p></div><{tag} id="{name}">{inner}</{tag}></body>'):
        assert M.Page(page).text_at(None) == "Title " + LONG.strip(), page


@pytest.mark.parametrize("element", ['<p class="ad-slot">Buy it now!</p>', '<p class="cookie-notice">We use cookies.<p>', '<li class="sponsored">Buy <b>this</b></li>', '<blockquote class="newsletter">Sign <p>up</p></blockquote>', '<h3 class="related">More of it</h3>', '<figure class="advert"><figcaption>Buy</figcaption></figure>', '<p hidden>secret</p>', '<p style="display: none">x</p>', '<p role="alert">look</p>'])
def test_boilerplate_in_any_element(element):
    page = f'<body><article><h1>Title</h1><p>{LONG}</p>{element}<p class="lead has-ads">And it ends.</p></article></body>'
    assert M.Page(page).text_at(None) == f"Title {LONG.strip()} And it ends."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><header class="site-header">The Site</header><div class="post"><header class="article-header"><h1>Title</h1></header><div class="post-body"><p>{LONG}</p></div></div></body>',
        f'<body><header>The Site</header><div class="entry"><header><h1>Title</h1></header><div class="text"><p>{LONG}</p></div></div><footer>x</footer></body>',
        f'<body><header>The Site</header><main><header><h1>Title</h1></header><section class="body"><p>{LONG}</p></section></main></body>',
        f'<body><header role="banner">The Site</header><article><header><h1>Title</h1></header><p>{LONG}</p></article></body>',
    ],
)
def test_an_articles_own_header(page):
    assert M.Page(page).text_at(None) == "Title " + LONG.strip()


def test_lists_in_an_article_stay():
    page = f'<body><article><p>{LONG}</p><ul><li>one<li class="ad">no<li>two</ul><ol><li>three</li><li class="promo">no<ul><li>no</li></ul></li><li>four</li></ol></article></body>'
    assert M.Page(page).text_at(None) == f"{LONG.strip()} one two three four"
