import html
import re
import time

import numpy as np
import pytest

from folioflux.llm import html_extraction as he
from folioflux.sources.tables import load

PARAGRAPHS = [
    "The harbour was rebuilt in three stages, and each of them took longer than the council had planned for.",
    "Work began on the northern quay, where the old wall had given way after two winters of heavy storms.",
    "Short one.",
    "In the end the costs rose by a third; most of it went into foundations that nobody had surveyed before.",
    "Ships returned in spring, and with them the fish market, the ferries and the noise that people had missed.",
]
TITLE = "A harbour rebuilt"
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
WANT = "\n".join([TITLE, *PARAGRAPHS])
MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "About")) + "</ul>"
COMMENT = "I lived beside that quay for twenty years and never saw a crew work as carelessly as this one did."

PAGES = {
    "article": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1>{BODY}</article><aside>{MENU}</aside><footer>All rights reserved by the harbour news company.</footer></body>",
    "main, furniture inside": f'<header><h1>Harbour News</h1></header><main><h1>{TITLE}</h1>{BODY}<aside><p>{COMMENT}</p></aside><form><label>Mail</label><input><button>Send</button></form><section class="comments"><p>{COMMENT}</p></section></main>',
    "article header": f"<article><header><h1>{TITLE}</h1></header>{BODY}<footer>Filed under: harbours</footer></article>",
    "div by id": f'<div id="header"><p>Harbour News, since 1901</p></div><div id="menu">{MENU}</div><div id="content"><h1>{TITLE}</h1>{BODY}</div><div id="sidebar"><p>{COMMENT}</p></div><div id="footer"><p>Imprint and terms of the company that prints this page for you</p></div>',
    "div by class": f'<body class="has-sidebar"><div class="site-header">Harbour News</div><div class="main-nav">{MENU}</div><div class="post-content"><h1>{TITLE}</h1>{BODY}</div><div class="cookie-notice"><p>We and our partners use cookies to make this page work as it should.</p></div><div class="commentList"><p>{COMMENT}</p></div>',
    "no names": f"<body><div>{MENU}</div><div><h1>{TITLE}</h1>{BODY}</div><div>{MENU}</div></body>",
    "flat": f"<body>{MENU}<h1>{TITLE}</h1>{BODY}{MENU}</body>",
    "comments as articles": f'<main><article class="post comments-open"><h1>{TITLE}</h1>{BODY}</article><ol class="comment-list"><li><article class="comment-body"><p>{COMMENT}</p></article></li></ol></main>',
    "nav never closed": f"<body><nav>{MENU}<article><h1>{TITLE}</h1>{BODY}</article>",
    "form around the page": f'<form id="aspnet"><div id="menu">{MENU}</div><article><h1>{TITLE}</h1>{BODY}</article></form>',
    "teasers": f'<article><h1>{TITLE}</h1>{BODY}</article><aside><article><h3><a href="/x">Other news</a></h3></article></aside><div class="related-posts"><p>{COMMENT}</p></div>',
    "adverts inside": f'<article><h1>{TITLE}</h1>{BODY.replace("Short one.</p>", "Short <span class=ad>buy <span>two</span> get one</span>one.</p><div class=advert><p>Buy now, the best offer of the year for all of you.</p></div><p class=promo>Subscribe to us today and save")}</article>',
    "hidden and mute": f"<article><h1>{TITLE}</h1><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style>{BODY}<noscript><p>Turn on scripts.</p></noscript><p hidden>hidden</p><div style='display: none'>gone</div><svg><title>icon</title></svg><!-- note --></article>",
    "broken off": f"<article><h1>{TITLE}</h1>{BODY}<!-- never close",
    "inside divs": f"<div><div><div><h1>{TITLE}</h1></div>{''.join(f'<div><div>{x}</div></div>' for x in PARAGRAPHS)}</div><div>{MENU}</div></div>",
    "named for its layout": f'<div class="content-sidebar-wrap"><main><h1>{TITLE}</h1>{BODY}</main><div class="sidebar-primary"><p>{COMMENT}</p></div></div>',
    "layout without main": f'<div id="sidebar-layout"><div class="entry"><h1>{TITLE}</h1>{BODY}</div><div class="sidebar-box"><p>{COMMENT}</p></div></div>',
    "capitals": f"<BODY><NAV>{MENU}</NAV><ARTICLE><H1>{TITLE}</H1>{BODY}</ARTICLE></BODY>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(name):
    assert he.extract(PAGES[name]).text == WANT


def test_lines():
    page = "<article><h1>A&nbsp;&amp;&#x42;\n\n c</h1><p>one<br>two <b>th</b>ree &amp;lt; &copy 5&hellip;<p>\t<ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2</tr><tr><th>3</th></tr></table><pre>a\n  b</pre><blockquote>q<div>r</div>s</blockquote></article>"
    assert he.extract(page).text.split("\n") == ["A &B c", "one two three &lt; \u00a9 5\u2026", "x", "y", "z", "1 2", "3", "a b", "q", "r", "s"]


@pytest.mark.parametrize("page", ["", " ", "<", "</", "<a", "<![foo[x]]>", "<!", "<!DOCTYPE [<!x>]>", "&#x110000;", "\x00<p>\x00", "</p></div></article>", "<script>", "<title>x", "<article><nav>", "<li>" * 50])
def test_broken_pages(page):
    he.extract(page)
    assert he.extract(f"<article><p>{PARAGRAPHS[0]}</p></article>{page}").text.startswith(PARAGRAPHS[0])


@pytest.mark.parametrize("part", ["<div>", "<article>", "<nav>", "</div>", "<li>", "<b class=ad>", "<a ", "<!--", "<![", "<p>x", "<div></p>", "<article><h1>x", "<form><li>"])
def test_work_grows_with_the_page(part):
    began = time.process_time()
    he.extract(part * 20_000)
    assert time.process_time() - began < 10


def test_smoothing_is_a_weighted_mean():
    ratio = np.array([4.0, 0, 0, 9, 1, 7, 2, 2, 0, 5])
    kernel = lambda d: np.exp(-(d**2) / (2 * he.SIGMA**2)) * (abs(d) <= he.REACH)
    want = [sum(kernel(i - j) * r for j, r in enumerate(ratio)) / sum(kernel(i - j) for j in range(len(ratio))) for i in range(len(ratio))]
    assert np.allclose(he.smoothed(ratio), want)
    assert np.allclose(he.smoothed(np.array([3.0])), [3.0])


def article_of(page):
    """The test tables' articles, by their own tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
    return "\n".join(x for x in lines if x)


def test_whole_table(spark, sf_dir):
    got = {r.page_id: r for r in he.op13_html_extraction(spark, sf_dir).collect()}
    pages = load(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, article_of(p.html), len(article_of(p.html)))


def test_nulls_repeats_names_and_empty_tables(spark):
    long = "<article>" + f"<p>{PARAGRAPHS[0]}</p>" * 30_000 + "</article>"
    rows = [(None, None, "t"), (1, "", "t"), (1, PAGES["article"], "t"), (1, PAGES["article"], "t"), (2, long, "t"), (3, "<nav>menu</nav>", "t")]
    pages = spark.createDataFrame(rows, "n_chars long, html string, text string")
    got = sorted(((r._row.n_chars or 0, r._row.text, r.text, r.n_chars) for r in he.extract_pages(pages).collect()), key=lambda x: (x[0], x[3]))
    want = "\n".join([PARAGRAPHS[0]] * 30_000)
    assert got == [(0, "t", "", 0), (1, "t", "", 0), (1, "t", WANT, len(WANT)), (1, "t", WANT, len(WANT)), (2, "t", want, len(want)), (3, "t", "", 0)]
    assert he.extract_pages(pages.limit(0)).collect() == []
