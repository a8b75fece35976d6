"""Which blocks of a page are main text, and that hostile pages cost no more than their length."""

import time

import pytest
from paramill.llm import html_text
from paramill.llm.html_text import blocks_of


def main_text(page):
    rows = blocks_of(page)
    declared = any(main and not apart for _, _, main, apart in rows)
    return "\n".join(text for _, text, main, apart in rows if not apart and (main or not declared))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>x</p><button>Share</button><p>y</p></article>", "x\ny"),
        ("<article><p>x <button>Share</button> y</p></article>", "x y"),
        ("<article><p>one <span class='ad'>BUY</span> two<label>l</label> three<svg><text>s</text></svg></p>z</article>", "one two three\nz"),
        ("<article>a<canvas>c</canvas>b<span class=ad><div>BUY</div></span>c</article>", "abc"),
        ("<article>a <span class='ad'>BUY</article><p>after", "a"),
        *[(f"<main><p>in</p><div class='{n}'>no</div><p>too</p></main>", "in\ntoo") for n in
          "comment-list comments-area disqus_thread cookie-bar ad-container ad-slot-1 share-buttons user-comments footer-widgets shareButtons".split()],
        *[(f"<main><p>in</p><div id='{n}'>yes</div></main>", "in\nyes") for n in
          "social-science share-price ad-hoc no-sidebar comments-open menu-planning advent".split()],
        ('<div id="main-content" class="hero banner"><p>kept</p></div><div class="banner">not</div>', "kept"),
        ("<article><p>own</p></article><article class='related'>other</article><article class=teaser>t</article>", "own"),
        ("<article class='related'>alone</article>", "alone"),
        ("<main><p>a</p><p hidden>b</p><p style='color:red; display: none'>c</p><p aria-hidden='true'>d</p><p data-x='hidden'>e</p></main>", "a\ne"),
        ("<p>1 < 2 and 3 > 2</p><a title='x > y'>link</a>", "1 < 2 and 3 > 2\nlink"),
        ("<article><p title=\"it's\">q</p></article>", "q"),
        ("<p>kept</p><a href='never closed", "kept"),
        ("<p>a<!-- never closed <p>b", "a"),
        ("", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "<a" ', "<a b='", "<", "</p>", "<p", "<!--", "<div class=ad>", "<a =  ", "&amp", "<b>"])
def test_hostile_pages_are_linear(part):
    page = "<p>x</p>" + part * (1_000_000 // len(part))
    start = time.perf_counter()
    blocks_of(page)
    assert time.perf_counter() - start < 10


def test_stray_end_tags_under_many_open_elements():
    start = time.perf_counter()
    blocks_of("<b>" * 6000 + "</i>" * 200_000)
    assert time.perf_counter() - start < 5


def extracted(spark, rows):
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_passages_that_a_host_repeats_in_its_articles(spark, monkeypatch):
    """The suffix arrays decide inside declared regions too, over groups smaller than the host."""
    monkeypatch.setattr(html_text, "PAGES", 4)
    notice = " ".join(f"notice{i}" for i in range(30))
    own = {i: " ".join(f"own{i}x{j}" for j in range(20)) for i in range(120)}
    rows, want = [], {}

    def page(i, host, *blocks, kept):
        rows.append((i, f"http://{host}/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        want[i] = "\n".join(kept)

    for i in range(20):  # a notice on most pages, as a block, within a block, and a page without it
        blocks = [own[i]] if i == 7 else [f"{own[i]} {notice}"] if i == 8 else [own[i], notice]
        page(i, "most", *blocks, kept=[own[i]])
    page(20, "most", notice, kept=[notice])  # nothing else would stay
    for i in range(30, 50):  # on fewer than half of the pages
        page(i, "some", own[i], *[notice] * (i % 3 == 0), kept=[own[i], *[notice] * (i % 3 == 0)])
    for i in range(60, 64):  # few pages
        page(i, "few", own[i], notice, kept=[own[i], notice])
    for i in range(70, 90):  # copies of an article are one page, and article text that two others share stays
        page(i, "copies", own[70], notice, kept=[own[70], notice])
    for i in range(90, 96):
        page(i, "copies", own[i], *[own[99]] * (i < 92), kept=[own[i], *[own[99]] * (i < 92)])
    for i in range(100, 110):  # three blocks that most pages repeat
        page(i, "blocks", own[i], "share this", "print", "comment", kept=[own[i]])
    assert extracted(spark, rows) == want
