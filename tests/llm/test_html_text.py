"""Kinds of pages made by hand: what is an article's stays, what stands around it goes."""

import pytest

from lodemap.llm.html_text import main_text

TEXT = "A sentence of the article, with a comma, that is long enough to be one. " * 5
BODY = f"<p>{TEXT}one</p><p>{TEXT}two</p>"
WANT = f"{TEXT}one\n\n{TEXT}two"
AROUND = {
    "comments": '<ol class="commentlist"><li><p>I like it, a lot, and so on</p></li></ol>',
    "comments by camel case": '<div class="readerComments"><p>I like it, a lot, and so on</p></div>',
    "thread": '<section id="disqus_thread"><p>I like it, a lot, and so on</p></section>',
    "advert": '<div class="adBox"><p>Buy this, buy that</p></div>',
    "notice": '<div class="cookieNotice"><p>We use cookies, many of them</p></div>',
    "side menu": '<div class="sideMenu"><ul><li><a href="a">A</a></li></ul></div>',
    "form": "<form><p>Name, address</p><input></form>",
    "script": "<script>var a = 1;</script><style>p {}</style>",
    "navigation": '<nav><a href="/">Home</a></nav>',
    "share": '<div class="post-share">Share, tweet</div>',
}


@pytest.mark.parametrize("wrapper", ["<article>{}</article>", '<div class="post">{}</div>', "<main>{}</main>", '<div id="content" class="layout has-sidebar">{}</div>', '<div class="mainContent withAds">{}</div>'])
@pytest.mark.parametrize("around", AROUND)
def test_surroundings_go(wrapper, around):
    for page in (AROUND[around] + wrapper.format(BODY), wrapper.format(BODY) + AROUND[around], wrapper.format(BODY + AROUND[around])):
        assert main_text(f"<html><body>{page}</body></html>") == WANT


def test_title_before_the_container_stays_unless_it_has_its_own():
    assert main_text(f'<body><div><h1>Title</h1><div class="post">{BODY}</div></div></body>') == f"Title\n\n{WANT}"
    assert main_text(f"<body><h1>Site</h1><article><h1>Title</h1>{BODY}</article></body>") == f"Title\n\n{WANT}"


@pytest.mark.parametrize("name", ["download", "shadow", "readership", "adventure", "headerless", "Navigator", "commentary"])
def test_words_within_words_are_no_surroundings(name):
    assert main_text(f'<div class="{name}">{BODY}</div>') == WANT
