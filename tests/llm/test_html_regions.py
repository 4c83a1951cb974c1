"""Pages whose main text was lost once: long lines, frames with skipped names, deep nesting."""

import time

import pytest

from seqloom.llm.html_text import main_text


def paragraph(words, k):
    return "<p>" + "word " * words + str(k) + "</p>"


def test_one_long_line_does_not_hide_the_other_sections():
    sections = "".join("<div>" + "".join(paragraph(1900 if (s, k) == (1, 2) else 20, k) for k in range(5)) + "</div>" for s in range(3))
    text = main_text(f"<html><body><div class=title>The title</div>{sections}</body></html>")
    assert text.startswith("The title\n") and text.count("\n") == 15


@pytest.mark.parametrize("frame", ['<div class="layout has-sidebar">%s</div>', '<div class="social-page"><article>%s</article></div>',
                                   "<form id=aspnetForm>%s</form>", '<div class="widget"><form><main>%s</main></form></div>'])
def test_a_frame_with_a_skipped_name_stays(frame):
    page = "<html><body><nav>menu</nav>" + frame % ("<h1>Head</h1>" + paragraph(50, 1) + '<div class="ad">buy now</div>') + "</body></html>"
    text = main_text(page)
    assert text.startswith("Head\nword") and "buy" not in text and "menu" not in text


def test_a_large_advert_or_comment_beside_a_short_article_goes():
    for name in ("ad", "comments", "sidebar", "related"):
        page = f'<body><div class="{name}">{paragraph(300, 1)}</div><article><h1>Short</h1><p>one two three</p></article></body>'
        assert main_text(page) == "Short\none two three"
    assert main_text(f'<body><div id="comments">{paragraph(300, 1)}</div><p>one two three</p></body>') == "one two three"
    assert main_text(f"<body><form>{paragraph(3, 1)}</form>{paragraph(60, 2)}</body>") == "word " * 60 + "2"


@pytest.mark.parametrize("page", [None, "", "<", "</div></p>", "<div>" * 50, "<p>a<p>b</div>", "<b><i>x</b></i>"])
def test_broken_pages(page):
    assert main_text(page) == {"<p>a<p>b</div>": "a\nb", "<b><i>x</b></i>": "x", "<": "<"}.get(page or "", "")


def test_time_grows_with_the_length():
    def seconds(n):
        start = time.perf_counter()
        assert main_text("<div>x </i>" * n + "</div>" * n).count("x") >= 1
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16000) < 40 * max(seconds(1000), 0.01)
