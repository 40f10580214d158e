"""Broken or unusual markup takes no article text with it."""

import pytest

from phasemill.llm import html_blocks

P = [f"{k} is a paragraph of an article with quite some words in it, and it is read to its end." for k in ("This", "That", "Here", "There")]


def _page(inside="", attrs="", around="{}"):
    body = f"<p>{P[0]}</p>{inside}<p{attrs}>{P[1]}</p><div class='west-side'><p>{P[2]}</p></div><p>{P[3]}</p>"
    return f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav>{around.format(f'<article>{body}</article>')}<footer>foot</footer></body></html>"


@pytest.mark.parametrize("inside", ["", "<svg viewBox='0 0 1 1'/>", "<svg>", "<object data=x>", "<button>", "<button>Ok</button>", "<select><option>a</select>", "<svg><svg></svg><text>no</text></svg>", "<video/>", "<script>var a = 1 < 2 && '<p>';</script>", "<style>", "<iframe>", "<math>", "<!-- <p> -->", "<canvas>"])
def test_elements_without_an_end(inside):
    for after in ("", "<button>later</button>", "</object></button></svg>"):
        page = _page(inside).replace("<footer>", after + "<footer>")
        assert html_blocks.main_text(page) == "\n".join(P), (inside, after)


@pytest.mark.parametrize("attrs", [" title=it's", " title=\"it's\"", " title='say \"so\"'", " title=it\"s", " data-class=nav data-id='comments'", " title=a=b'c", " 'odd", " class"])
def test_attributes(attrs):
    assert html_blocks.main_text(_page(attrs=attrs)) == "\n".join(P)


@pytest.mark.parametrize("name", ["west-side", "tag-science", "popular-science", "legal", "form", "hidden-gem", "related-work", "header-story", "no-comments", "menus", "Searching"])
def test_class_words_inside_an_article(name):
    assert html_blocks.main_text(_page(attrs=f" class='{name}'")) == "\n".join(P)
    assert html_blocks.main_text(_page(attrs=f" id={name}")) == "\n".join(P)


@pytest.mark.parametrize("name", ["ad", "Ad-Slot big", "share-buttons", "related_posts", "comments", "newsletter", "cookie-banner"])
def test_furniture_inside_an_article(name):
    assert html_blocks.main_text(_page(f"<div class='{name}'><p>{P[0]} Not this.</p></div>")) == "\n".join(P)


@pytest.mark.parametrize("around", ["<div class='page has-sidebar'>{}</div>", "<div id='content' class='no-sidebar'>{}</div>", "<div class=sidebar>{}</div>", "<div class='site-header'>{}", "<div class='widget'><div id=legal>{}</div></div>"])
def test_wrappers_of_a_page(around):
    for page in (_page(around=around), _page(around=around).replace("article>", "div>")):
        assert html_blocks.main_text(page) == "\n".join(P)


def test_more_comments_than_text():
    comments = "".join(f"<li><p>{p} So I think.</p>" for p in P * 3)
    assert html_blocks.main_text(f"<div class=text><p>{P[0]}<p>{P[1]}</div><ul class='comment-list'>{comments}</ul>") == "\n".join(P[:2])


def test_a_very_long_page():
    body = "".join(f"<p>{P[k % 4]}" for k in range(20_000))
    assert html_blocks.main_text(f"<body><article>{body}</article>").count("\n") == 19_999
