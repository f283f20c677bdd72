"""Main text of constructed pages whose article is known, odd markup in linear time, and names of comments."""

import random
import time

import pytest

from factspark.llm import html_extract

OUTSIDE = [
    "<nav><ul><li><a href=/>{}</a></ul></nav>", "<header>{}</header>", "<footer>{}</footer>", "<aside>{}</aside>", '<div class="sidebar"><p>{}</p></div>', '<div class="cookie-notice">{}</div>',
    '<div class="ad-slot-2">{}</div>', "<form><label>{}</label><input></form>", "<script>var a = '<p>{}</p>';</script>", "<style>.a {{ content: '{}' }}</style>", '<section id="readercomments"><p>{}</p></section>',
    '<div class="user-comments"><p>{}</p></div>', '<div class="post__comments-list"><p>{}</p></div>', "<!-- {} -->", '<div role="navigation">{}</div>', "<div hidden>{}</div>",
]


def constructed(rng):
    """(page, its article's text): blocks of an article with inline markup and references, other parts between and around them."""

    def words(n):
        return [rng.choice(["alpha", "beta", "gamma", "delta", "R&D", "x<y", "caf\u00e9", "12"]) for _ in range(n)]

    def marked(text):
        out = [w.replace("&", "&amp;").replace("<", "&lt;").replace("\u00e9", "&eacute;") for w in text]
        if rng.random() < 0.4:
            i = rng.randrange(len(out))
            out[i] = rng.choice(["<b>{}</b>", "<a href='x'>{}</a>", "<em class=k>{}</em>"]).format(out[i])
        return rng.choice([" ", "\n  ", " \t"]).join(out)

    def other():
        return rng.choice(OUTSIDE).format(" ".join(rng.choices(["menu", "login", "buy"], k=rng.randint(1, 4))))

    inner, want = [], []
    for _ in range(rng.randint(4, 9)):
        text = words(rng.randint(12, 40))
        want.append(" ".join(text))
        inner.append(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>"]).format(marked(text)))
        if rng.random() < 0.3:
            inner.append(other())
    body = [other() for _ in range(rng.randint(0, 4))] + [rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>']).format("".join(inner))] + [other() for _ in range(rng.randint(0, 4))]
    return f"<html><head><title>Not this</title></head><body>{''.join(body)}</body></html>", " ".join(want)


@pytest.mark.parametrize("seed", range(200))
def test_constructed_pages(seed):
    page, want = constructed(random.Random(seed))
    assert html_extract.extract(page) == want
    tree = html_extract.parse(page)
    assert html_extract.extract(page, html_extract.path(tree, html_extract.best(tree))) == want


TEXT = "A sentence of the article that is long enough to be its text. " * 5


@pytest.mark.parametrize("name", ["user-comments", "readercomments", "post__comments-list", "disqusComments", "usercomment"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_comments_by_name(name, kind):
    assert html_extract.extract(f'<body><article><p>{TEXT}</p></article><div {kind}="{name}"><p>Nice post, thanks a lot!</p></div></body>') == TEXT.strip()
    assert html_extract.extract(f'<article><p>{TEXT}</p><div {kind}="{name}"><p>Nice post, thanks a lot!</p></div></article>') == TEXT.strip()


@pytest.mark.parametrize("name", ["comments-open", "nocomments", "no-comments", "has-comments", "commentary"])
def test_names_that_tell_no_comments(name):
    assert html_extract.extract(f'<body><div class="{name}"><p>{TEXT}</p></div></body>') == TEXT.strip()


def test_the_header_of_an_article_is_left_out():
    assert html_extract.extract(f"<article><header><h1>Title</h1></header><p>{TEXT}</p></article>") == TEXT.strip()


@pytest.mark.parametrize("page", [
    "<div>" * 4000 + "x" + "</div>" * 4000, "<ul><li><ul>" + "<b>" * 8000 + "<li></li>" * 8000, "<p>" * 20000, "<table><tr>" + "<i>" * 8000 + "<td>x</td>" * 8000, "</b>" * 20000, "<b>" * 8000 + "</i>" * 8000,
])
def test_odd_markup_takes_linear_time(page):
    start = time.perf_counter()
    html_extract.extract(page, ">".join(["div"] * 3999))
    assert time.perf_counter() - start < 1
