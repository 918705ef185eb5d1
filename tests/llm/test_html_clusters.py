"""Clusters decide, nesting costs no more than its length, and lines of the text stay."""

import math
import time

import numpy as np
import pytest

from ledgerlake.llm import html_extract

LINE = ("A sentence of the article that has words enough to be read as content. " * 4).strip()
MENU = "".join(f"<div><a href='/{k}'>entry {k}</a></div>" for k in range(12))


def _soup(n=6):
    return f"<body><div><div>{MENU}</div><div><p>short note</p><p>more</p></div><div><h2>Title</h2>{f'<p>{LINE}</p>' * n}</div><div>{MENU}</div></div></body>"


ARTICLE = f"<body><header>Site</header><article><h1>Title</h1>{f'<p>{LINE}</p>' * 30}</article><div><p>other words</p></div></body>"
WANT = "\n".join(["Title", *[LINE] * 30])


@pytest.mark.parametrize("page", [_soup(30), ARTICLE])
def test_clusters_choose_the_lines(page, monkeypatch):
    """With an article and without one: the whole output, and another one from lines picked at random or from none smoothed away."""
    assert html_extract.extract(page) == WANT
    for seed in range(8):
        rng = np.random.default_rng(seed)
        monkeypatch.setattr(html_extract, "clusters", lambda r, rng=rng: rng.random(len(r)) < 0.3)
        assert html_extract.extract(page) != WANT
        monkeypatch.undo()


def test_which_lines_are_in_clusters():
    """Against a plain search for the threshold: all cuts of the smoothed logarithms are tried."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        ratios = np.where(rng.random(n) < 0.5, rng.integers(0, 9, n), rng.integers(50, 300, n)).astype(float)
        weight = lambda i, j: math.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 2 else 0.0
        s = [math.log1p(sum(weight(i, j) * ratios[j] for j in range(n)) / sum(weight(i, j) for j in range(n))) for i in range(n)]
        best = (0.0, None)
        for cut in sorted(set(s))[1:]:
            low, high = [x for x in s if x < cut], [x for x in s if x >= cut]
            apart = sum(high) / len(high) - sum(low) / len(low)
            best = max(best, (len(low) * len(high) * apart**2, cut, apart), key=lambda b: b[0])
        r = sorted((math.expm1(x) for x in s), reverse=True)
        half = next(x for k, x in enumerate(r) if 2 * sum(r[: k + 1]) >= sum(r) - 1e-9)
        want = [best[1] is None or best[2] < math.log(4) or x >= min(best[1], math.log1p(half / 4)) for x in s]
        assert html_extract.clusters(ratios).tolist() == want


def test_cards_beside_an_article(monkeypatch):
    cards = "".join(f"<article><a href=x>Other story {k}</a><p>read more</p></article>" for k in range(8))
    page = f"<body><div>{cards}</div><article><h1>T</h1>{f'<p>{LINE}</p>' * 6}</article></body>"
    assert html_extract.extract(page) == "\n".join(["T", *[LINE] * 6])
    monkeypatch.setattr(html_extract, "clusters", lambda r: np.ones(len(r), bool))
    assert html_extract.extract(page) != "\n".join(["T", *[LINE] * 6])


def test_what_stands_around_an_article_is_left_out():
    around = "<div>The Daily Page</div><p>You are reading as a guest. 3 articles left.</p>{}<p>Copyright 2024 The Daily Page. All rights reserved.</p>"
    story = f"<article><h1>Title</h1><p>{LINE}</p><p>short</p><p>{LINE}</p></article>"
    want = ["Title", LINE, "short", LINE]
    assert html_extract.extract(f"<body>{around.format(story)}</body>") == "\n".join(want)
    assert html_extract.extract(f"<body><div>{around.format(story)}</div></body>") == "\n".join(want)
    assert html_extract.extract(f"<body>{story}<div>Most read today in town</div>{story}</body>") == "\n".join(want * 2)
    assert html_extract.extract(f"<body><main>{story}<p>Most read today in town</p>{story}</main></body>") == "\n".join(want * 2)
    columns = f"<div><div><h1>Title</h1><p>{LINE}</p><p>short</p><p>{LINE}</p></div><div><p>Win a car today with our lottery.</p></div></div>"
    assert html_extract.extract(f"<body>{columns}</body>") == "\n".join(want)
    plain = story.replace("article>", "div>")
    assert html_extract.extract(f"<body>{around.format(plain)}</body>") == "\n".join(want)


def test_an_article_keeps_text_that_is_called_like_boilerplate():
    page = f"<article><h1>Review</h1><p>{LINE}</p><div class='menu'><p>{LINE}</p></div><p class='side'>{LINE}</p><p class='promotion'>Promoted in May.</p><p>{LINE}</p><div class='ad'>Buy now</div><ul class='menu'>{'<li><a href=x>entry</a></li>' * 9}</ul></article>"
    got = html_extract.extract(f"<body>{page}<div class='menu'><p>{LINE}</p></div></body>").split("\n")
    assert got[:6] == ["Review", LINE, LINE, LINE, "Promoted in May.", LINE] and "Buy now" not in got and len([x for x in got if x == LINE]) == 4


def _random_page(rng):
    """A page of known text: paragraphs long and short in an article, a main or a div, among menus, adverts, notices, comments and teasers."""
    words = lambda low, high: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(low, high)))
    title, body = words(2, 6), [words(30, 90) if rng.random() < 0.8 else words(2, 6) for _ in range(rng.integers(4, 14))]
    if max(len(x.split()) for x in body) < 30:
        body.append(words(40, 60))
    parts = []
    for x in body:
        parts.append(f"<p>{x}</p>")
        if rng.random() < 0.15:
            parts.append(f"<div class='{rng.choice(['ad', 'newsletter', 'share-buttons', 'related-posts'])}'>{words(2, 5)}</div>")
        if rng.random() < 0.1:
            parts.append(f"<script>{words(3, 9)}</script>")
    menu = lambda: f"<{'nav' if rng.random() < 0.5 else 'div'}>" + "".join(f"<li><a href=x>{words(1, 4)}</a></li>" for _ in range(rng.integers(3, 12))) + "</nav></div>"
    beside = lambda: rng.choice([menu(), f"<div class=sidebar><p>{words(3, 30)}</p></div>", f"<footer>{words(2, 9)}</footer>", f"<form>{words(2, 5)}<input></form>", f"<aside>{words(5, 30)}</aside>", f"<div id=comments>{f'<p>{words(20, 50)}</p>' * 3}</div>"])
    open_, close = [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class=page><div>", "</div></div>")][rng.integers(4)]
    before, after = ("".join(beside() for _ in range(rng.integers(0, 4))) for _ in range(2))
    return f"<html><head><title>x</title></head><body>{before}{open_}<h1>{title}</h1>{''.join(parts)}{close}{after}</body></html>", "\n".join([title, *body])


def test_random_pages_of_known_text():
    rng = np.random.default_rng(8)
    wrong = [(page, want, got) for page, want in (_random_page(rng) for _ in range(400)) if (got := html_extract.extract(page)) != want]
    assert not wrong, (len(wrong), wrong[0])


def test_a_linked_paragraph_between_others_stays():
    page = f"<body><div>{MENU}</div><div><p>{LINE}</p><p>{LINE}</p><p><a href=x>See the full report in our archive</a></p><p>{LINE}</p><p>{LINE}</p></div><div>{MENU}</div></body>"
    assert html_extract.extract(page) == "\n".join([LINE, LINE, "See the full report in our archive", LINE, LINE])
    page = f"<body><article><p>{LINE}</p><p><a href=x>See the full report in our archive</a></p></article></body>"
    assert html_extract.extract(page) == f"{LINE}\nSee the full report in our archive"


def test_header_of_an_article_and_words_of_classes():
    page = f"<body><header><p>Site</p></header><article><header><h1>Title</h1></header><p class='share-price'>{LINE}</p><div class='cookie-recipe'><p>{LINE}</p></div><footer>tags</footer></article></body>"
    assert html_extract.extract(page) == "\n".join(["Title", LINE, LINE])


@pytest.mark.parametrize("tag", ["div", "b", "p", "li", "a", "table", "section class=ad"])
def test_open_elements_cost_no_more_than_their_length(tag):
    def seconds(n):
        began = time.process_time()
        out = html_extract.extract(f"<body>{f'<{tag}>word ' * n}{'</i></p>' * n}")
        return time.process_time() - began, out

    seconds(100)
    assert seconds(20_000)[0] < 4
    assert "class" in tag or seconds(50)[1].replace("\n", " ").count("word") in (0, 50)


def test_a_tag_that_is_never_closed_at_the_end():
    assert html_extract.extract("<p>one<p>two<b>three</p>four") == "one\ntwothree\nfour"


def test_what_never_ends_is_dropped_and_costs_linear_time():
    for html, text in (
        ("<article><p>text <a href='x", "text"),
        ("<article><p>a <!-- b <p>c</p>", "a"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>1 < 2", "1 < 2"),
        ("<p>a &amp; b &lt", "a & b <"),
        ("<article><![foo[ x ]]> y</article>", "y"),
        ("<!--[if !IE]><!--> <p>in</p> <!--<![endif]--><p>out</p>", "in\nout"),
        ("<p>x<!--> y</p><p>z</p>", "x y\nz"),
        ("<p>x</p><!DOCTYPE", "x"),
        ("<script>x", ""),
    ):
        assert html_extract.extract(html) == text
    began = time.perf_counter()
    for part in ("<a <", "<!--", '<a x="', "</a <", "<![CDATA[", "<!x", "<?"):
        for end in ("", ">"):
            html_extract.extract(part * 50_000 + end)
    assert time.perf_counter() - began < 30


def test_numbered_marks():
    page = "<article><p>{0}</p><div class='ad_3'>Buy</div><li id='comment-12'>Me: {0}</li><p>End.</p></article>".format("A sentence of the article. " * 5)
    assert html_extract.extract(page).split("\n") == [("A sentence of the article. " * 5).strip(), "End."]
