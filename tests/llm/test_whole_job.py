"""Cases in which a shorter way would lose rows, lines or links."""

import numpy as np
import pytest

from ledgerlake.llm import html_extract, piece_sampling, queries

TEXT = "A sentence of the article that has words enough to be read as content. " * 6


@pytest.mark.parametrize("attrs", ["class='no-sidebar'", "class='content-with-sidebar'", "class='has-footer'", "id='related-work'", "id='side-effects'", "class='social-history'", "class='informed-consent'", "class='sidebar'"])
def test_page_in_a_wrapper_with_a_word_of_boilerplate(attrs):
    page = f"<body><nav>menu</nav><div {attrs}><p>{TEXT}</p><p>{TEXT}</p></div><footer>f</footer></body>"
    assert html_extract.extract(page) == "\n".join([TEXT.strip()] * 2)


def test_ids_of_headings_and_sections_in_an_article():
    page = f"<body><article><h1>T</h1><p>{TEXT}</p><h2 id='related'>Related work</h2><p>{TEXT}</p><section id='comments'><h3>Remarks</h3><p>{TEXT}</p></section><div id='comments'><p>first!</p></div></article></body>"
    line = TEXT.strip()
    assert html_extract.extract(page) == "\n".join(["T", line, "Related work", line, "Remarks", line])


def test_long_comments_beside_an_article_are_dropped():
    page = f"<body><article><h1>T</h1><p>{TEXT}</p></article><div id=comments>{f'<p>{TEXT}</p>' * 9}</div></body>"
    assert html_extract.extract(page) == f"T\n{TEXT.strip()}"


@pytest.mark.parametrize("n", [1, 60])
def test_size_of_the_body_changes_no_line(n):
    line = TEXT.strip()
    body, want = f"<p>{TEXT}</p>" * n, [line] * n
    top = "<body><nav><a href=x>menu</a></nav>"
    assert html_extract.extract(f"{top}<div><h1>Title</h1><p>lead</p><script>x()</script><div class=body>{body}</div></div><footer>f</footer>") == "\n".join(["Title", "lead", *want])
    assert html_extract.extract(f"{top}<main><h1>Title</h1><article>{body}</article></main><footer>f</footer>") == "\n".join(["Title", *want])
    assert html_extract.extract(f"{top}<div><h1><a href=x>Title</a></h1><article>{body}</article></div><footer>f</footer>") == "\n".join(["Title", *want])
    assert html_extract.extract(f"{top}<div><p>before</p><blockquote>{body}</blockquote><p>after</p></div><footer>f</footer>") == "\n".join(["before", *want, "after"])


def test_linked_lines_of_an_article_stay():
    page = f"<body><ul><li><a href=x>menu</a></li></ul><article><h2><a href=x>Linked headline</a></h2><p>{TEXT}</p><ol><li><a href=y>A reference</a></li></ol></article></body>"
    assert html_extract.extract(page) == f"Linked headline\n{TEXT.strip()}\nA reference"
    page = f"<body><ul><li><a href=x>menu</a></li></ul><div><h2><a href=x>Linked headline</a></h2><p>{TEXT}</p></div></body>"
    assert html_extract.extract(page) == f"Linked headline\n{TEXT.strip()}"


def test_pieces_of_the_query_are_whole(spark):
    got = queries.op10_pieces(spark, "/root/testdata/sf0.001")
    pieces = piece_sampling.load_pieces()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) >= len(texts) and all(piece_sampling.decode(pieces, r.ids) == texts[r.doc_id] and len(r.ids) == r.n_pieces for r in rows)


def test_pieces_of_spaces_and_of_long_tokens():
    pieces = piece_sampling.load_pieces()
    sampler = piece_sampling.Sampler(pieces, 2)
    told = lambda t, seed: [f["ids"].tolist() for f in sampler.run([t], [seed])[0]]
    wide = {i for i in range(len(pieces.lengths)) if pieces.decode(np.array([i])).startswith(b"  ")}
    assert any(wide & set(ids) for s in range(200) for ids in told("        x = 1", s))
    # the lattice of a long token has the edges over its 48th character
    lattices = sampler.lattices
    long = "thea" * 30
    token = lattices.number(pieces.cut([long]))[0]
    cut = int(lattices.start[token]) + 48
    source = np.searchsorted(lattices.edges_of, np.arange(lattices.size), "right") - 1
    assert ((source < cut) & (source >= lattices.start[token]) & (lattices.target > cut)).any()
    kept = lattices.size
    lattices.forget()
    assert lattices.size < kept
    assert all(piece_sampling.decode(pieces, ids) == "漢字かな交じり文" * 40 for ids in told("漢字かな交じり文" * 40, 5))
    for t in (long, "a b  c   " + "z" * 5000 + "\n    y ", " " * 100):
        one, two = told(t, 5)
        assert one != two and all(piece_sampling.decode(pieces, ids) == t for ids in (one, two))
