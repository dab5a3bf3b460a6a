"""Extraction: blocks, the chain's best labelling against all labellings, and pages of forms not trained on."""

import itertools

import numpy as np
from opslake.llm import extract as X
from opslake.llm.common import prepare

CHAIN = X.train(X.training_pages())
LONG = "Some words of a passage, which goes on for a while. It has more than one sentence."


def test_blocks():
    page = (
        "<!DOCTYPE html><head><title>no</title></head><script>var t='</p>'</script><style>p{}</style><!-- <p>no</p> -->"
        "<p>one <b>bold</b>\n two<br>three &amp; four&nbsp;five<p>next <a href='x>y'>link</a><ul><li>a<li>b</ul>tail < end"
    )
    assert [b.text for b in X.read_blocks(page)] == ["one bold two three & four five", "next link", "a", "b", "tail < end"]
    assert X.read_blocks("") == [] and X.read_blocks("<p>  <p>") == []
    assert [b.text for b in X.read_blocks("<p>cut off &am")] == ["cut off &am"]
    deep = X.read_blocks("<div class='x%d'>" * 3000 + "text" + "</div>" * 9, CHAIN.weights)
    assert [b.text for b in deep] == ["text"]


def test_heads_without_an_end():
    texts = lambda page: [b.text for b in X.read_blocks(page)]
    inside = "<meta charset=utf-8><title>a <b> c</title><!-- <p>no</p> --><link href='x'><script>'<p>no</p>'</script><noscript><img src=x><p>no</p></noscript><style>p{}</style>\n"
    for end in ("<body class=x>", "</head><body>", "<body>", "", "</head>"):
        assert texts(f"<html><head lang=en>{inside}{end}<p>one</p><header>two</header>") == ["one", "two"]
    assert texts(f"<head>{inside}text<p>one</p>") == ["text", "one"]
    assert texts("<head><div>one</div><title>no</title></head><body><p>two") == ["one", "two"]
    assert texts("<head><title>no</title>") == [] == texts("<head>") == texts("<head><title>no")


def test_drawings_and_formulas():
    texts = lambda page: [b.text for b in X.read_blocks(page)]
    for tag in ("svg", "math"):
        for own in (f"<{tag}/>", f"<{tag} class='a>b' />", f"<{tag} a=1><title>no</title><x/>no</{tag}>", f"<{tag.upper()}>no</{tag}>", f"<{tag}><x>no<!-- </{tag}><p> --></{tag}>"):
            assert texts(f"<article><p>one</p>{own}<p>two</p></article><{tag}>no</{tag}><p>three") == ["one", "two", "three"]
        assert texts(f"<div><{tag}><x>no</div><p>one</p><{tag}>no</{tag}>") == ["one"]
        assert texts(f"<p>one<{tag}-field>two</{tag}-field>three</p>") in (["one", "two", "three"], ["onetwothree"])
    assert texts("<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg><p>one") == ["one"]
    assert texts("<p>one</p><svg>no") == ["one"]


def test_viterbi_finds_the_best_labelling():
    make = np.random.default_rng(2)
    blocks = X.read_blocks("".join(f"<p>{'w ' * (i + 1)}</p><div class=ad>{i}</div>" for i in range(4)))
    for _ in range(20):
        weights = {f: tuple(make.normal(size=2)) for b in blocks for f in [*b.place, *X.text_features(b)]}
        chain = X.Chain(weights, make.normal(size=(2, 2)), make.normal(size=2))
        score = lambda path: chain.first[path[0]] + sum(chain.scores(b)[y] for b, y in zip(blocks, path, strict=True)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert chain.decode(blocks) == list(best)


def test_labelled_pages_are_learnt():
    wrong = [(a, b) for blocks, labels in X.training_pages() for a, b in zip(CHAIN.decode(blocks), labels, strict=True) if a != b]
    assert not wrong


def test_pages_of_other_forms():
    around = f"<nav><a>Home</a></nav><header><p>{LONG}</p></header><div class='cookie-notice'>{LONG}</div><aside><p>{LONG}</p></aside>"
    after = f"<div id=comments><p>{LONG}</p></div><form><p>{LONG}</p></form><footer><p>{LONG}</p></footer>"
    for body in ("<article><h1>T</h1><p>x</p><p>" + LONG + "</p></article>", "<main><h1>T</h1><p>x</p><p>" + LONG + "</p></main>", "<div class='post-content'><h1>T</h1><p>x</p><p>" + LONG + "</p></div>"):
        assert X.main_text(CHAIN, around + body + after) == f"T\nx\n{LONG}"


def test_extract(spark):
    prepare(spark)
    page = f"<nav><a>m</a></nav><article><h1>T</h1><p>{LONG}</p></article>"
    big = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, None), (2, "v", None, "x"), (3, "w", "", "x"), (4, "z", big, "x"), (5, "n", "<nav><a>m</a></nav>", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text) for r in X.extract(frame, CHAIN).collect()), key=str)
    main = f"T\n{LONG}"
    assert [g for g in got if g[0] != 4] == [(0, None, main), (1, "u", main), (1, "u", main), (2, "v", ""), (3, "w", ""), (5, "n", "")]
    assert next(g[2] for g in got if g[0] == 4) == "\n".join([LONG] * 20_000)
    assert X.extract(frame.limit(0), CHAIN).count() == 0
