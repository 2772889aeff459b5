import pytest
from pyspark.sql import functions as F

from stallwise.llm import html_text
from stallwise.llm.labelled_pages import pages


@pytest.fixture(scope="module")
def model():
    return html_text.fit(pages(300))


def text_of(found):
    return [b[0] for b in found]


def test_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><p>a  <b>b</b>&amp;c<br>d<p title="x > y">e
      <script>var x = "</p>";</script>f<ul><li>g<li>h</ul><!-- <p>no</p> -->i<div>j</div>&lt;k&gt;&eacute;&#8364;<p>l <b>m"""
    assert text_of(html_text.blocks(page)) == ["a b&c d", "e f", "g", "h", "i", "j", "<k>é€", "l m"]
    assert html_text.blocks("") == [] and text_of(html_text.blocks("plain < text")) == ["plain < text"]
    assert text_of(html_text.blocks("<P CLASS=X>a</P><p>b</div></p>c")) == ["a", "b", "c"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text_of(html_text.blocks(deep)) == ["x"]


def test_held_out_pages(model):
    right = total = 0
    for parts in pages(200, seed=77):
        found, labels = html_text._labelled(parts)
        right += sum(a == b for a, b in zip(labels, model.labels(found)))
        total += len(labels)
    assert right >= 0.99 * total


def test_viterbi_is_the_best_labelling(model):
    from itertools import product

    for parts in pages(40, seed=3):
        found = html_text.blocks("".join(p for p, _ in parts))[:9]
        rows = html_text.chain(found)
        gains = [sum(model.weights.get(f, 0.0) for f in row) for row in rows]

        def value(labels):
            return model.starts[labels[0]] + sum(g * y for g, y in zip(gains, labels)) + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(product((0, 1), repeat=len(found)), key=value)
        assert value(model.labels(found)) == pytest.approx(value(best))


def test_main_text(model):
    page = (
        '<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>'
        "<article><h1>The title</h1><p>First words of  the story,\n with more of them.</p><div class=ad>Buy this now</div><p>Second part.</p></article>"
        '<section id="comments"><p>I do not agree with this at all.</p></section><form><p>Search</p></form><footer>&copy; Some site</footer></body>'
    )
    assert model.text(page) == "The title\nFirst words of the story, with more of them.\nSecond part."


def test_awkward_rows(spark):
    long = "<article>" + "<p>word one two three four.</p>" * 5000
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", long), (3, "u", "<<<>>"), (3, "u", "<<<>>")], "page_id long, url string, html string")
    rows = rows.withColumns({"text": F.lit(5), "n_chars": F.lit("x")})
    found = html_text.report(rows, 200).collect()
    assert [(r["page_id"], r["n_chars"]) for r in found[:2]] == [(1, 0), (1, 0)] and len(found) == 5
    assert found[2]["text"].count("\n") == 4999 and found[2]["n_chars"] == len(found[2]["text"])
    assert html_text.report(rows.limit(0), 50).count() == 0


def test_omitted_tags_and_formulas(model):
    """Heads that nothing closes, and what stands inside paragraphs, are read."""
    story = "<article><h1>The title</h1><p>First words of the story, with more of them.</p><p>Second part.</p></article>"
    want = "The title\nFirst words of the story, with more of them.\nSecond part."
    head = "<html><head><title>T</title><meta charset=utf-8><style>p{}</style><template><p>no</p></template><script>1</script>"
    assert model.text(head + story) == model.text(head + "</head><body>" + story) == want
    assert text_of(html_text.blocks(head + "plain <b>text</b>")) == ["plain text"]
    assert text_of(html_text.blocks("<head>\n<link href=x>\n<img src=y>a<p>b")) == ["a", "b"]
    assert text_of(html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds")) == ["so x=1 holds"]
    for tag in ("object", "audio", "video", "canvas"):
        assert text_of(html_text.blocks(f"<p>a <{tag}>see <a href=f>the file</a></{tag}> b")) == ["a see the file b"]


def test_quotes_and_comments_as_html_has_them():
    """A quote opens a value right after the equals sign only; ``<!-->`` and ``<!--->`` are whole comments."""
    of = lambda page: text_of(html_text.blocks(page))
    assert of('<p class="a"">Hello one</p><p>two</p>') == ["Hello one", "two"]
    assert of("<p title=don't>Hello one</p><p>It's two</p><p>Three</p>") == ["Hello one", "It's two", "Three"]
    assert of("<!--><p>one</p><!---><p>two</p><!-- x --!><p>three</p><!-- <p>no</p> -->") == ["one", "two", "three"]
    assert of('<p title="a > b" class=x>one</p><p a=\'"\' b>two</p><p = ="3">three</p><p x=>four') == ["one", "two", "three", "four"]
    assert of('<p data-x="class=ad" id=a/b>one</p><a href=x/>two</a>') == ["one", "two"]
    assert html_text._names("div", ' data-class="ad" class="Big-box x" ID=top') == ("in:div", "named:big", "named:box", "named:x", "name:big-box", "name:x", "named:top", "name:top")


def flat(path):
    """Features of a path by its definition, from the whole list of open elements."""
    own = []
    while path:
        own.append(path)
        path = path.outer
    return own[::-1]


def test_path_features_by_definition():
    """Shared nodes give the features that a copy of all open elements gives."""
    import random

    tags = ["div", "p", "span", "em", "section", "li", "ul", "b", "article", "td"]
    for seed in range(150):
        dice = random.Random(seed)
        page = "".join(
            dice.choice([f'<{t} class="{dice.choice("abc")} {dice.choice("xy")}">w', f"</{t}>w", f"<{t}>w"])
            for t in dice.choices(tags, k=40)
        )
        for _, path, _ in html_text.blocks(page):
            elements = flat(path)
            if path is None:
                continue
            # What a node adds, put together again, is a set of features without repeats.
            every = [f for node in elements for f in node.fresh]
            assert len(every) == len(set(every))
            got = html_text.path_features(path)
            assert got[: len(every)] == every and len(got) == len(set(got))


def test_deep_nesting_is_linear(model):
    import time

    start = time.perf_counter()
    for page in (
        '<div class="a b c">x' * 50_000, "<p><div>" + "<b>" * 50_000 + "<h1>x</h1>" * 50_000, "<ul>" + "<i class=z>" * 30_000 + "<li>x</li>" * 30_000,
        "".join(f"<em class=c{i}>x" for i in range(30_000)), "<p>" + "</div>" * 50_000, "<" * 100_000, '<p title="' * 30_000,
    ):
        assert isinstance(model.text(page), str)
    assert time.perf_counter() - start < 60
