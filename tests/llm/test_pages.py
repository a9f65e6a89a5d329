from __future__ import annotations

import numpy as np
import pytest

from tallyguard.llm.pages import (
    HIDDEN,
    INPUT,
    Labeller,
    _Templates,
    block_vector,
    extract,
    leaf_blocks,
    train,
    training_page,
)

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad --><div class="ad">Buy now and
save.</div><article><h1>Bread &amp; butter</h1><p><b>First   line<br>goes on here, with many words to read.<p>Second &copy part of
the story, which is longer than the first.</p></article><section class="comments"><p>Great article!</p></section>
<footer>&copy; example.org &middot; imprint</footer>"""


@pytest.fixture(scope="module")
def labeller():
    return train()


def test_leaf_blocks_of_untidy_markup():
    texts = [b.text for b in leaf_blocks(PAGE)]
    assert texts == [
        "Home",
        "About",
        "Buy now and save.",
        "Bread & butter",
        "First line goes on here, with many words to read.",
        "Second © part of the story, which is longer than the first.",
        "Great article!",
        "© example.org · imprint",
    ]
    assert [b.path[-1] for b in leaf_blocks(PAGE)][2:5] == ["div class:ad", "h1", "p"]
    for html in (None, "", "<", "<p", "&", "<script>never closed", "</div></p>", "<a>" * 3000 + "x", "plain text"):
        leaf_blocks(html)
    assert [b.text for b in leaf_blocks("<script>a</script>b<noscript>c</noscript>")] == ["b"]


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<html><head><title>x</title><meta charset=utf-8><div><p>Hello there</p></div></html>", ["Hello there"]),
        ("<head><title>x</title><link rel=a>Plain words<p>and more", ["Plain words", "and more"]),
        ("<head><style>p{}</style><script>var a='<p>no</p>'</script><body><p>Yes", ["Yes"]),
        ("<title>x</title><p>One</p><head><p>Two</p></head>", ["One", "Two"]),
        ("<p>Before<svg><path d=1><text>drawn</text><p>After</p>", ["Before", "After"]),
        ("<p>Before<svg><title>t</title></svg> same</p>", ["Before same"]),
        ("<p>Shown</p><!-- hidden <p>never</p>", ["Shown"]),
        ("<p>Shown<!-- a --> too</p><!-- b", ["Shown too"]),
        ("<script><!-- var a; </script><p>Text</p>", ["Text"]),
        ("<head><noscript><p>none</p></noscript><title>t</title></head><p>Text", ["Text"]),
    ],
)
def test_tags_left_out(html, texts):
    assert [b.text for b in leaf_blocks(html)] == texts


def test_all_words_of_attributes_and_texts_count():
    (block,) = leaf_blocks('<div class="col-md-4 col-sm-6 d-none d-lg-block p-2 m-1 sidebar">Words</div>')
    assert "class:sidebar" in block.path[-1].split()
    long, longer = (leaf_blocks(f"<p>{'one two three four ' * 30}{end}</p>")[0] for end in ("1234567890", "subscribe"))
    assert (block_vector(long) != block_vector(longer)).sum() >= 2


def test_gradients_equal_differences():
    random = np.random.default_rng(2)
    model = Labeller({k: v.astype(np.float64) for k, v in Labeller.fresh().w.items()})
    x, y = random.normal(size=(5, INPUT)).astype(np.float32), np.array([1.0, 0, 1, 1, 0])
    _, grads = model.gradients(x, y)
    for name in ("xf", "hb", "bf", "o"):
        flat = model.w[name].reshape(-1)
        for place in random.integers(0, flat.size, 4):
            old = flat[place]
            flat[place] = old + 1e-3
            more = model.gradients(x, y)[0]
            flat[place] = old - 1e-3
            less = model.gradients(x, y)[0]
            flat[place] = old
            assert grads[name].reshape(-1)[place] == pytest.approx((more - less) / 2e-3, abs=2e-4)
    assert grads["o"].shape == (2 * HIDDEN,)


def test_a_block_reads_the_whole_page(labeller):
    page = np.zeros((6, INPUT), dtype=np.float32)
    other = page.copy()
    other[5, :8] = 1
    assert labeller.probabilities([page])[0][0] != labeller.probabilities([other])[0][0]


def test_pages_in_a_batch_don_t_touch_each_other(labeller):
    templates = _Templates(5)
    pages = [training_page(templates)[0] for _ in range(20)] + [np.zeros((0, INPUT), dtype=np.float32)]
    together = labeller.probabilities(pages)
    for page, found in zip(pages, together, strict=True):
        assert np.allclose(found, labeller.probabilities([page])[0], atol=1e-4)


def test_accuracy_on_unseen_layouts(labeller):
    templates = _Templates(12345)
    pages = [training_page(templates) for _ in range(150)]
    found = labeller.probabilities([x for x, _ in pages])
    right = sum(int(((p >= 0.5) == (y > 0)).sum()) for p, (_, y) in zip(found, pages, strict=True))
    assert right >= 0.96 * sum(len(y) for _, y in pages)


def test_extract(spark, labeller):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", PAGE), (None, "w", PAGE.replace("Bread", "Bread\n\n ")), (4, "x", "<p>" + "long word " * 30_000)]
    pages = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = extract(pages.coalesce(1), labeller).collect()
    assert [(r.page_id, r.url) for r in found] == [(r[0], r[1]) for r in rows]
    story = "Bread & butter\n\nFirst line goes on here, with many words to read.\n\nSecond © part of the story, which is longer than the first."
    assert [r.text for r in found][:5] == [story, "", "", story, story]
    assert all(r.n_chars == len(r.text) for r in found)
    assert extract(pages.limit(0), labeller).count() == 0


def test_stored_pages(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    exact = 0
    for r in extract(pages, labeller).collect():
        inside = [b.text for b in leaf_blocks(html[r.page_id]) if "article" in b.path]
        exact += r.text == "\n\n".join(inside)
    assert exact >= 0.99 * len(html)
