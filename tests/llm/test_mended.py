"""Pieces of any length, families just too different, plain pages, markup that never ends."""

import random
import time

import pytest
from conftest import SCHEMA, prose, rows
from test_operators import brute_components, word_sets

from quadro.llm import html_blocks, html_crf, html_pages, minhash, pieces

# --- pieces -----------------------------------------------------------------------------


def vocabulary(word, unigram):
    """Letters, and the beginnings of a long word, each made of the one before and a letter."""
    letters = sorted(set(word) | {" ", "z"})
    starts = [word[:k] for k in range(2, len(word) + 1)]
    texts = [*starts, *letters]
    scores = [-(1.0 + k) if unigram else -float(k) for k in range(len(starts))] if not unigram else [-30.0 + k / 2 for k in range(len(starts))]
    scores += [-40.0] * len(letters) if unigram else [-1000.0] * len(letters)
    found = [(t, 256 + k, s) for k, (t, s) in enumerate(zip(texts, scores, strict=True))]
    return pieces.Vocabulary(found, [bytes([k]) for k in range(256)] + [t.encode() for t in texts], 0, unigram)


@pytest.mark.parametrize("unigram", [False, True])
@pytest.mark.parametrize("size", [17, 25, 50, 70])
def test_pieces_longer_than_sixteen(spark, unigram, size):
    r = random.Random(size)
    word = " " + "".join(r.choice("abcdefgh") for _ in range(size - 1))
    v = vocabulary(word, unigram)
    of = {t: i for t, i, _ in v.pieces}
    texts = [word[1:], word[1:] + word, word[1:-1], word[1:] + "z"]
    d = spark.createDataFrame(rows(texts), SCHEMA)
    got = {x.doc_id: x.ids for x in pieces.encode(d, v).select("doc_id", "ids").collect()}
    assert got[0] == [of[word]] and got[1] == [of[word]] * 2 and got[2] == [of[word[:-1]]] and got[3] == [of[word], of["z"]]
    assert v.widest == size


def test_a_vocabulary_that_an_edge_cannot_hold(spark):
    v = pieces.Vocabulary([("a", (1 << 21) + 5, 0.0)], [b"a"], 0)
    with pytest.raises(ValueError, match="2\\^20"):
        v.frame(spark)


# --- near copies ------------------------------------------------------------------------


def family(r, template, changed):
    w = template.split(" ")
    for at in r.sample(range(0, len(w), 6), changed):
        w[at] = "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    return " ".join(w)


def test_a_template_makes_no_pairs_and_links_are_all_found(spark):
    """One template on most rows, copies too different to be linked, and some that are linked."""
    r = random.Random(12)
    template = prose(r, 120)
    texts = [family(r, template, 4) for _ in range(150)] + [family(r, template, 1) for _ in range(20)] + [template]
    texts += [t + " end" for t in texts[:10]]
    d = spark.createDataFrame(rows(texts), SCHEMA).repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.near_groups(d).collect()}
    assert got == dict(enumerate(brute_components(word_sets(texts, 5))))


# --- pages ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_crf.train(html_pages.labelled_pages(html_crf.TRAIN_PAGES, plain=html_crf.PLAIN_PAGES))


TEXT = "Rain fell on the hills for most of the week. Farmers had waited for it since April. The river rose by a metre. Nobody was hurt. The road to the coast is open again."
MORE = "A second part says what comes next, and it is shorter."


@pytest.mark.parametrize("page", [
    f"<article><p>{TEXT}</p></article>", f"<main><p>{TEXT}</p></main>", f"<body><p>{TEXT}</p></body>", f"<html><body><p>{TEXT}</p></body></html>", f"<p>{TEXT}</p>",
    f"<div class='rhs'><h3>Hot now</h3><ul><li><a href='x'>One</a></li><li><a href='y'>Two</a></li></ul></div><article><p>{TEXT}</p></article>",
    f"<section id='zq'><p>{TEXT}</p></section><div class='rhs'><ul><li><a href='x'>One thing</a></li><li><a href='y'>Two</a></li></ul></div>"])
def test_plain_pages_have_their_text(model, page):
    assert html_crf.main_text(model, page) == TEXT


def test_two_paragraphs_of_an_article(model):
    assert html_crf.main_text(model, f"<article><p>{TEXT}</p><p>{MORE}</p></article>") == f"{TEXT}\n\n{MORE}"


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<!", "<?", "</", '<a b="', "<!-- >", "<div>", "<div>x", "<p><a>", "<ul><li>", "&", "<object>", "<template>"])
def test_markup_that_never_ends_takes_time_in_proportion(piece):
    html_blocks.blocks_of(piece * 100)
    began = time.process_time()
    html_blocks.blocks_of(piece * (200_000 // len(piece)))
    assert time.process_time() - began < 12


def test_open_markup_keeps_what_stands_before_and_after_it():
    texts = lambda page: [b.text for b in html_blocks.blocks_of(page)]
    assert texts("<p>one<p>two <a href='x") == ["one", "two"]
    assert texts("<p>one<!-- open ><p>two") == ["one", "two"]
    assert texts("<p>one<!-- a --><p>two<!-- open") == ["one", "two"]
    assert texts("<p>one<a href=\"x>two</a><p>three") == ["one", "two", "three"] or texts("<p>one<a href=\"x>two</a><p>three")[-1] == "three"
    assert texts("<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y") == ["x", "y"]
