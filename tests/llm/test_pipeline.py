"""The stages of the corpus pipeline, each judged on its own input."""

import random
import re
from collections import Counter

import pytest
from conftest import SCHEMA, prose, rows
from test_operators import brute_components, word_sets

import corpus_pipeline
from quadro.llm import mixing, quality
from quadro.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of each stage, and the last result."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_stages_keep_the_columns(inputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mix", "piece_encoding"]
    assert all(d.columns == inputs[0].columns for d in inputs[:-1])


def test_quality_stage(spark, inputs):
    net = quality.train(inputs[0], table(spark, SF, "labels"))
    good = {r.doc_id for r in quality.classify(inputs[0], net).where("predicted = 1").collect()}
    assert {r.doc_id for r in inputs[1].collect()} == good


def test_dedup_stages(inputs):
    rows = sorted(inputs[1].collect(), key=lambda r: r.doc_id)
    first = {}
    for r in rows:
        first.setdefault(" ".join((r.text or "").split(" ")).replace("\n", " "), r.doc_id)
    kept = sorted(inputs[2].collect(), key=lambda r: r.doc_id)
    assert len(kept) <= len(first)
    ids, texts = [r.doc_id for r in kept], [r.text for r in kept]
    roots = brute_components(word_sets(texts, 5))
    assert {r.doc_id for r in inputs[3].collect()} == {ids[k] for k in set(roots)}


def test_mix_stage(inputs):
    copies = Counter(r.doc_id for r in inputs[4].collect())
    want = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect() if r.copies}
    assert copies == want


def test_rows_that_share_a_doc_id_or_have_none(spark):
    r = random.Random(4)
    a, b, c = (prose(r, 60) for _ in range(3))
    near = a + " more"
    data = [(5, a), (1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (2, near), (2, c + " more"), (None, near), (7, None), (7, None)]
    docs = spark.createDataFrame(rows([t for _, t in data], ["s"] * len(data), [k for k, _ in data]), SCHEMA).repartition(3)
    pairs = lambda d: sorted(((x.doc_id, x.text) for x in d.collect()), key=str)
    distinct = corpus_pipeline.distinct_texts(spark, docs, SF).cache()
    assert pairs(distinct) == sorted([(1, a), (1, b), (None, c), (2, near), (2, c + " more"), (7, None)], key=str)
    alone = corpus_pipeline.no_near_copies(spark, distinct, SF)
    assert pairs(alone) == sorted([(1, a), (1, b), (2, c + " more"), (7, None)], key=str)
    assert pairs(corpus_pipeline.no_near_copies(spark, docs, SF)) == sorted([(1, a), (1, b), (2, c + " more"), (7, None), (7, None)], key=str)


def test_mix_of_rows_that_share_a_doc_id(spark):
    """Each row has its own copies: the sources' words come as mix() plans them."""
    r = random.Random(6)
    texts = [prose(r, r.randint(5, 60)) for _ in range(120)]
    docs = spark.createDataFrame(rows(texts, ["x" if k % 3 else "y" for k in range(120)], [None if k % 4 == 0 else k % 7 for k in range(120)]), SCHEMA).repartition(3)
    size = Counter()
    for x in corpus_pipeline.mixed_sources(spark, docs, SF).collect():
        size[x.source] += len(x.text.split())
    plan = mixing.mix(docs).groupBy("source").agg({"target": "max"}).collect()
    for source, target in plan:
        assert abs(size[source] - target) <= 30


def test_last_stage(inputs):
    rows = inputs[5].collect()
    assert len(rows) == inputs[4].count()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


OWN = ["_pipeline_row", "_copy", "_copies", "_taken", "_group", "_number", "first", "copies", "predicted", "held_out", "keep_id", "component_id", "_ROW_"]


def test_columns_named_like_the_stages_own(spark):
    """Every further column comes through as it was, whatever its name."""
    r = random.Random(11)
    texts = [prose(r, r.randint(20, 60)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "", None]
    docs = spark.createDataFrame(rows(texts, ["a" if k % 2 else None for k in range(45)]), SCHEMA)
    docs = docs.selectExpr("*", *[f"doc_id * 10 + {k} AS `{c}`" for k, c in enumerate(OWN)]).repartition(3).cache()
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() > 0 and all(x[c] == x.doc_id * 10 + k for x in out.collect() for k, c in enumerate(OWN))
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_stages_are_what_a_plain_program_makes_of_them(spark, inputs):
    """Exact copies by a dictionary, near ones by all pairs of five-word sets, both over the stage's own input."""
    exact = {}
    for x in sorted(inputs[1].collect(), key=lambda x: x.doc_id):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", x.text or ""), x.doc_id)
    assert {x.doc_id for x in inputs[2].collect()} == set(exact.values())
    copies = Counter(x.doc_id for x in inputs[4].collect())
    size = {x.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) for x in inputs[3].collect()}
    source = {x.doc_id: x.source for x in inputs[3].collect()}
    total, taken = Counter(), Counter()
    for i, n in size.items():
        total[source[i]] += n
        taken[source[i]] += n * copies[i]
    assert max(copies.values()) <= 3
    names = sorted(total, key=lambda s: (s is None, s or ""))
    left, target, weight = float(sum(total.values())), {}, {s: 1 + k % 3 for k, s in enumerate(names)}
    open_ones = [s for s in names if total[s]]
    while open_ones:  # shares by weight, a source at three times its size gives back the rest
        share = left / sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if weight[s] * share > 3 * total[s]]
        for s in full or open_ones:
            target[s] = 3.0 * total[s] if full else weight[s] * share
        left -= sum(target[s] for s in full)
        open_ones = [s for s in open_ones if s not in full] if full else []
    for s, want in target.items():
        assert abs(taken[s] - want) <= max(60, 0.05 * want), (s, taken[s], want)
