"""Spelling variants, whitening and reply trees against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import CLASHING, SCHEMA, rows
from quadro.llm import chat, spelling, whitening

# --- spelling variants ------------------------------------------------------------------


def counted(data):
    """The words of (doc_id, text) rows, as the module's constants say."""
    found = collections.Counter()
    for i, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(words):
    links = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(links[w]), words.get(form.get(w))) for w, n in words.items()}


def found(d):
    return {tuple(r) for r in d.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def variants_of(r, word):
    k, c = r.randrange(len(word)), r.choice("abeéñÿ")
    return r.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :], word[:k] + c + word[k:]])


@pytest.mark.parametrize("tile", [1 << 5, 1 << 9, 1 << 21])
def test_variants_are_those_of_brute_force(spark, monkeypatch, tile):
    """tile: buckets of more than a few words are split again and again."""
    monkeypatch.setattr(spelling, "TILE", tile)
    r = random.Random(8)
    stems = ["mariposa", "Öffnung", "aaaaaaaa", "abababab", "straßenbahn", "developpement", "aaaaaaa", "aaaaaaaaa"]
    texts = [None, "", "short abc", "a" * 3000 + " " + "a" * 2999 + " b" + "a" * 3000, "a" * 3000 + " " + "a" * 2999]
    for stem in stems:
        family = [stem] * 30 + [variants_of(r, stem) for _ in range(30)]
        family += [variants_of(r, w) for w in family[30:45]]
        texts += [" ".join(r.choice(family) + r.choice(["", ",", "1", "'"]) for _ in range(60)) for _ in range(6)]
    texts += ["mariposa " * 700, "maripos MARIPOSA Mariposa " * 40, "mariposX×mariposa÷x" * 3]
    ids = [None if k == 4 else k for k in range(len(texts))]
    d = spark.createDataFrame(rows(texts, ids=ids), SCHEMA).repartition(4)
    words = counted(zip(ids, texts, strict=True))
    got = spelling.variants(d)
    assert found(got) == expected(words) and got.count() == len(words) > 200
    assert any(form and root != form for _, form, root, *_ in expected(words))


def test_words_that_differ_in_one_letter_are_all_near(spark):
    """A letter at the same place of one word: every pair is near, in a bucket that can't be split further."""
    letters = [chr(c) for c in range(0xE0, 0x100) if c != 0xF7] + list("abcdefghijklmnopqrstuvwxyz")
    words = {f"prefi{c}suffix": 2 for c in letters}
    pairs = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()
    assert len({frozenset((p.word, p.near)) for p in pairs}) == len(pairs) == len(words) * (len(words) - 1) // 2


def test_no_words_give_no_rows(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame(rows(["one two", None]), SCHEMA)).count() == 0


def test_repeated_rows_count_as_often_as_they_occur(spark, repeated):
    data = [(r.doc_id, r.text) for r in repeated.collect()]
    assert found(spelling.variants(repeated)) == expected(counted(data))


# --- whitening --------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, " + ", ".join(f"{c} int" for c in CLASHING)


def vectors(spark, data, kind="float"):
    schema = VECTORS.replace("float", kind)
    return spark.createDataFrame([(i, v, *[None] * len(CLASHING)) for i, v in data], schema).repartition(4)


def whitened(data, keep=16):
    """By numpy: key, deviation and whitened values (either sign) of each row, and the eigenvalues' shares."""
    x = np.floor(64 * np.array([v for _, v in data], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = (n * u - s) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:keep], q[:, ::-1][:, :keep]
    good = e > 1e-12 * e[0]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ q[:, good] / np.sqrt(e[good]), e[good] / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("width", "kind"), [(1, "double"), (3, "float"), (16, "double"), (40, "float"), (90, "double")])
def test_whitening_is_numpys(spark, width, kind):
    r = np.random.default_rng(width)
    base = r.standard_normal((150, width)) * np.linspace(0.1, 2, width) ** 2
    if kind == "float":
        base = base.astype(np.float32)
    base[:, 0] *= 30  # one far above the others
    base = np.vstack([base, base[:1].repeat(80, 0)])  # a vector on a third of the rows
    data = [(k, v.tolist()) for k, v in enumerate(base)]
    odd = [(1000, None), (1001, []), (1002, [None, *[0.0] * (width - 1)]), (1003, [math.nan, *[0.0] * (width - 1)]), (1004, [math.inf, *[0.0] * (width - 1)]), (1005, [0.5] * (width + 1))]
    got = whitening.whiten(vectors(spark, data + odd, kind)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, z, shares = whitened(data)
    k = z.shape[1]
    assert len(got) == len(data) * k and set(got.n) == {n}
    assert got[got.component == 1].deviation.tolist() == deviation.tolist()
    mine = got.whitened.to_numpy().reshape(-1, k)
    assert np.abs(np.abs(mine) - np.abs(z)).max() < 1e-8 and np.abs(mine * np.sign((mine * z).sum(0)) - z).max() < 1e-8
    assert got.explained[:k].tolist() == pytest.approx(shares.tolist(), rel=1e-10) and got.identity_error.max() < 1e-8


def test_dimensions_without_spread_have_no_component(spark):
    r = np.random.default_rng(1)
    data = [(k, [a, 2 * a, 0.25]) for k, a in enumerate((r.integers(-20, 20, 60) / 4).tolist())]
    got = whitening.whiten(vectors(spark, data)).toPandas()
    assert set(got.component) == {1} and got.explained.iloc[0] == pytest.approx(1.0)
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0 and whitening.whiten(vectors(spark, [])).count() == 0


def test_very_large_entries_and_repeated_keys(spark):
    data = [(1, [3e38, 1.0]), (1, [-3e38, 2.0]), (None, [0.0, 3.0]), (2, [0.0, 5.0])]
    got = whitening.whiten(vectors(spark, data)).toPandas()
    assert len(got) == 4 and got.deviation.isna().sum() == 2 and np.isfinite(got.whitened).all()
    assert sorted(got.deviation.dropna()) == [4096.0, 331776.0]


SPECTRA = {
    "decay": 10.0 ** -np.arange(50), "top": np.r_[1e9, 1 + np.linspace(0, 1, 99)], "flat": np.ones(60), "many equal": np.r_[np.ones(45) * 5, np.ones(60)],
    "few": np.r_[5, 4, 3, np.zeros(60)], "steps": np.r_[100 * np.ones(3), 50 + np.linspace(0, 1e-9, 10), 10 + np.linspace(0, 1, 150)], "just over the block": np.arange(1.0, 34),
}


@pytest.mark.parametrize("name", list(SPECTRA))
def test_eigenpairs_of_hard_spectra(name):
    e = np.sort(SPECTRA[name])[::-1]
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(e), len(e))))[0]
    v, passes = (q * e) @ q.T, []
    got, x = whitening.leading(lambda y: passes.append(1) or v @ y, len(e))
    k = len(got)
    assert k == min(16, int((e > 1e-12 * e[0]).sum()) if name != "decay" else k) and len(passes) < 250
    assert np.abs(got - e[:k]).max() < 1e-12 * e[0] and np.linalg.norm(v @ x - x * got, axis=0).max() < 1e-11 * e[0] and np.abs(x.T @ x - np.eye(k)).max() < 1e-12


# --- reply trees ------------------------------------------------------------------------

PIECES = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", ":]", " ", "\n", "<s>", "</s>", "[INST] ", " [/INST]", "[ROLE] ", "[:] ", "é", "\U0001f600", "x"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), st.lists(st.sampled_from(PIECES)).map("".join)), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=5))
def test_any_turns_can_be_read_back(turns):
    made = "".join("".join(chat.turn(role, text)) for role, text in turns)
    assert list(chat.parsed(made)) == turns
    for _, text in turns:
        assert chat.unescaped(chat.escaped(text)) == text and not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]|\[:\]", chat.escaped(text))


def tree(spark, data):
    return spark.createDataFrame(data, "id bigint, parent bigint, score double, " + ", ".join(f"{c} int" for c in CLASHING if c not in ("rank", "root", "score"))).repartition(3)


def padded(data):
    return [(*x, *[1] * len([c for c in CLASHING if c not in ("rank", "root", "score")])) for x in data]


def best_paths(data, keep):
    known, answered = {i for i, *_ in data}, collections.defaultdict(list)
    score = {i: s or 0.0 for i, _, s in data}
    roots = []
    for i, parent, _ in data:
        if parent is None or parent == i or parent not in known:
            roots.append(i)
        else:
            answered[parent].append(i)
    out = set()
    for root in roots:
        paths, todo = [], [[root]]
        while todo:
            p = todo.pop()
            if answered[p[-1]]:
                todo += [[*p, c] for c in answered[p[-1]]]
            else:
                paths.append(p)
        paths.sort(key=lambda p: (-sum(score[i] for i in p), -len(p), p[-1]))
        for rank, p in enumerate(paths[:keep], 1):
            out |= {(root, rank, p[-1], place, i) for place, i in enumerate(p)}
    return out


@pytest.mark.parametrize("keep", [1, 2, None])
def test_branches_of_random_trees(spark, keep):
    r = random.Random(9)
    data = [(0, None, 1.0)]
    for i in range(1, 200):
        data.append((i, r.choice([None, i, 9999, *[r.randrange(max(0, i - 30), i) for _ in range(40)]]), r.choice([None, 0.0, 1.0, 2.0, -1.0])))
    data += [(300 + k, 300 + k - 1 if k else 7, 0.0) for k in range(70)]  # a long branch
    data += [(500, 501, 1.0), (501, 500, 1.0), (502, 501, 1.0)]  # a circle, and what hangs on it
    got = chat.branches(tree(spark, padded(data)), keep).select("root", "rank", "leaf", "place", "id")
    whole = [x for x in data if x[0] < 500]
    assert {tuple(x) for x in got.collect()} == best_paths(whole, keep)
    assert got.count() == len(best_paths(whole, keep))
    assert chat.branches(tree(spark, [])).count() == 0


def digests(turns):
    said = [t for role, t in turns if role == "assistant"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said))


@pytest.mark.parametrize("part", [50, 1 << 20])
def test_conversations_say_what_was_said(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)  # most conversations take several rows
    r = random.Random(10)
    text = lambda: r.choice([None, "", "".join(r.choice(PIECES) for _ in range(r.randint(1, 30)))])
    data = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), text()) for c in [None, 1, 2, 3, 4] for t in range(r.randint(1, 12))]
    data += [(5, t, "user" if t % 2 else "assistant", "x" * 200) for t in range(300)] + [(6, None, "user", "last"), (6, 3, "user", "first"), (6, 3, "assistant", "b"), (6, 3, "assistant", "b")]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    links, texts = chat.replies(turns)
    made = chat.conversations(links, texts)
    names = {x.id: x.conversation for x in texts.collect()}
    got = {names[x.leaf]: x for x in chat.read_back(made).collect()}
    by = collections.defaultdict(list)
    for c, t, role, said in sorted(data, key=lambda x: (x[1] is None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        by[c].append((role or "", said or ""))
    assert set(got) == set(by)
    whole = collections.defaultdict(str)
    for x in sorted(made.collect(), key=lambda x: x.part):
        whole[names[x.leaf]] += x.text
    for c, turns_of in by.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == digests(turns_of), c
        assert got[c].formatted_chars == len(whole[c]) and whole[c] == "<s>" + "".join("".join(chat.turn(*t)) for t in turns_of)
    assert (made.count() > len(by)) == (part == 50)


def test_no_turns_make_no_conversation(spark):
    links, texts = chat.replies(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, node int, root int"))
    assert chat.read_back(chat.conversations(links, texts)).count() == 0


def test_only_answers_of_the_assistant_count_in_the_loss(spark):
    said = "</s>[INST] ok [/INST]"
    d = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    x = chat.conversations(*chat.replies(d)).first()
    assert x.text == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST] <\\/s>[\\INST] ok [\\/INST]</s>"
    assert [x.text[s.start : s.end] for s in x.loss] == [chat.escaped(said)]
    assert chat.read_back(chat.conversations(*chat.replies(d))).select(F.col("loss_chars")).first()[0] == len(said)
