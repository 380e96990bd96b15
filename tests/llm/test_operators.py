"""Each operator against a brute-force version, and on the cases that its docstring defines."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadro.llm import components, exact_dedup, html_blocks, html_crf, html_pages, jpeg, media, minhash, mixing, pieces, quality, secrets, suffixes, warc
from quadro.llm.queries import queries, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def found(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- 1: mixing ---


def test_targets_share_by_weight_and_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, None: 500}
    d = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(d).collect()}
    weights, want, free = {"a": 1, "b": 2, "c": 3, None: 1}, {}, set(sizes)
    while True:  # share again until none is above
        left = sum(sizes.values()) - sum(want.values())
        share = {s: weights[s] * left / sum(weights[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in above}
        free -= above
    assert got == pytest.approx(want)


def test_mix(docs, empty, repeated, texts):
    rows = mixing.mix(docs).collect()
    assert {r.doc_id: r["size"] for r in rows} == {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    assert mixing.mix(docs).select("doc_id", "taken").exceptAll(mixing.mix(docs.repartition(5)).select("doc_id", "taken")).isEmpty()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(repeated).count() == repeated.count()


def test_inclusion_follows_importance(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), (F.col("id") % 2).cast("string").alias("source"), (F.col("id") % 4 + 1).alias("i"))
    got = mixing.mix(d.where("source = '0'").unionByName(d.where("source = '1'")), importance=F.col("i")).collect()
    rate = {k: np.mean([r.copies for r in got if r.source == "0" and r.doc_id % 4 == k]) for k in (0, 2)}
    assert rate[2] / rate[0] == pytest.approx(3, rel=0.25)


def test_draw_equals_brute_force(spark):
    """Unequal probabilities, some sources at three times their size: every step by hand."""
    r = random.Random(8)
    data = [(k, " ".join("w" * (1 + r.randrange(60))), r.choice("aaabc"), float(r.choice([0.3, 1, 2.5, 9]))) for k in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, i double")
    got = found(mixing.mix(d, importance=F.col("i")))
    chance = {x.doc_id: x.u for x in d.select("doc_id", mixing.uniform(mixing.SEED, "doc_id").alias("u")).collect()}
    size = {k: len(t.split()) for k, t, *_ in data}
    for source in "abc":
        own = [k for k, _, s, _ in data if s == source]
        target, weight = got[own[0]].target, {k: 2 ** (round(np.log2(data[k][3]) * mixing.STEPS) / mixing.STEPS) for k in own}
        low, high = 0.0, 1e9
        for _ in range(200):  # the level at which the expected words are the target
            level = (low + high) / 2
            low, high = (level, high) if sum(size[k] * min(3, level * weight[k]) for k in own) < target else (low, level)
        expected = {k: min(3, high * weight[k]) for k in own}
        expected = {k: round(e, 9) if abs(e - round(e)) < 1e-6 else e for k, e in expected.items()}
        copies, rank = {k: int(e) for k, e in expected.items()}, {}
        for k in own:
            p, u = expected[k] % 1, chance[k]
            if p:
                rank[k] = u * (1 - p) / (u * (1 - p) + p * (1 - u))
        for fill in range(mixing.FILLS):
            last, gap, taken = fill == mixing.FILLS - 1, target - sum(size[k] * c for k, c in copies.items()), 0
            for k in sorted((k for k in rank if size[k] <= (2 * gap if last else gap)), key=lambda k: (rank[k], k)):
                taken += size[k]
                if taken - (size[k] / 2 if last else 0) > gap:
                    break
                copies[k] += 1
                del rank[k]
        assert copies == {k: got[k].copies for k in own}
        assert sum(size[k] * c for k, c in copies.items()) == pytest.approx(target, abs=30)


def test_inclusion_is_near_its_probability(spark):
    """Copies on average over many draws, against what is expected of each document."""
    r = random.Random(9)
    data = [(k, " ".join("w" * (1 + r.randrange(8))), r.choice("ab"), float(1 + k % 3)) for k in range(60)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, i double").coalesce(1).cache()
    runs = [found(mixing.mix(d, importance=F.col("i"), seed=s)) for s in range(12)]
    for kind in range(3):
        own = [k for k in range(60) if k % 3 == kind and runs[0][k].source == "a"]
        share = sum(run[k].copies * run[k]["size"] for run in runs for k in own) / sum(run[k]["size"] for run in runs for k in own)
        weight = 2 ** (round(np.log2(kind + 1) * mixing.STEPS) / mixing.STEPS)
        mass = sum(runs[0][k]["size"] * 2 ** (round(np.log2(1 + k % 3) * mixing.STEPS) / mixing.STEPS) for k in range(60) if runs[0][k].source == "a")
        assert share == pytest.approx(min(3, runs[0][own[0]].target * weight / mass), abs=0.25)


# --- 2: quality ---


def junk(r, text):
    return " ".join(w + r.choice(["%%%", "###"]) for w in text.split())


def test_quality_learns_and_scores_whole_texts(spark, docs, empty, texts):
    from conftest import prose

    r = random.Random(5)
    good = [prose(r, r.randint(20, 200)) for _ in range(220)]
    data = [(k, t if k % 4 else junk(r, t), int(k % 4 > 0)) for k, t in enumerate(good)]
    d = spark.createDataFrame([(k, t, "extra") for k, t, _ in data], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(k, q) for k, _, q in data], "doc_id long, quality int")
    net = quality.train(d, labels)
    got = found(quality.classify(d, net))
    held = {k for k, *_ in data if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, r in got.items() if r.held_out} == held
    assert np.mean([got[k].predicted == q for k, _, q in data if k in held]) > 0.9
    clean = prose(r, 8000)  # the end of a long text counts
    whole, tail = (quality.scores(net, *layout([clean + end]))[0] for end in ("", " " + junk(r, prose(r, 100))))
    assert tail < whole
    scored = found(quality.classify(docs, net))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    assert scored[0].score == scored[1].score  # null is empty
    alone = quality.scores(net, *layout([texts[9]]))[0]
    assert scored[9].score == pytest.approx(alone, abs=1e-6)
    assert quality.classify(empty, net).count() == 0
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns
    assert kept.where("doc_id % 4 > 0").count() > 150 > kept.where("doc_id % 4 = 0").count() * 10


def layout(texts):
    return np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_quality_without_labels_is_undecided(spark, docs):
    net = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.classify(docs, net).collect()} == {0.5}


def test_gradients_are_those_of_the_loss():
    net = quality.fit([b"a b c d e f g h " * 9, b"zz zz %% " * 9] * 4, [1, 0] * 4)
    for p in net.parts():
        p[...] = p.astype(np.float64)
    texts, y = [b"abc def ghi jkl mno pqr " * 30, b"q%% r%% s%% " * 25], np.array([1.0, 0.0], np.float32)

    def loss():
        p = quality.scores(net, *layout([t.decode() for t in texts]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = quality._gradients(net, texts, y)
    for part, g in ((net.out, grads[4]), (net.hidden, grads[3]), (net.shift, grads[2])):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = part[i].copy(), 1e-2
        part[i] = old + eps
        up = loss()
        part[i] = old - eps
        down = loss()
        part[i] = old
        assert (up - down) / (2 * eps) == pytest.approx(g[i], rel=0.15, abs=2e-4)


def test_scores_equal_a_plain_loop(texts):
    """The network once more, window by window, for texts of every length."""
    from conftest import prose

    r, rng = random.Random(2), np.random.Generator(np.random.PCG64(1))
    q = quality
    net = q.Net(*(rng.normal(0, 1, s).astype(np.float32) for s in ((q.SYMBOLS, q.EMBED), (q.WIDTH * q.EMBED, q.FILTERS), q.FILTERS, (q.FILTERS, q.HIDDEN), q.HIDDEN, 1)))
    some = [(t or "").encode() for t in texts[:40]] + [prose(r, k).encode() for k in (1, 5, 21, 22, 43, 90)] + [b"a a b b b", b"x" * 129]

    def plain(text):
        marks = np.zeros(len(text), int)
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        for (a, b), (c, e) in zip(words, words[1:], strict=False):
            if text[a:b].lower() == text[c:e].lower():
                marks[c:e] = 256
        codes = [c + m for c, m in zip(text, marks.tolist(), strict=True)] + [0] * (q.HALF * q.STRIDE * 2 + q.WIDTH)
        window = lambda k: np.maximum(np.concatenate([net.embed[c] for c in codes[k * q.STRIDE : k * q.STRIDE + q.WIDTH]]) @ net.filters + net.shift, 0)
        n = -(-len(text) // q.STRIDE)
        halves = max(1, (len(text) + q.WIDTH - q.STRIDE) // (q.HALF * q.STRIDE) + 1)
        tops = []
        for h in range(max(1, halves - 1)):
            own = [window(k) for k in range(h * q.HALF, min(n, (h + 2) * q.HALF, halves * q.HALF))]
            tops.append((np.mean(own, axis=0) if own else np.zeros(q.FILTERS)) @ net.hidden)
        return 1 / (1 + np.exp(-(np.max(tops, axis=0) @ net.out + net.bias[0])))

    data, offsets = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    assert q.scores(net, data, offsets) == pytest.approx([plain(t) for t in some], abs=1e-4)


# --- 3: near copies ---


def word_sets(texts, width):
    out = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def brute_components(sets):
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return [top(x) for x in range(len(sets))]


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(docs, texts, width):
    got = found(minhash.near_groups(docs, width))
    sets = word_sets(texts, width)
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in enumerate(sets)}
    assert {k: r.component_id for k, r in got.items()} == dict(enumerate(brute_components(sets)))
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_near_groups_of_odd_tables(empty, repeated):
    assert minhash.near_groups(empty).count() == 0
    rows = minhash.near_groups(repeated).collect()
    assert len(rows) == 6
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}


def test_many_near_copies_and_a_shared_passage_make_few_pairs(spark):
    from conftest import edited, prose

    r = random.Random(9)
    base, passage = prose(r, 120), prose(r, 60)
    texts = [edited(r, base, 1) for _ in range(150)] + [prose(r, 60) + " " + passage for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(minhash.near_groups(d, 4))
    assert {k: x.component_id for k, x in got.items()} == dict(enumerate(brute_components(word_sets(texts, 4))))


def test_components_of_chains(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60) if k % 20] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame([*links, (None, 3)], "u long, v long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got}
    assert set(root) - set(got) == {a for a, b in links if a == b and all(a not in p or p == (a, a) for p in links)}


# --- 4: repeated passages ---


def brute_removed(texts, ids=None):
    first, out = {}, []
    ids = list(range(len(texts))) if ids is None else ids
    for k in sorted(range(len(texts)), key=lambda k: ids[k]):
        b = (texts[k] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], ids[k])
    for k, t in enumerate(texts):
        b = (t or "").encode()
        mask = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < ids[k]:
                mask[i + 1 : i + 51] = True
        runs = np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2).tolist()
        out.append((runs, bytes(c for c, gone in zip(b, mask[1:], strict=False) if not gone)))
    return out


def test_repeated_passages(docs, empty, texts):
    got, want = found(suffixes.cut(docs)), brute_removed(texts)
    for k, (runs, kept) in enumerate(want):
        assert (got[k].runs, bytes(got[k].kept), got[k].n_bytes) == (runs, kept, len((texts[k] or "").encode()))
    assert suffixes.cut(empty).count() == 0


def test_repeated_passages_of_repeated_ids(repeated):
    rows = suffixes.cut(repeated).collect()
    assert len(rows) == 6
    assert all(r.n_removed == 0 for r in rows)  # the same id, or none, takes nothing


def test_anchors_are_the_same_for_equal_strings():
    r = np.random.Generator(np.random.PCG64(1))
    shared = r.integers(97, 101, 50).astype(np.uint8)
    one, two = (np.concatenate([r.integers(97, 101, n).astype(np.uint8), shared, r.integers(97, 101, n).astype(np.uint8)]) for n in (40, 73))
    inside = lambda data, n: {a - n for a in suffixes._suffixes(data)[2].tolist() if n <= a <= n + 26}
    grams = suffixes._Prefix(shared).every(suffixes.LEAD)
    least = int(grams.argmin())
    assert least in inside(one, 40)
    assert least in inside(two, 73)


# --- 5: pieces ---


def test_pieces_equal_the_library(docs, empty, repeated, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v = vocabulary()
    encoded = pieces.encode(docs, v, most=20)  # most units come by the shuffle
    got = found(encoded)
    assert all(list(got[k].ids) == sp.encode(t or "") and got[k].same for k, t in enumerate(texts))
    back = found(pieces.decode(encoded, v))
    assert all(back[k].text == (t or "") for k, t in enumerate(texts))
    assert pieces.encode(empty, v).count() == 0
    assert sorted(len(r.ids) for r in pieces.encode(repeated, v).collect()) == sorted(len(sp.encode(r.text or "")) for r in repeated.collect())


def unigram_model(entries):
    """A SentencePiece model file of the unigram kind, from (piece, score, type)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda k, data: number(k << 3 | 2) + number(len(data)) + data
    body = b""
    for piece, score, kind in entries:
        body += field(1, field(1, piece.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind]))
    trainer = b"\x18\x01" + number(35 << 3) + b"\x01" + number(40 << 3) + b"\x00" + number(41 << 3) + b"\x01" + number(42 << 3) + b"\x02"
    return body + field(2, trainer) + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_viterbi_equals_the_library_on_a_unigram_file(docs, texts):
    import sentencepiece

    v = vocabulary()
    kept = [p for p in sorted(v.pieces, key=lambda p: p[1]) if p[1] < 6000 or len(p[0]) == 1]
    entries = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", -1000, 6) for b in range(256)]]
    entries += [(p.replace(" ", pieces.SYMBOL), -np.log(k + 7.3), 1) for k, (p, _, _) in enumerate(kept)]
    try:
        sp = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(entries))
    except RuntimeError as e:  # pragma: no cover
        pytest.skip(f"the library refuses the file: {e}")
    own = pieces.from_processor(sp, unigram=True)
    got = found(pieces.encode(docs, own, most=50))
    tied = "x" * 3000  # its 3,001 symbols have many best paths
    assert all(list(got[k].ids) == sp.encode(t or "") for k, t in enumerate(texts) if t != tied and len(t or "") < 20000)
    assert all(r.same for r in got.values())


# --- 6: fixity ---


def test_audit_finds_damage(spark):
    data = [(k, f"http://x/{k}", "<p>" + "x" * (k % 50), None) for k in range(3000)] + [(None, None, None, 1), (5, "http://x/5", "<p>" + "x" * 5, 2)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, seq int")
    records = warc.leaves(pages)
    damaged = warc.leaves(pages, lambda r: F.when(F.col("page_id") == 700, None).when(F.col("page_id").isin(5, 1500), F.concat(r, F.lit("!"))).otherwise(r))
    got = sorted((r.page_id, r.status) for r in warc.audit(records, damaged).collect())
    assert got == [(5, "changed"), (5, "changed"), (700, "missing"), (1500, "changed")]
    assert warc.audit(records, records).count() == 0
    assert sorted(r.status for r in warc.audit(damaged, records).collect()) == ["added", "changed", "changed", "changed"]
    one = found(records.where("page_id = 9"), "page_id")[9]
    text = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/9\r\nContent-Type: text/html\r\nContent-Length: 12\r\n\r\n<p>xxxxxxxxx\r\n\r\n"
    assert (one.digest, one.length) == (hashlib.sha256(text.encode()).hexdigest(), len(text))
    nothing = records.limit(0)
    assert warc.audit(nothing, nothing).count() == 0
    assert {r.status for r in warc.audit(records, nothing).collect()} == {"missing"}


def test_one_row_that_is_absent_is_one_missing_record(spark):
    """Each replica numbers what it holds: nothing after a loss counts as changed."""
    pages = spark.createDataFrame([(k, f"u{k}", "y" * (k * 7 % 31)) for k in range(300)], "page_id long, url string, html string")
    whole, part = warc.leaves(pages), warc.leaves(pages.where("page_id <> 11"))
    assert [(r.page_id, r.status) for r in warc.audit(whole, part).collect()] == [(11, "missing")]
    assert [(r.page_id, r.status) for r in warc.audit(part, whole).collect()] == [(11, "added")]
    ranges = [found(warc.tree(x)[0], "node") for x in (whole, part)]
    assert len([n for n in ranges[0] if ranges[0][n].digest != ranges[1][n].digest]) == 1  # of five ranges


def test_audit_of_rows_that_repeat(spark):
    """Hundreds of equal records, several contents of one page, rows without page_id, a very long record."""
    data = [(7, "u", "same")] * 300 + [(7, "u", f"other {k}") for k in range(5)] + [(None, "n", "a"), (None, "n", "a"), (None, None, "b"), (8, "long", "z" * 300_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    less = spark.createDataFrame(data[2:302] + [(7, "u", "new"), *data[303:307], data[308]], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.url, r.status) for r in warc.audit(warc.leaves(pages), warc.leaves(less)).collect())
    assert got == [("7", "u", "changed"), ("7", "u", "missing"), ("7", "u", "missing"), ("None", "", "missing")]


# --- 7: main texts ---


@pytest.fixture(scope="module")
def crf():
    return html_crf.train(html_pages.labelled_pages(300))


def test_main_text_of_common_layouts(crf):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>"
        '<div class="cookie notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First   paragraph,\n with <b>words</b>&nbsp;and &eacute;t&eacute;.<p>Second one, which is longer, and ends here.'
        '<div class="ad">Buy now!</div></article><aside><h3>Related</h3><p>Other things to read.</p></aside><form><p>Your mail</p><input></form><section class="comments"><p>I liked this very much, thanks for it.</p></section>'
        "<footer>&copy; 2020 Site</footer></body></html>")
    assert html_crf.main_text(crf, page) == "Head & line\n\nFirst paragraph, with words and été.\n\nSecond one, which is longer, and ends here."


def test_embedded_text_is_kept(crf):
    """None of the elements that are drawn, run or fallen back to loses text, closed or not."""
    plain = "A sentence of the article, long enough to be taken for one of its own."
    texts = {f"e{k}": f"{plain} Number {k}." for k in range(4)}
    for tag in ("noscript", "object", "svg", "iframe", "textarea", "template"):
        for page in (
            f"<body><article><p>{texts['e0']}<{tag}>{texts['e1']}</{tag}><p>{texts['e2']}</article><p>{texts['e3']}</body>",
            f"<body><article><p>{texts['e0']}<p>{texts['e1']}<{tag}></article><p>{texts['e2']}<{tag}><{tag}></{tag}><p>{texts['e3']}</body>",
            f"<body><{tag}><article><p>{texts['e0']}<p>{texts['e1']}</article><p>{texts['e2']}<{tag}><p>{texts['e3']}</body>",
            f"<head><title>T<{tag}><body><p>{texts['e0']}<p>{texts['e1']}<p>{texts['e2']}<p>{texts['e3']}",
        ):
            wanted = list(texts.values())
            if tag == "template" and f"{texts['e1']}</template>" in page:
                wanted.remove(texts["e1"])
            got = html_blocks.blocks_of(page)
            assert [b.text for b in got if b.text != "T"] == wanted, page
            unclosed = f"</{tag}>" not in page
            assert not unclosed or not any(tag in b.path for b in got)
    formula = "<article><h1>Title of it</h1><p>" + plain + " Here <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds, as was shown.<object><p>" + plain + " Fallback.</object></article>"
    assert html_crf.main_text(crf, formula).split("\n\n") == ["Title of it", plain + " Here a=b holds, as was shown.", plain + " Fallback."]
    assert [b.text for b in html_blocks.blocks_of("<p>One <svg><path d=x></svg> two <svg> </svg> three<p>Icon <svg><title>t</title><text>label</text></svg>")] == ["One two three", "Icon", "label"]
    assert [b.path for b in html_blocks.blocks_of("<p>Icon <svg> <text>label</text></svg> end")] == [("p",), ("p", "svg"), ("p",)]
    assert [b.text for b in html_blocks.blocks_of("<head><title>T</title><p>No head end<script>x</script><style>y</style><template><div>z<p>z</div>z</template> here.")] == ["No head end", "here."]
    assert [b.text for b in html_blocks.blocks_of("<head><title>T<p>No title end.")] == ["No title end."]


def test_the_query_gives_the_articles_of_the_pages(spark):
    """Against a plain cut of what stands between the article's tags, on every page of two tables."""
    block = re.compile(r"</?(?:p|h\d|ul|ol|li|div|blockquote|pre|table|tr|td|section|figure|figcaption)\b[^>]*>")
    for sf in ("sf0.001", "sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
        got = queries()["op7_crf_extraction"](spark, f"/root/testdata/{sf}").collect()
        assert len(got) == len(pages)
        for r in got:
            inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
            parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in block.split(inner)]
            assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, "\n\n".join(p for p in parts if p), len(r.text))


def test_marked_sections_are_markup():
    assert [b.text for b in html_blocks.blocks_of("<p>a</p><![foo[bar]]><p>b <![if x]>c<![endif]></p><![CDATA[d]]><p>e<![x")] == ["a", "b c", "e<![x"]


def test_very_long_pages(crf):
    text = "A sentence of some length, as articles have them. " * 40
    page = "<article>" + "".join(f"<p>{k}: {text}</p>" for k in range(500)) + "</article>"
    assert html_crf.main_text(crf, page) == "\n\n".join(f"{k}: {text.strip()}" for k in range(500))


def test_labels_of_unseen_pages(crf):
    right = total = 0
    for html, labels in html_pages.labelled_pages(120, seed=77):
        blocks = html_blocks.blocks_of(html)
        for b, label in zip(blocks, crf.label(blocks), strict=True):
            right, total = right + (labels.get(b.text) == label), total + 1
    assert right / total > 0.95


def test_viterbi_is_the_best_of_all_paths(crf):
    blocks = html_blocks.blocks_of(html_pages.labelled_pages(5, seed=3)[1][0])[:9]
    own = [sum(crf.weights.get(f, 0.0) for f in html_crf.path_features(b.path) | html_crf.text_features(b, k, len(blocks))) for k, b in enumerate(blocks)]

    def score(y):
        return sum(o for o, v in zip(own, y, strict=True) if v) + sum(crf.follow[a, b] for a, b in zip(y, y[1:], strict=False))

    paths = [[int(c) for c in f"{k:0{len(blocks)}b}"] for k in range(2 ** len(blocks))]
    assert score(crf.label(blocks)) == pytest.approx(max(map(score, paths)))
    weights = np.exp([score(p) for p in paths])
    node, pair = html_crf.marginals(np.array(own), crf.follow)
    assert node == pytest.approx(np.array(paths).T @ weights / weights.sum(), abs=1e-9)
    assert pair.sum() == pytest.approx(len(blocks) - 1)


def test_extraction_of_odd_pages(spark, crf):
    data = [(1, None, None, 1), (2, "u", "", 2), (3, "u", "<p", 3), (None, "u", "<article><p>Text of it, in words.", 4), (5, "u", "<div>" * 500 + "<p>deep words, really deep.", 5), (1, None, None, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text int")
    got = html_crf.extract(pages, crf).collect()
    assert len(got) == 6
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert html_crf.extract(pages.limit(0), crf).count() == 0


# --- 8: secrets ---

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token)|(?i:api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets(docs, empty, repeated, texts):
    got = found(secrets.scan(docs))
    for k, t in enumerate(texts):
        assert sorted((s.kind, s.start, s.end) for s in got[k].spans if s.base) == sorted(brute_spans(t))
        assert [s.start for s in got[k].spans] == sorted(s.start for s in got[k].spans)
    assert any(s.kind == "owned" and not s.base for r in got.values() for s in r.spans)
    assert secrets.scan(empty).count() == 0
    assert secrets.scan(repeated).count() == 6


def test_owned_spans_equal_brute_force(docs, texts):
    """Counts of owners over all candidates, then tokens clear of every base span."""
    rows = docs.select("doc_id", "text", "source").collect()
    token = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
    kinds = [("assign", ASSIGN, 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]{24,}"), 0, 24), ("owned", token, 0, 20)]
    owners, spans = defaultdict(set), defaultdict(list)
    for r in rows:
        for order, (kind, pattern, group, least) in enumerate(kinds):
            for m in pattern.finditer(r.text or ""):
                v = m[group]
                if len(v) >= least and (kind != "owned" or all(re.search(x, v) for x in ("[0-9]", "[a-z]", "[A-Z]"))):
                    owners[v].add(r.source)
                    spans[r.doc_id].append((m.start(), order, m.end(), kind, v))
    got = found(secrets.scan(docs))
    for r in rows:
        base = [s for s in spans[r.doc_id] if s[3] != "owned"]
        clear = lambda s: not any(b[0] < s[2] and s[0] < b[2] for b in base)  # noqa: B023, E731
        want = sorted(s for s in spans[r.doc_id] if s[3] != "owned" or len(owners[s[4]]) <= 2 and clear(s))
        assert [(s.start, s.end, s.kind, s.n_owners) for s in got[r.doc_id].spans] == [(a, z, kind, len(owners[v])) for a, _, z, kind, v in want]


def test_spans_that_meet(spark):
    key = "a1B2" * 6
    got = found(secrets.scan(spark.createDataFrame([(1, f"token={key}" + "0" * 24 + " " + "0a" * 12, "o")], "doc_id long, text string, source string")))
    assert [(s.kind, s.start, s.end) for s in got[1].spans] == [("assign", 0, 54), ("hex", 29, 54), ("hex", 55, 79)]


def test_copied_examples_are_told_from_owned_ones(spark):
    key, own = "Ab1" * 10, "Zy9" * 10
    data = [(k, f"é see {key} here", f"o{k}") for k in range(6)] + [(9, f"é mine {own} token: {key}", "o9"), (10, None, None)]
    got = found(secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string")))
    assert [(s.kind, s.start, s.end, s.copied) for s in got[9].spans] == [("owned", 7, 37, False), ("assign", 38, 75, True)]
    assert got[3].spans == [] and got[10].spans == []


# --- 9: media ---


def test_media_round_trip(docs, empty, texts):
    files = media.store(docs)
    got = found(media.measure(files))
    for k, t in enumerate(texts):
        n, payload = media.padded(t)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[0].media_sha256 == got[1].media_sha256
    stored = found(files)[9]
    assert (got[9].media_bytes, got[9].media_sha256) == (len(stored.media), hashlib.sha256(stored.media).hexdigest())
    picture = found(media.tensors(files.where("doc_id = 9")))[9]
    assert len(picture.rgb) == picture.height * picture.width * 3
    assert media.measure(media.store(empty)).count() == 0


def test_scans_read_bit_by_bit_give_the_same(monkeypatch):
    data = jpeg.encode(random.Random(1).randbytes(1500))
    fast = jpeg.decode(data)
    monkeypatch.setattr(jpeg, "_one_bit", lambda codes: None)
    slow = jpeg.decode(data)
    assert all((a == b).all() for a, b in zip(fast.coefficients, slow.coefficients, strict=True))


def test_samples_are_those_of_the_cosine_transform():
    pic = jpeg.decode(jpeg.encode(bytes(range(256)) * 2))
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = pic.coefficients[0][0, 1]
    c = block.reshape(8, 8)
    a = [np.sqrt(1 / 8)] + [0.5] * 7
    want = [[sum(a[u] * a[v] * c[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    got = (pic.coefficients[0][0, 1].astype(np.float32) @ jpeg._INVERSE).reshape(8, 8)
    assert got == pytest.approx(np.array(want), abs=0.05)
    assert jpeg.ZIGZAG[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10]


# --- 10: exact copies ---


def test_exact_groups(docs, empty, repeated, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for identify in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))):  # a weak hash needs the verification
        got = found(exact_dedup.exact_groups(docs, identify))
        for k, t in enumerate(norm):
            r = got[k]
            assert (r.keep_id, r.group_size, r.kept) == (norm.index(t), norm.count(t), norm.index(t) == k)
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    rows = exact_dedup.exact_groups(repeated).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows if r.doc_id is not None) == [(1, 1, 3), (1, 1, 3), (2, 2, 1), (2, 2, 1)]


def test_chunks_put_together_are_the_text(docs, texts):
    d = docs.select("doc_id", exact_dedup.normalised("text").alias("t")).withColumn("c", exact_dedup.chunks(F.col("t")))
    for r in d.collect():
        assert "".join(r.c) == r.t
        assert all(0 < len(c) <= exact_dedup.MAX_CHARS for c in r.c)


def test_word_hashes_do_not_depend_on_neighbours():
    from quadro.llm import shingles

    texts = ["a b", None, "A\tb c", "", "x"]
    whole = shingles.shingle_sets(pa.array(texts), 2)
    alone = [shingles.shingle_sets(pa.array([t], pa.string()), 2)[0] for t in texts]
    assert [w.tolist() for w in whole] == [a.tolist() for a in alone]
    assert set(whole[0].tolist()) <= set(whole[2].tolist())
