"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadro.llm import chat, exact_dedup, html_crf, media, minhash, mixing, pieces, quality, secrets, spelling, suffixes, warc, whitening
from quadro.llm.common import stage, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents, up to 1,024 words, count up to twice as much for each word."""
    words = F.least(mixing.word_count("text"), F.lit(1024))
    d = mixing.mix(table(spark, sf_dir, "documents"), importance=1 + words / 1024)
    return d.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), width=4)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.cut(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary() -> pieces.Vocabulary:
    import public_tokenizers

    return pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.encode(table(spark, sf_dir, "documents"), vocabulary())
    return d.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("same").alias("round_trip"))


def _damaged(record: Column) -> Column:
    """A replica's copy of a record: some are lost, cut short, or have a flipped character."""
    of = lambda k, r: F.coalesce(F.pmod("page_id", F.lit(k)) == r, F.lit(False))
    size, half = F.length(record), F.floor(F.length(record) / 2).cast("int")
    flipped = F.concat(F.substring(record, F.lit(1), half), F.lit("\x7f"), F.substring(record, half + 2, size))
    return F.when(of(997, 13), F.lit(None)).when(of(499, 7), F.substring(record, F.lit(1), size - 1)).when(of(251, 3), flipped).otherwise(record)


def op6_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records, replica = stage(warc.leaves(pages), "records"), stage(warc.leaves(pages, _damaged), "replica")
    found = warc.audit(records, replica).where("status <> 'added'").select(*[F.col(c).alias(f"f_{c}") for c in ("file_no", "page_id", "url", "digest", "nth")], "status")
    same = (F.col("file_no") == F.col("f_file_no")) & F.col("page_id").eqNullSafe(F.col("f_page_id")) & (F.col("url") == F.col("f_url")) & (F.col("digest") == F.col("f_digest")) & (F.col("nth") == F.col("f_nth"))
    return records.join(found, same, "left").select(
        "page_id", "file_no", "seq", F.col("start").alias("offset"), "length", F.col("digest").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


OP6_SQL = """
WITH r AS (SELECT page_id, coalesce(url, '') AS url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
d AS (SELECT page_id, url, page_id // 512 AS file_no, strlen(record) AS length, sha256(record) AS sha256 FROM r),
held AS (SELECT page_id, url, sha256(CASE WHEN page_id % 499 = 7 THEN left(record, length(record) - 1)
  WHEN page_id % 251 = 3 THEN left(record, length(record) // 2) || chr(127) || substr(record, length(record) // 2 + 2) ELSE record END) AS sha256 FROM r WHERE page_id % 997 <> 13)
SELECT d.page_id, file_no, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, d.sha256,
  CASE WHEN held.sha256 IS NULL THEN 'missing' WHEN held.sha256 <> d.sha256 THEN 'changed' ELSE 'intact' END AS status
FROM d LEFT JOIN held ON held.page_id = d.page_id AND held.url = d.url WINDOW w AS (PARTITION BY file_no ORDER BY d.page_id, d.url, d.sha256 ROWS UNBOUNDED PRECEDING)
"""


def op7_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(table(spark, sf_dir, "documents"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    joined = lambda a: F.array_join(F.transform(a, shown), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select(
        "doc_id", *[count(k) for k in secrets.KINDS],
        F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied"),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def _op8_sql() -> str:
    """The scan in SQL: a match begins after the gaps and matches before it."""
    patterns = [(p.replace("'", "''"), group) for p, group, *_ in secrets.KINDS.values()]
    matches = " UNION ALL ".join(
        f"SELECT r, source, {k} AS k, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {group}) AS inside FROM d WHERE regexp_matches(t, '{p}')"
        for k, (p, group) in enumerate(patterns))
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(secrets.KINDS))
    base = len(secrets.BASE)
    sizes = "list_sum(list_transform({}, lambda x: length(x)))"
    shown = "CASE f.k " + names + " END || ':' || f.s || ':' || f.e"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), m AS ({matches}),
u AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
a AS (SELECT r, source, k, {sizes.format('gaps[1:i]')} + {sizes.format('found[1:i]')} AS e, length(found[i]) AS n, inside[i] AS v FROM u),
c AS (SELECT r, source, k, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM a WHERE length(v) >= CASE k WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END
  AND (k < {base} OR regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))),
o AS (SELECT v, count(DISTINCT source) + count(DISTINCT CASE WHEN source IS NULL THEN 1 END) AS owners FROM c GROUP BY v),
f AS (SELECT c.*, owners > {secrets.MAX_OWNERS} AS copied FROM c JOIN o ON c.v = o.v WHERE k < {base} OR owners <= {secrets.MAX_OWNERS} AND NOT EXISTS (SELECT 1 FROM c b WHERE b.r = c.r AND b.k < {base} AND b.s < c.e AND c.s < b.e))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE f.k = {k}) AS n_{name}" for k, name in enumerate(secrets.KINDS))}, count(*) FILTER (WHERE f.copied) AS n_copied,
  sha256(coalesce(string_agg({shown}, ',' ORDER BY f.s, f.k) FILTER (WHERE f.k < {base}), '')) AS base_sha256, coalesce(string_agg({shown}, ',' ORDER BY f.s, f.k) FILTER (WHERE f.k IS NOT NULL), '') AS spans
FROM d LEFT JOIN f ON f.r = d.r GROUP BY d.r, d.doc_id
"""


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measure(media.store(table(spark, sf_dir, "documents")))


def op10_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op11_edit_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 bit by bit; near words share a text with one letter taken out, of both at the same place or of one of them.
OP11_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) AS h FROM u),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2),
k AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.rest UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.rest),
b AS (SELECT word, count(*) AS n_near, min({'less': -n, 'near': near}) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
e AS (SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT e.word, f.form, steps + 1 FROM e JOIN f ON f.word = e.here AND f.form IS NOT NULL)
SELECT f.word, form, e.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, steps) AS root FROM e GROUP BY word) e ON e.word = f.word
"""


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    tree, texts = chat.replies(given.unionByName(probe))
    found = chat.read_back(chat.conversations(tree, texts))
    return found.join(texts.select(F.col("id").alias("leaf"), F.col("conversation").alias("conv_id")), "leaf").select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: Control strings grow by a backslash; each turn has its marks beside its text; `<s>` is three characters.
OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|:)\]')) AS n,
  length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|:)\]')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 19 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_pareto_mix": op1_pareto_mix,
        "op2_byte_cnn_quality": op2_byte_cnn_quality,
        "op3_tensored_minhash": op3_tensored_minhash,
        "op4_suffix_array": op4_suffix_array,
        "op5_piece_lattice": op5_piece_lattice,
        "op6_merkle_audit": op6_merkle_audit,
        "op7_crf_extraction": op7_crf_extraction,
        "op8_secret_ownership": op8_secret_ownership,
        "op9_progressive_jpeg": op9_progressive_jpeg,
        "op10_chunk_recipe_dedup": op10_chunk_recipe_dedup,
        "op11_edit_tiles": op11_edit_tiles,
        "op12_chebyshev_whitening": op12_chebyshev_whitening,
        "op13_reply_trees": op13_reply_trees,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_tensored_minhash": OP3_SQL, "op6_merkle_audit": OP6_SQL, "op8_secret_ownership": _op8_sql(), "op10_chunk_recipe_dedup": OP10_SQL, "op11_edit_tiles": OP11_SQL, "op13_reply_trees": OP13_SQL}
