"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, merkle, mixing, ngram_join, packing, quality, resample, sharding, suffix_dedup, tokens, topk, toxicity
from .common import arrow_map, column, durable, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op2_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(text, chr(92), 'xx'), '<', 'xx'))
                + CASE WHEN before = role THEN 8 ELSE 12 + length(replace(replace(replace(role, chr(92), 'xx'), '<', 'xx'), '>', 'xx')) END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST(2 AS DOUBLE) * source_size AS cap, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS everything,
         CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rn FROM w),
l AS (
  SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
g AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, rn) FROM l AS x WHERE x.level * x.w <= x.cap) * w, cap)) AS target
  FROM l),
c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, d.h, d.source,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS rounds,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS run,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, target - rounds * source_size AS need FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (rounds + CASE WHEN run < need OR (run - own < need AND run - need < need - (run - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n
"""


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = durable(docs.select("doc_id", mixing.word_count().alias("n_tokens"), F.xxhash64("text").alias("_text")))
    return packing.pack(sized, "n_tokens", ["doc_id", "_text"]).drop("_text")


@query
def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLES["op10_exact_topk"] = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e AS q, e AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    folder = tokens.token_folder(docs)
    manifest = tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return tokens.read_tokens(manifest, folder)


@query
def op7_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.repetition(read(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op7_quality_repetition"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
g AS (
  SELECT rid, i, n,
         CASE WHEN i + 3 <= n THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS g3,
         CASE WHEN i + 8 <= n THEN string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g8,
         CASE WHEN i + 61 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)) END AS g61
  FROM p),
c AS (
  SELECT rid, i,
         CAST(g3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g3) > 1 AS INTEGER) AS r3,
         CAST(g8 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g8) > 1 AS INTEGER) AS r8,
         CAST(g61 IS NOT NULL AND count(*) OVER (PARTITION BY rid, g61) > 1 AS INTEGER) AS r61
  FROM g),
v AS (
  SELECT rid, r61, max(r3) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
         max(r8) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
  FROM c),
t AS (SELECT rid, sum(c3) AS c3, sum(c8) AS c8, max(r61) AS r61 FROM v GROUP BY rid),
x AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c3, 0) AS c3, coalesce(c8, 0) AS c8, coalesce(r61, 0) AS r61
  FROM d LEFT JOIN t USING (rid)),
y AS (SELECT *, n_words < 50 OR 100 * c3 > 50 * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(c3 AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 10 * c8 <= 3 * n_words AND r61 = 0 AS kept
FROM y
"""


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read(spark, sf_dir, "documents"), words=3, similarity="0.9")


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS grams
  FROM d),
n AS (SELECT doc_id, len(grams) AS n FROM g),
p AS (SELECT doc_id, unnest(grams) AS gram FROM g),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same
  FROM p AS a JOIN p AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y
  WHERE 100 * same >= 90 * (a.n + b.n - same)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id
FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) AS c ON c.node = n.doc_id
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.ToxicityModel.fit(docs, read(spark, sf_dir, "labels").where(toxicity.fold() != 1))
    scores = model.score(docs, ["doc_id"])
    return scores.select("doc_id", (toxicity.fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum of a word, by bits: 79764919's mirror 3988292384 is the polynomial.
CRC32 = """
  steps AS (
    SELECT b, 0 AS k, CAST(b AS UBIGINT) AS c FROM range(256) AS r(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE k < 8),
  tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
  sums AS (
    SELECT word, xor(list_reduce(list_transform(range(CAST(len(hex(encode(word))) / 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS INTEGER) AS UBIGINT)),
                     lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS crc
    FROM vocabulary, tab)"""

ORACLES["op11_resample"] = r"""
WITH RECURSIVE
  raw AS (
    SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
  texts AS (
    SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM raw),
  uses AS (SELECT side, rid, unnest(w) AS word FROM texts),
  vocabulary AS (SELECT DISTINCT word FROM uses),""" + CRC32 + r""",
  n AS (
    SELECT crc % 10000 AS bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM uses JOIN sums USING (word) GROUP BY 1),
  totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM n),
  gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM n, totals),
  weights AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM uses JOIN sums USING (word) JOIN gains ON gains.bucket = crc % 10000 WHERE side = 'd' GROUP BY rid),
  scored AS (
    SELECT rid, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM texts LEFT JOIN weights USING (rid) WHERE side = 'd'),
  places AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (rid)
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, resample.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], seen={"text": tampered})


def merkle_sql(levels: int = 10) -> str:
    """Levels that have one node already are handed on unchanged, so any number up to 16 ** levels of rows or sources is fine."""
    value = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    low = "CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    leaf = "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    sql = f"""
WITH RECURSIVE
  vocabulary AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS word FROM documents WHERE doc_id IS NOT NULL),{CRC32},
  docs AS (SELECT row_number() OVER () AS rid, d.*, coalesce(crc, 1) AS crc FROM documents AS d LEFT JOIN sums ON word = CAST(doc_id AS VARCHAR)),
  leaves AS (SELECT rid, doc_id, source, {leaf} || {value("text")}) AS leaf, {leaf} || {value("given")}) AS given FROM (SELECT *, {low} AS given FROM docs)),
  l0 AS (SELECT coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, leaf AS node, rid FROM leaves),"""
    steps = []
    for side, start, key in (("l", "l0", "tree"), ("t", "t0", "tree")):
        for k in range(levels):
            steps.append(f"""
  {side}{k + 1} AS (
    SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {side}{k}) GROUP BY tree, pos // 16),""")
        if side == "l":
            steps.append(f"""
  t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, node, tree AS name FROM l{levels}),""")
    fold = []
    before = "(SELECT leaves.*, l0.tree, l0.pos, '' AS proof, given AS folded FROM leaves JOIN l0 USING (rid))"
    for side in ("l", "t"):
        for k in range(levels):
            name = f"{side}f{k + 1}"
            fold.append(f"""
  {side}g{k} AS (
    SELECT tree, pos // 16 AS up, list(struct_pack(pos := pos, node := node) ORDER BY pos) AS run, any_value(n) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {side}{k}) GROUP BY ALL),
  {name} AS (
    SELECT f.* REPLACE (f.pos // 16 AS pos,
             CASE WHEN n = 1 THEN proof ELSE proof || list_aggregate(list_transform(run, lambda x: CASE WHEN x.pos = f.pos THEN '' ELSE x.node END), 'string_agg', '') END AS proof,
             CASE WHEN n = 1 THEN folded ELSE sha256(list_aggregate(list_transform(run, lambda x: CASE WHEN x.pos = f.pos THEN folded ELSE x.node END), 'string_agg', '')) END AS folded)
    FROM {before} AS f JOIN {side}g{k} AS g ON f.tree = g.tree AND f.pos // 16 = g.up),""")
            before = name
        if side == "l":
            fold.append(f"""
  mid AS (SELECT f.* EXCLUDE (tree, pos), t0.node AS subroot, '' AS tree, t0.pos FROM {before} AS f JOIN t0 ON t0.name = f.tree),""")
            before = "mid"
    return sql + "".join(steps) + "".join(fold).rstrip(",") + f"""
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.node AS verified
FROM {before} AS f, t{levels} AS r
"""


ORACLES["op12_merkle_manifest"] = merkle_sql()


@query
def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = bestfit.pack_best_fit(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    kept = ["doc_id", "piece", "start", "length", "sequence_id", "offset"]

    def sums(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()) for ids, width in zip(column(batch, "ids"), column(batch, "width"))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in kept] + [pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return arrow_map(packed, sums, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids_crc32 long")
