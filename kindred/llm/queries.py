"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    chunking, credentials, embeddings, kneser_ney, langid, mixing, packing, quality, repair, simhash, toxicity,
    trie, warc,
)
from kindred.llm.common import remainder, table
from kindred.llm.conversations import digests, in_order
from kindred.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES["pipeline"] = corpus_pipeline.run


@query
def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.schedule(docs, corpus_pipeline.MIX, corpus_pipeline.MIX_OTHERS).select("doc_id", "source", "start", "block", "slot", "position")


ORACLE["op2_pfair_mixing"] = """
WITH RECURSIVE w(g, a) AS (
  VALUES ('(others)', 50), ('src0', 20), ('src1', 15), ('src2', 10), ('src3', 5)
), edf(slot, done, pick) AS (
  SELECT -1, (SELECT list(0 ORDER BY g) FROM w), NULL::VARCHAR
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda n, i: n + CASE WHEN i = p.i THEN 1 ELSE 0 END), p.g
  FROM edf, LATERAL (
    SELECT g, i FROM (SELECT g, a, row_number() OVER (ORDER BY g) AS i FROM w)
    WHERE done[i] < a AND (done[i] * 100) // a <= slot + 1
    ORDER BY ceil((done[i] + 1) * 100 / a), i LIMIT 1
  ) p
  WHERE slot < 99
), slots AS (
  SELECT pick AS g, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf WHERE slot >= 0
), d AS (
  SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN source ELSE '(others)' END AS g,
    coalesce(length(text), 0) AS n
  FROM documents
), s AS (
  SELECT doc_id, source, g,
    coalesce(sum(n) OVER (PARTITION BY g ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d
), b AS (SELECT *, start // 65536 AS block FROM s)
SELECT doc_id, source, start, block::BIGINT AS block,
  ((block // a) * 100 + slots.slot)::BIGINT AS slot,
  row_number() OVER (ORDER BY (block // a) * 100 + slots.slot, start, doc_id) - 1 AS position
FROM b JOIN w USING (g) JOIN slots ON slots.g = b.g AND slots.k = block % a
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences",
    )


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(stage(digests, "pieces"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE.mask)) != 0
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


ORACLE["op7_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id,
    len(w)::BIGINT AS n_words,
    length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '\p{Lu}'))::BIGINT AS n_upper,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered c USING (doc_id)
), f AS (
  SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars,
    ((n_words < 50)::BIGINT
     | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1)
     | ((10 * n_symbols > 3 * n_words)::BIGINT << 2)
     | ((n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT << 3)
     | ((coalesce(wc, 0) < 2 * n_words)::BIGINT << 4)
     | ((coalesce(wc, 0) > 20 * n_words)::BIGINT << 5)
     | ((n_words > 0 AND 2 * n_upper > coalesce(wc, 0))::BIGINT << 6)) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.deduplicate(docs).select(
        "doc_id",
        "text",
        F.size("removed").alias("n_removed"),
        F.aggregate("removed.words", F.lit(0), lambda a, x: a + x).alias("words_removed"),
        F.array_sort(F.array_distinct("removed.first_id")).alias("first_ids"),
    )


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read_archives(files).select(
        warc.page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
        "url",
    )


ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), digits AS (
  SELECT *, list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1, 1)) AS d
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(d, '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM digits
"""


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with other conversations' beginnings, and all conversations.

    Conversation c gets the first h turns of conversation c - c % 100 in place of its own first
    h, with h the CRC-32 of c modulo 6. Rows of a null ``conv_id`` are in no conversation.
    """
    rows = in_order(turns.where("conv_id IS NOT NULL")).select(F.col("_conv").alias("conv_id"), "pos", "role", "text")
    own = F.col("conv_id")
    h = F.crc32(own.cast("string").cast("binary")) % 6
    every = rows.where("pos = 0").select("conv_id")
    # a base serves a hundred conversations at most, with five turns
    wanted = every.select("conv_id", (own - own % 100).alias("base"), h.alias("h"))
    heads = rows.where((own % 100 == 0) & (F.col("pos") < 5)).withColumnRenamed("conv_id", "base")
    begun = wanted.join(heads, "base").where("pos < h").select("conv_id", "pos", "role", "text")
    return begun.unionByName(rows.where(F.col("pos") >= h)), every


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.prefix_trie(*rebuild(table(spark, sf_dir, "conversations")))
    named = found.members.select("node", "depth", "conv_id", F.col("conv_id").cast("string").alias("name"))
    ends = digests(named, ["node", "depth"], ["conv_id"], "name", ",")
    return found.nodes.join(ends, ["node", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE["op11_prefix_trie"] = """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
), turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base,
    xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns), crc
), rebuilt AS (
  SELECT convs.c, pos, said FROM convs JOIN turns ON turns.c = base AND pos < h
  UNION ALL SELECT c, pos, said FROM convs JOIN turns USING (c) WHERE pos >= h
), seqs AS (
  SELECT c, coalesce(list(said ORDER BY pos) FILTER (said IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), prefixes AS (
  SELECT c, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT d, p, list_slice(p, 1, d - 1) AS up, count(*) AS n, min(c) AS c, (count(*) - 1) * coalesce(length(p[d].text), 0) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM prefixes GROUP BY d, p
), below AS (
  SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN below USING (d, p)
), trees AS (
  SELECT k AS d, list_slice(p, 1, k) AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY 1, 2
)
SELECT x.c AS conv_id, x.d AS depth, up.c AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves::BIGINT AS n_leaves,
  trees.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM counted x JOIN trees USING (d, p) LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.up
"""


@query
def op12_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(table(spark, sf_dir, "documents"))
    base = F.col("rank") < len(credentials.BASE)
    texts = found.spans.groupBy("row").agg(
        credentials.spans_text(found.spans, base).alias("base"), credentials.spans_text(found.spans, F.lit(True)).alias("spans")
    )
    return found.documents.join(texts, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in credentials.BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql_pattern(pattern: str) -> str:
    """The same without ``(?i:``, which covers more than ASCII there, as an SQL string."""
    either = lambda m: "(?:" + re.sub("[a-z]", lambda x: f"[{x[0]}{x[0].upper()}]", m[1]) + ")"
    return re.sub(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", either, pattern).replace("'", "''")


def _credentials_sql() -> str:
    c = credentials
    patterns = [c.ASSIGN, c.ACCESS, c.HEX, c.IDENT, c.SECRET, c.ENDPOINT, c.BLANK_LINE]
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS rank, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d"
        for i, p in enumerate(map(_sql_pattern, patterns))
    )
    near = lambda kinds, w: (
        f"(coalesce(s - max(CASE WHEN rank IN {kinds} THEN e END) OVER {w}b, 1000000) <= {c.REACH}"
        f" OR coalesce(min(CASE WHEN rank IN {kinds} THEN s END) OVER {w}a - e, 1000000) <= {c.REACH})"
    )
    over = ", ".join(
        f"(coalesce(max(CASE WHEN rank < {k} THEN e END) OVER b, -1) > s"
        f" OR coalesce(min(CASE WHEN rank < {k} THEN s END) OVER a, e) < e) AS over_{k}"
        for k in (3, 4, 5)
    )
    window = lambda name, by: (
        f"{name}b AS (PARTITION BY {by} ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
        f"{name}a AS (PARTITION BY {by} ORDER BY s DESC, rank DESC, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    spans = "string_agg(['{}'][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank)".format("', '".join(c.KINDS))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
hits AS (SELECT r, rank, unnest(m) AS m, unnest(g) AS g, unnest(range(0, len(g))) AS i FROM found WHERE len(m) > 0),
placed AS (
  SELECT r, rank, m, sum(length(g) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS e FROM hits WHERE m IS NOT NULL
), parts AS (
  SELECT r, rank, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE CASE rank WHEN 0 THEN length(regexp_extract(m, '{_sql_pattern(c.ASSIGN)}', 1)) >= {c.LEAST_VALUE}
    WHEN 4 THEN regexp_matches(m, '^{_sql_pattern(c.SECRET_NAME)}') OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))
    ELSE true END
), scoped AS (
  SELECT *, coalesce(max(CASE WHEN rank = {c.SCOPE} THEN e END) OVER b, 0) AS scope, {over} FROM parts WINDOW {window('', 'r')}
), kept AS (
  SELECT * FROM scoped WHERE CASE rank WHEN 3 THEN NOT over_3 WHEN 4 THEN NOT over_4 WHEN 5 THEN NOT over_5 ELSE rank < 3 END
), linked AS (
  SELECT *, {near('(1, 3)', 'n')} AS named, {near('(0, 2, 4)', 'n')} AS secret FROM kept WINDOW {window('n', 'r, scope')}
), spans AS (
  SELECT r, rank, s, e FROM linked
  WHERE CASE rank WHEN 3 THEN secret WHEN 4 THEN named WHEN 5 THEN named AND secret ELSE true END
), texts AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce({spans} FILTER (rank < 3), '') AS base, {spans} AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (r)
"""


ORACLE["op12_credential_linking"] = _credentials_sql()


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults that the CRC-32 of ``conv_id:turn`` picks; a null is one space."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("conv_id", "turn", "role", "text")]
    way = F.crc32(F.concat(text[0], F.lit(":"), text[1]).cast("binary")) % 20
    marks = F.regexp_replace("text", "[.!?]", "")
    damaged = turns.select("conv_id", "turn", *text[2:], way.alias("way")).select(
        "conv_id", "turn",
        F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, marks).otherwise(F.col("text")).alias("text"),
        F.when(F.col("way") == 0, 0).when(F.col("way") == 3, 2).otherwise(1).alias("times"),
    )
    return damaged.select("*", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times", "col")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = repair.repair(damage(turns))
    line = F.concat("role", F.lit(":"), "text").alias("line")
    said = digests(repaired.turns.select(F.struct("conv_id").alias("conv"), "place", line), ["conv"], ["place"], "line", "\n")
    every = turns.select(F.struct(F.col("conv_id").cast("bigint").alias("conv_id")).alias("conv")).distinct()
    found = repaired.conversations.select(F.struct("conv_id").alias("conv"), *repaired.conversations.columns[1:])
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "conv", "left").join(said, "conv", "left").select(
        "conv.conv_id",
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
