"""The registered queries of this package: each applies its operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, chat, decontaminate, divergence, lines, ngram, packing, personal, quality, resampling, simhash, substrings, warc
from barlake.llm.common import table
from barlake.session import ensure_checkpoint_dir


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one that holds control strings; the digests come from reading the output back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    done = chat.format_chat(rows.unionByName(probe).withColumn("parts", chat.as_parts(F.coalesce("text", F.lit("")))))
    done = done.withColumn("turns", chat.read_chat(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + 1
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 8)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

def vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public byte-level vocabulary that is installed beside Spark."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    ranks, pattern = vocabulary()
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, keep=["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back; a revisit's size is its response's."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda name: F.nullif(F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    read = warc.read_warc(spark, path, payload=False).select(page("record_id").alias("page_id"), "record_type", "payload_bytes", F.substring("digest", 6, 32).alias("named"), "payload_digest", F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"))
    responses, revisits = read.where("record_type = 'response'"), read.where("record_type = 'revisit'")
    target = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("checked"))
    resolved = revisits.join(target, "refers_to").where("named = checked").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("checked").alias("payload_digest"), "record_type", "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(resolved)


# Base32 of SHA-1 from its hex digits: five bits a letter.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: (('0x' || hex[i])::INTEGER::BIT::VARCHAR)[29:32]), 'string_agg', '') AS b FROM p),
d AS (SELECT page_id, body, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1
  + 16 * b[5*i+1]::INT + 8 * b[5*i+2]::INT + 4 * b[5*i+3]::INT + 2 * b[5*i+4]::INT + b[5*i+5]::INT]), 'string_agg', '') AS digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""

def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measure and score every document with a model fitted on the labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and link those at most two bits apart."""
    prints = simhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return simhash.link_fingerprints(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with an overlapping window."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line equals or nearly equals, and a digest of the text without them."""
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of earlier documents cover, and a digest of the words without them."""
    done = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with an interpolated bigram model of the training documents."""
    return ngram.score(table(spark, sf_dir, "documents"))


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    found = personal.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [personal.of_kind(F.col("base"), kind).cast("long").alias(f"n_{kind}") for kind in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal.listed(F.col("base")), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the ids of every document into sequences of at most 2,048 tokens."""
    import public_tokenizers

    pieces = packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("piece").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh every document against the benchmark's texts and draw a quarter of those with 20 words or more."""
    done = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


# A term's share is 1 + floor(10^9 * (n + 2) / (total + 2 * kept)); a pair sums over all kept terms of the language.
OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.total + 2 * v.v)) AS p,
    (1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.v)) AS q
  FROM g JOIN s USING (lang, source) JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_ngram": op2_ngram, "op3_quality": op3_quality, "op4_lines": op4_lines, "op5_simhash": op5_simhash, "op8_substrings": op8_substrings, "op9_personal": op9_personal, "op6_warc": op6_warc, "op7_bpe": op7_bpe, "op10_chat": op10_chat, "op11_packing": op11_packing, "op12_resampling": op12_resampling, "op13_divergence": op13_divergence}
SQL = {"op6_warc": OP6_SQL, "op10_chat": OP10_SQL, "op13_divergence": OP13_SQL}
