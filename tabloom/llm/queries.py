"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import exact_dedup, html_template, line_dedup, mixing, packing, records, runs, secrets, simhash, syncmers, token_counts, toxicity, whitening
from tabloom.llm.common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids, a row per piece."""
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1, size=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, BYTE_VOCABULARY, limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_template.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as records and read back."""
    folder, shards = records.write_records(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=2)
    return records.read_records(folder, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"), words=3, bits=3)
    return found.select("doc_id", "fingerprint", "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled_strings(docs))
    found = secrets.find_secrets(docs, model)
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.concat(base, "random")).alias("spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and the row of each that stays."""
    return exact_dedup.equal_texts(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited form, and their likeness."""
    found = syncmers.edited_neighbours(table(spark, sf_dir, "documents"))
    found = syncmers.with_likeness(found, "sketch", "edited_sketch", "near_edited")
    found = syncmers.with_likeness(found, "sketch", "next_sketch", "near_next")
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("sketch")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """Poor quality first, then toxicity with its probability."""
    return toxicity.train(docs, labels, {"poor": "1 - quality", "toxic": "toxic"})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain for every document, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select("doc_id", "p_poor", "p_toxic", "rejected")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    found = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), documents=10, least_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the first 32 components."""
    vectors = whitening.whole_numbers(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000)
    fitted = whitening.fit(vectors, most=32)
    found = whitening.whiten(vectors, fitted)
    found = found.withColumns({"n": F.lit(fitted.n).cast("long"), "identity_error": F.lit(fitted.identity_error)})
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of them made periodic first."""
    found = runs.periodic_runs(runs.repeating(table(spark, sf_dir, "documents")), least=12)
    first = F.col("longest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        first["start"].alias("start"),
        first["length"].alias("length"),
        first["period"].alias("period"),
        F.floor(first["length"] * 1000 / first["period"]).cast("long").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_pack": op1_pack,
    "op2_token_counts": op2_token_counts,
    "op3_html": op3_html,
    "op4_mix": op4_mix,
    "op5_records": op5_records,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  max(doc_id) OVER (PARTITION BY text) AS keep_id,
  count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1 AS kept,
  sha256(text) AS text_sha256
FROM d""",
    "op11_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
shared AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.line, k.pos, shared.key IS NOT NULL AS gone FROM k LEFT JOIN shared ON k.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op13_runs": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    -- CRC-32 of the digits, bit by bit
    xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END
    ), 4294967295::BIGINT) AS h
  FROM documents
),
e AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS changed FROM d),
a AS (SELECT *, CASE WHEN changed THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (
  SELECT doc_id, CASE WHEN changed THEN list_transform(range(n), lambda i: words[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE words END AS words
  FROM p
),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM t),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
  GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12
),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS r,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS collapsed
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i WHERE gone.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period,
  1000 * r.length // r.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed ON d.doc_id = listed.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id""",
}
