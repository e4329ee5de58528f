"""One query per operator over the whole sample tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelinekit.catalog.tables import table
from pipelinekit.llm.decontamination import contaminated
from pipelinekit.llm.language_models import cross_entropy_difference
from pipelinekit.llm.licenses import license_scan
from pipelinekit.llm.manifest import ascii_lower, folded, leaf, merkle_proofs, siblings
from pipelinekit.llm.packing import pack
from pipelinekit.llm.pieces import encoded
from pipelinekit.llm.pii import KINDS, personal_data
from pipelinekit.llm.quality import quality
from pipelinekit.llm.quality_rules import quality_rules
from pipelinekit.llm.sharding import byte_shards
from pipelinekit.llm.simhash import simhash_components
from pipelinekit.llm.substrings import dedup_substrings
from pipelinekit.llm.twins import merkle, variants
from pipelinekit.llm.variants import spelled_words, spelling_variants

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
LEAST_LETTERS, LEAST_OCCURRENCES = 6, 5


def tokenizer_model(name: str = TOKENIZER) -> str:
    """The content of a public vocabulary file, read on the driver."""
    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_model())


def written(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def how_many(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [how_many("spans", kind).alias(f"n_{kind}") for kind in KINDS]
    both = found.withColumn("all_spans", F.concat("spans", "term_spans"))
    return both.select("doc_id", *counts, F.sha2(written("spans"), 256).alias("base_sha256"), written("all_spans").alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target domain are the documents labelled good and not toxic."""
    target = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoded(table(spark, sf_dir, "documents"), Path(public_tokenizers.path(PIECES)).read_bytes())
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelled_words(table(spark, sf_dir, "documents"))
    return spelling_variants(words.filter((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_OCCURRENCES)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    seen = F.when(tampered, leaf(*others, ascii_lower(F.col("text")))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf(*others, F.col("text"))).withColumn("seen", seen).select("doc_id", "lang", "leaf", "seen")
    proofs = merkle_proofs(leaves, "lang", ["doc_id"]).withColumn("folded_root", folded(F.col("seen"), "path"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_sharding, op3_decontamination, op4_packing, op5_pii,
        op6_simhash, op7_substring_dedup, op8_quality_classifier, op9_lm_scoring, op10_license_scans,
        op11_sentencepiece, op12_spelling_variants, op13_merkle_manifest,
    )
}

ORACLE = {
    "op7_substring_dedup": r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS words
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts WHERE len(words) >= 13)
), owners AS (
  SELECT words, min(doc_id) AS owner FROM windows GROUP BY words
), gone AS (
  SELECT doc_id, list(DISTINCT place + k) AS places
  FROM (SELECT w.doc_id, w.place, unnest(range(13)) AS k FROM windows w JOIN owners o ON w.words = o.words AND w.doc_id > o.owner)
  GROUP BY doc_id
)
SELECT t.doc_id, len(t.words) AS n_words, coalesce(len(g.places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN g.places IS NULL THEN t.words
    ELSE list_filter(t.words, lambda w, i: NOT list_contains(g.places, i)) END, ' ')) AS kept_sha256
FROM texts t LEFT JOIN gone g USING (doc_id)
""",
    "op12_spelling_variants": variants(),
    "op13_merkle_manifest": merkle(),
}
