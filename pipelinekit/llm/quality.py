"""Quality of documents from their text and their site, by hierarchical empirical Bayes.

A logistic regression on labelled statistics gives each document its log odds of being good; a document labelled toxic is not good. Three of the statistics are
of its words: how much more often the worst of them, the third worst, and all on average, are in bad documents than in good ones, by counts per hash of a word. What the
other documents of a host, and of a path within it, say together is a second source of evidence: the sum of their probabilities is a soft count of good
documents. The share of a host is shrunk toward the global share, and that of a path toward its host's, as Beta priors whose
strengths are estimated from how much hosts, and paths within hosts, differ beyond chance. Sites with few documents
thus say little, sites with many say what they show. Both kinds of evidence add up as log odds.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pipelinekit.llm.batches import map_slices, struct, utf8, words
from pipelinekit.llm.statistics import COUNTS, FEATURES, SCHEMA, features, statistics
from pipelinekit.operators.conditions import keys_match
from pipelinekit.storage import stored

SAMPLE_ROWS = 20_000  # labelled documents that the classifier is fitted on, at most
RIDGE = 1.0
STEPS = 30
STRENGTH = (2.0, 1e6)  # least and greatest weight of a prior, in documents
THRESHOLD = 0.5
SURE = 1e-4  # probabilities stay this far from 0 and 1
HASHES = 1 << 16  # that words are told apart by
DOUBT = 5.0  # documents that a word without any is taken to be in, good and bad in proportion
WORDS = ("worst_word", "third_word", "mean_word")
NAMES = (*FEATURES, *WORDS)


class Classifier:
    """Ridge logistic regression on standardised ratios and their squares."""

    def __init__(self, table: np.ndarray, good: np.ndarray) -> None:
        self.share = float(np.clip(good.mean(), SURE, 1 - SURE)) if len(good) else 1 - SURE
        self.usable = bool(len(good)) and 0 < good.mean() < 1
        if not self.usable:
            return
        self.low, self.high = table.min(axis=0), table.max(axis=0)
        self.middle, self.spread = table.mean(axis=0), table.std(axis=0)
        self.spread[self.spread < 1e-12] = 1.0
        z = (table - self.middle) / self.spread
        x = np.column_stack([np.ones(len(z)), z, z**2])
        weights = np.zeros(x.shape[1])
        penalty = np.eye(x.shape[1]) * RIDGE
        penalty[0, 0] = 1e-6
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (good - p) - penalty @ weights
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
            weights = weights + move / max(1.0, float(np.abs(move).max()))
            if np.abs(move).max() < 1e-8:
                break
        self.weights = weights

    def log_odds(self) -> Column:
        """As one expression over columns ``NAMES``; ratios outside those of the sample count as its nearest ones."""
        if not self.usable:
            return F.lit(math.log(self.share / (1 - self.share)))
        k = len(NAMES)
        terms = []
        for i, value in enumerate(map(F.col, NAMES)):
            held = F.least(F.greatest(value, F.lit(float(self.low[i]))), F.lit(float(self.high[i])))
            z = (held - F.lit(float(self.middle[i]))) / F.lit(float(self.spread[i]))
            terms.append(F.lit(float(self.weights[1 + i])) * z + F.lit(float(self.weights[1 + k + i])) * z * z)
        return reduce(Column.__add__, terms, F.lit(float(self.weights[0])))


def word_hashes(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the lower-cased words of a text, without marks around them."""
    found = {w.strip(b".,;:!?()[]{}<>*'\"") for w in set(words(text.lower()))} if text else set()
    return np.unique(np.fromiter((zlib.crc32(w) % HASHES for w in found if w), np.int64))


def word_evidence(good: np.ndarray, bad: np.ndarray, goods: float, bads: float) -> np.ndarray:
    """Per hash the log of how much more often it is in bad documents than in good ones."""
    share = bads / max(goods + bads, 1.0)
    if not 0 < share < 1:
        return np.zeros(HASHES, np.float32)
    return (np.log((bad + DOUBT * share) / share) - np.log((good + DOUBT * (1 - share)) / (1 - share))).astype(np.float32)


def with_evidence(docs: DataFrame, evidence: list[np.ndarray], by: str | None = None, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, packed as ``row``, and the ratios ``NAMES``, words by ``evidence`` of number ``by`` (else the first)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    which = F.lit(0) if by is None else F.col(by)
    packed = docs.select(F.struct(*kept).alias("row"), which.cast("int").alias("which"), F.col(text).alias("text"))
    # 65,536 numbers per table, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def count(batch: pa.RecordBatch) -> dict:
        stats, ratios = [], []
        for body, number in zip(utf8(batch.column("text")), batch.column("which").to_pylist(), strict=True):
            stats.append(dict(zip(COUNTS, statistics(body), strict=True)))
            found = shared.value[number][word_hashes(body)]
            worst = -np.partition(np.concatenate([-found, np.zeros(3, np.float32)]), 2)[:3]
            ratios.append((float(worst.max()), float(worst.min()), float(found.mean()) if len(found) else 0.0))
        words_of = zip(WORDS, zip(*ratios, strict=True), strict=True) if ratios else ((name, []) for name in WORDS)
        return {"row": batch.column("row"), "stats": stats} | {name: list(values) for name, values in words_of}

    schema = StructType([packed.schema["row"], StructField("stats", struct(SCHEMA)), *[StructField(n, DoubleType()) for n in WORDS]])
    counted = map_slices(packed, count, schema)
    return counted.select("row", *[c.alias(name) for name, c in features().items()], *WORDS)


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text") -> tuple[Classifier, np.ndarray]:
    """A classifier and the evidence of words, from at most ``sample_rows`` labelled documents, chosen by a hash of the key.

    A document is good if none of its labels says otherwise: not of quality 0 and, where there is such a column, not toxic. The classifier is fitted on
    evidence that each half of the sample takes from the other, so it isn't misled by words that only one document has.
    """
    quality_of = F.col("quality")
    good = F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 0).otherwise(quality_of) if "toxic" in labels.columns else quality_of
    named = labels.select(F.col(key).alias("key"), good.alias("label")).filter(F.col("key").isNotNull() & F.col("label").isNotNull())
    chosen = named.groupBy("key").agg(F.min("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").limit(sample_rows)
    half = F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(2)).cast("int")
    sample = stored(texts.select("key", (F.col("label") != 0).cast("int").alias("good"), half.alias("half"), "text"), "sample")

    def hashes(batch: pa.RecordBatch) -> dict:
        found = [word_hashes(body) for body in utf8(batch.column("text"))]
        owners = pa.array(np.repeat(np.arange(len(found)), [len(h) for h in found]))
        return {"half": batch.column("half").take(owners), "good": batch.column("good").take(owners), "hash": np.concatenate([*found, np.zeros(0, np.int64)])}

    seen = map_slices(sample.select("half", "good", "text"), hashes, "half int, good int, hash int").groupBy("half", "good", "hash").count().toPandas()
    size = sample.groupBy("half", "good").count().toPandas()
    table, totals = np.zeros((2, 2, HASHES)), np.zeros((2, 2))
    table[seen["half"], seen["good"], seen["hash"]] = seen["count"]
    totals[size["half"], size["good"]] = size["count"]
    every = word_evidence(table[:, 1].sum(0), table[:, 0].sum(0), *totals.sum(0)[::-1])
    others = [word_evidence(table[1 - h, 1], table[1 - h, 0], totals[1 - h, 1], totals[1 - h, 0]) for h in (0, 1)]
    rows = with_evidence(sample, others, "half").select("row.key", "row.good", *NAMES).toPandas().sort_values(["key", *NAMES])
    return Classifier(rows[list(NAMES)].to_numpy(float).reshape(-1, len(NAMES)), rows["good"].to_numpy(float)), every


def _probability(log_odds: Column) -> Column:
    return F.least(F.greatest(1 / (1 + F.exp(-log_odds)), F.lit(SURE)), F.lit(1 - SURE))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, count: float, squares: float, groups: float, spread: float, parents: float) -> float:
    """The weight of a prior by moments: from how far the shares of groups differ beyond chance."""
    chance = mean * (1 - mean)
    scale = count - squares / count if count else 0.0
    if scale <= 0 or groups <= parents:
        return STRENGTH[1]
    between = (spread - (groups - parents) * chance) / scale
    if between <= 0:
        return STRENGTH[1]
    return min(max(chance / between - 1, STRENGTH[0]), STRENGTH[1])


def site_priors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, log_odds) per document -> the prior of each site, (host, path, prior), and the global share.

    Sums per site are taken first; hosts, and the three figures of all, are sums of those.
    """
    p = _probability(F.col("log_odds"))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")), "sites")
    hosts = paths.groupBy(F.col("host").alias("of")).agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    total = hosts.agg(F.sum("host_good"), F.sum("host_n"), F.sum(F.col("host_n") * F.col("host_n").cast("double")), F.count(F.lit(1))).first()
    if not total[1]:
        none = [F.lit(0.0).alias(c) for c in ("host_good", "host_n", "host_weight", "path_weight")]
        return paths.select("host", "path", F.lit(0.5).alias("prior"), "good", "n", *none), 0.5
    mean = min(max(total[0] / total[1], SURE), 1 - SURE)
    host_spread = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - mean, 2))).first()[0]
    host_weight = _strength(mean, total[1], total[2], total[3], host_spread, 1)
    both = paths.join(hosts, keys_match([(paths["host"], hosts["of"])]))
    gap = F.pow(F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n"), 2)
    within = both.agg(F.sum(F.col("n") * gap), F.sum(F.pow("n", F.lit(2)) / F.col("host_n")), F.count(F.lit(1))).first()
    # Within hosts, squares are relative to the host: the scale is the count minus their sum.
    path_weight = _strength(mean, total[1], within[1] * total[1], within[2], within[0], total[3])
    host_share = (F.col("host_good") + host_weight * mean) / (F.col("host_n") + host_weight)
    share = (F.col("good") + path_weight * host_share) / (F.col("n") + path_weight)
    sums = ["good", "n", "host_good", "host_n", F.lit(host_weight).alias("host_weight"), F.lit(path_weight).alias("path_weight")]
    return both.select("host", "path", F.least(F.greatest(share, F.lit(SURE)), F.lit(1 - SURE)).alias("prior"), *sums), mean


def _judged(scored: DataFrame) -> DataFrame:
    """(row, host, path, log_odds) -> the same with prior and score; a document's own probability is left out of its prior."""
    priors, mean = site_priors(scored)
    own = _probability(F.col("log_odds"))
    host_share = (F.col("host_good") - own + F.col("host_weight") * mean) / (F.col("host_n") - 1 + F.col("host_weight"))
    share = (F.col("good") - own + F.col("path_weight") * host_share) / (F.col("n") - 1 + F.col("path_weight"))
    site = priors.select(F.col("host").alias("h"), F.col("path").alias("p"), *priors.columns[3:])
    # Null hosts and paths are sites of their own.
    joined = scored.join(site, scored["host"].eqNullSafe(site["h"]) & scored["path"].eqNullSafe(site["p"]), "left")
    prior = F.least(F.greatest(F.coalesce(share, F.lit(mean)), F.lit(SURE)), F.lit(1 - SURE))
    judged = joined.withColumn("prior", prior).drop("h", "p", *priors.columns[3:])
    return judged.withColumn("score", _probability(F.col("log_odds") + _logit(F.col("prior")) - _logit(F.lit(mean))))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of ``docs``: the evidence of its text, the prior of its site, the score and the verdict.

    Result: ``key``, log_odds, prior, score, kept. A null text has the statistics of an empty one. Null hosts and paths are
    sites of their own. Every row gives one row, repeated ones too. Without labels of both kinds all documents get the
    same log odds and are kept if that kind is good, or there is none. An empty table gives no rows. Other columns are not read.
    """
    model, evidence = fitted(docs, labels, sample_rows, key, text)
    rows = with_evidence(docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text")), [evidence])
    scored = stored(rows.select("row.key", "row.host", "row.path", model.log_odds().alias("log_odds")), "scored")
    return _judged(scored).select(F.col("key").alias(key), "log_odds", "prior", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns; a null or empty text counts as ``quality`` says."""
    model, evidence = fitted(docs, labels, sample_rows, key, text)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
    rows = with_evidence(packed, [evidence])
    scored = rows.select("row.row", "row.host", "row.path", model.log_odds().alias("log_odds"))
    return _judged(scored).filter(F.col("score") >= THRESHOLD).select("row.*")
