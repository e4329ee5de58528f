"""Statistics, decision lists and the site-wise classifier."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelinekit.llm.quality import good_documents, quality
from pipelinekit.llm.quality_rules import Condition, covers, learn, learned, quality_rules
from pipelinekit.llm.statistics import FEATURES


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered)


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose is good, shouting and symbols are bad; ids 0 to 599, one junk host."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(55, 120))]
        junk = i % 6 == 0
        if junk:
            words = [w.upper() + "!!" if i % 12 else w + "$$$" for w in words]
        docs.append((i, " ".join(words), "en", "junk" if junk and i % 4 else f"s{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    labels += [(None, 0, 0), (5, None, None), (10**9, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_and_base_rules(documents, texts, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(documents, labels).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t in texts:
        n, chars, symbols, lines, repeated = counted(t)
        failed = n < 50 or 100 * repeated > 50 * n
        want[i, n, chars, symbols, lines, repeated, failed, not failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def test_rules_are_learned_pruned_and_ordered():
    rng = np.random.default_rng(0)
    table = rng.random((900, len(FEATURES)))
    bad = (table[:, 1] > 0.8) & (table[:, 3] <= 0.5) | (table[:, 5] > 0.9)
    rules = learn(table, bad)
    assert 1 < len(rules) <= 12
    first = np.zeros(len(table), bool)
    for rule in rules:
        first |= covers(rule, table)
    assert (first & bad).sum() > 0.9 * bad.sum()
    assert (first & ~bad).sum() <= 0.03 * (~bad).sum()
    assert learn(table, np.zeros(900, bool)) == [] == learn(table[:0], bad[:0])
    assert learn(table, np.ones(900, bool)) == []
    assert covers((Condition("symbol_rate", True, 0.5),), table).sum() == (table[:, 1] > 0.5).sum()


def test_rules_reject_junk_and_keep_prose(labelled):
    docs, labels = labelled
    got = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert [got[i] for i in range(600) if i % 6 == 0].count(False) >= 95
    assert all(got[i] for i in range(600) if i % 6)
    assert learned(docs, labels, 200) and len(learned(docs, labels, 0)) == 0


def test_classifier_on_held_out_documents(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(got) == 600
    held_out = [i for i in range(600) if i % 2]
    assert all(got[i].kept for i in held_out)
    assert not any(got[i].kept for i in range(0, 600, 6))
    junk, fine = next(r for i, r in got.items() if i % 6 == 0 and i % 4), got[1]
    assert junk.prior < fine.prior
    kept = good_documents(docs.withColumn("row", F.lit("x")).withColumn("host", F.lit("y")), labels)
    assert kept.columns == [*docs.columns, "row", "host"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_sites_shrink_by_their_size(spark):
    from pipelinekit.llm.quality import site_priors

    rows = [("a", "x", 4.0)] * 300 + [("b", "x", -4.0)] * 300 + [("c", "x", -4.0)] * 2 + [(None, None, 4.0)] * 3
    priors, mean = site_priors(spark.createDataFrame(rows, "host string, path string, log_odds double"))
    got = {r.host: r.prior for r in priors.collect()}
    assert got["b"] < 0.1 < 0.9 < got["a"]
    assert got["b"] < got["c"] < mean < got[None] < got["a"]


def test_awkward_rows(documents, nothing, texts, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        assert quality(documents, labels).count() == quality_rules(documents, labels).count() == len(texts)
        assert quality(nothing, labels).count() == quality_rules(nothing, labels).count() == good_documents(nothing, labels).count() == 0
    assert good_documents(documents, some).columns == documents.columns


def test_toxic_documents_are_not_good(spark):
    """Told by their words alone: held-out toxic documents go, clean ones stay."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(600):
        body = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(40, 120))]
        toxic = i % 7 == 0
        for at in rng.sample(range(len(body)), 5 if toxic else 0):
            body[at] = rng.choice(["nasty", "Vile!", "awful", "rotten"])
        docs.append((i, " ".join(body), "en", f"s{i % 5}"))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    got = quality(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held_out = [r for r in got if r.doc_id % 2 == 0]
    assert sum(r.kept for r in held_out if r.doc_id % 7 == 0) <= 2
    assert sum(not r.kept for r in held_out if r.doc_id % 7) <= 5


def test_scores_by_the_formula(spark):
    """Priors of sites and scores, a document's own probability left out, against plain arithmetic."""
    from pipelinekit.llm import quality as Q

    rng = random.Random(3)
    rows = [(i, f"h{min(i % 9, 3)}", rng.choice(["p", "q", None]), rng.uniform(-3, 4)) for i in range(400)] + [(400, "lone", "x", 1.0)]
    got = {r.key: r for r in Q._judged(spark.createDataFrame(rows, "key int, host string, path string, log_odds double")).collect()}
    p = {i: 1 / (1 + math.exp(-x)) for i, _, _, x in rows}
    mean = sum(p.values()) / len(p)
    host, site = {}, {}
    for i, h, q, _ in rows:
        host.setdefault(h, []).append(p[i])
        site.setdefault((h, q), []).append(p[i])
    total, chance = len(rows), mean * (1 - mean)

    def strength(scale, groups, spread, parents):
        if scale <= 0 or groups <= parents:
            return Q.STRENGTH[1]
        between = (spread - (groups - parents) * chance) / scale
        return Q.STRENGTH[1] if between <= 0 else min(max(chance / between - 1, Q.STRENGTH[0]), Q.STRENGTH[1])

    average = lambda values: sum(values) / len(values)
    squares = sum(len(v) ** 2 for v in host.values())
    host_weight = strength(total - squares / total, len(host), sum(len(v) * (average(v) - mean) ** 2 for v in host.values()), 1)
    within = sum(len(v) * (average(v) - average(host[h])) ** 2 for (h, _), v in site.items())
    path_weight = strength(total - sum(len(v) ** 2 / len(host[h]) for (h, _), v in site.items()), len(site), within, len(host))
    for i, h, q, x in rows:
        of_host = (sum(host[h]) - p[i] + host_weight * mean) / (len(host[h]) - 1 + host_weight)
        prior = (sum(site[h, q]) - p[i] + path_weight * of_host) / (len(site[h, q]) - 1 + path_weight)
        score = 1 / (1 + math.exp(-(x + math.log(prior / (1 - prior)) - math.log(mean / (1 - mean)))))
        assert math.isclose(got[i].prior, prior, rel_tol=1e-9) and math.isclose(got[i].score, score, rel_tol=1e-9)
    assert math.isclose(got[400].prior, mean, rel_tol=1e-6)
