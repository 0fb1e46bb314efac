"""Toxicity by a weighted lexicon: Aho-Corasick over folded texts, exception phrases, length.

The lexicon is learnt from labels: a word belongs to it when the documents that hold it are toxic far
more often than others (likelihood-ratio test), where support is the number of different neighbour
pairs it has in toxic documents, so that copies of one toxic passage do not make its other words
toxic. Its weight is the log of the ratio of rates. Two-word phrases around a lexicon word that occur
in clean documents and in no toxic one are exceptions: matches inside them do not count.

Texts are folded (NFKC, lower case, look-alike letters, digits for letters, hidden signs) and cut at
everything that is no letter or digit. The sum of the weights of all matches is divided by the
logarithm of the number of words; a logistic curve over it gives the score.

Lexicon and curve are fitted on at most ``SAMPLE`` labelled documents per label, those with the
smallest id hashes (a classifier's bounded sample); scoring maps over all documents, whole texts.

Defined cases: null or empty texts score the curve at zero; null ids are scored and not trained on;
several labels of one document count as toxic if any is; null labels are ignored; without a toxic and
a clean label every score is 0; repeated rows are scored alike; further columns are ignored.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from meterfold.llm import toxicity_kernels as kernels
from meterfold.llm.common import fold_of, written

FOLDS, HELD_OUT = 5, 0
SAMPLE = 10_000
SPREAD = 64
LEAST_EVIDENCE = 30.0
LEAST_SUPPORT = 4
LEAST_WEIGHT = 3.0


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled training documents per label, one text per id."""
    given = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy(
        "doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64(F.lit(7), "doc_id"), "doc_id"]
    parts = [given.where(F.col("toxic") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    # At most 2 * sample ids, whatever the size of the tables. Rows that repeat an id count once.
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(
        first.alias("first"), F.first("toxic").alias("toxic")).select("first.text", "toxic")


def _evidence(clean: Column, toxic: Column, n_clean: float, n_toxic: float) -> Column:
    """Likelihood-ratio statistic of a word's document counts against equal rates."""
    rate = (clean + toxic) / F.lit(n_clean + n_toxic)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    inside = part(clean, rate * n_clean) + part(toxic, rate * n_toxic)
    outside = part(n_clean - clean, (1 - rate) * n_clean) + part(n_toxic - toxic, (1 - rate) * n_toxic)
    return 2 * (inside + outside)


def learn(sample: DataFrame) -> dict:
    """Weights, exceptions and curve from labelled (text, toxic) rows; a bounded model."""
    sample = written(sample.repartition(SPREAD))
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = {"weights": {}, "exceptions": [], "intercept": -30.0, "slope": 0.0}
    if not n.get(0) or not n.get(1):
        return model
    # Different neighbour pairs are counted in two steps, each combined in the tasks first: however common
    # a word is, no row holds its pairs.
    counted = sample.mapInArrow(kernels.word_counts, "word string, pair long, clean long, toxic long")
    words = counted.groupBy("word", "pair").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).groupBy(
        "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("pair").alias("pairs"))
    words = words.withColumn("support", F.least("toxic", "pairs").cast("double"))
    clean = F.col("clean").cast("double")
    weight = F.log((F.col("support") + 0.5) / (n[1] + 1)) - F.log((clean + 0.5) / (n[0] + 1))
    lexicon = words.where(
        (F.col("support") >= LEAST_SUPPORT) & (weight >= LEAST_WEIGHT)
        & (_evidence(clean, F.col("support"), float(n[0]), float(n[1])) >= LEAST_EVIDENCE)
    ).select("word", weight.alias("weight")).orderBy("word").collect()
    model["weights"] = {r.word: r.weight for r in lexicon}
    phrases = sample.mapInArrow(kernels.phrase_counts(list(model["weights"])), "phrase string, toxic int")
    model["exceptions"] = [r.phrase for r in phrases.groupBy("phrase").agg(
        F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).where(
        (F.col("toxic") == 0) & (F.col("n") >= 3)).orderBy("phrase").collect()]
    points = sample.mapInArrow(
        kernels.measured(model["weights"], model["exceptions"]), "x double, toxic int").groupBy(
        F.round("x", 3).alias("x"), "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x, y = points["x"].to_numpy(float), points["toxic"].to_numpy(float)
    a = kernels.fit(x, y, points["n"].to_numpy(float))
    return model | {"intercept": float(a[0]), "slope": float(a[1])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, weight_sum of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernels.scores(**model), f"doc_id {kind}, score double, weight_sum double")


def toxicity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, weight_sum."""
    scored = score(docs, learn(labelled_sample(docs, labels, sample)))
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight_sum")
