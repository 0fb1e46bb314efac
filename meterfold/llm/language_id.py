"""Language identification by prediction by partial matching.

One byte context tree of order 3 per language is counted over every whole training text (no sample)
and frozen; a text's code length in a language is exact under that tree, with escape probabilities of
method C, and the shortest code names the language. Texts are folded first: lower case, any digit 0.

Counting is one pass: a task sends each (language, context, byte) once, Spark adds them up, and nothing
is pruned. Languages are dealt, in order, to models of at most ``MAX_WIDTH`` languages and ``MAX_CELLS``
costs (leaves times languages; a language whose own tree is larger is a model by itself). One model, the usual case, is a
map over the documents. Several are built and scored one after the other over documents that carry a
row number; every pass writes one row of the best language so far per document, and the least code
length of all passes is joined back, so a task holds one model at a time however many languages there are.

Defined cases: a null text or one without letters is ``und`` with score 0; null ids and null langs are
not trained on; ties go to the first language in order; with no training text all is ``und``;
repeated rows are scored alike; further columns are ignored by ``identify``, kept by ``keep_known``.
The score is the posterior probability of the language under equal priors.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from meterfold.llm import ppm_kernels as kernels
from meterfold.llm.common import fold_of, written

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
MAX_CELLS = 1 << 23
MAX_WIDTH = 16
LEAST_SCORE = 0.5


def count_contexts(training: DataFrame) -> DataFrame:
    """(lang, code, n) over all texts with a language."""
    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return rows.mapInArrow(kernels.count, "lang string, code long, n long").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))


def blocks(counts: DataFrame, max_cells: int = MAX_CELLS):
    """Runs of languages, in order: at most MAX_WIDTH whose models have ``max_cells`` costs (or one language)."""
    out, leaves = [], 0
    for r in counts.groupBy("lang").agg(F.count("*").alias("leaves")).orderBy("lang").collect():
        if out and (len(out) == MAX_WIDTH or (leaves + r.leaves) * (len(out) + 1) > max_cells):
            yield out
            out, leaves = [], 0
        out.append(r.lang)
        leaves += r.leaves
    if out:
        yield out


def model(counts: DataFrame, langs: list):
    """What builds the frozen model of ``langs``, a run of the languages in order, in a task."""
    kept = counts.where(F.col("lang").between(langs[0], langs[-1]) if langs else F.lit(False)).select(
        "lang", "code", "n").toArrow()
    return kernels.maker(langs, pc.index_in(kept["lang"], pa.array(langs, pa.string())).to_numpy(),
                         kept["code"].to_numpy().astype(np.uint32), kept["n"].to_numpy())


def identify(docs: DataFrame, training: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "lang_pred string, score double, bits_per_byte double, bits double"
    counts = written(count_contexts(training))
    runs = list(blocks(counts, max_cells))
    if len(runs) <= 1:
        return docs.select("doc_id", "text").mapInArrow(
            kernels.predict(model(counts, runs[0] if runs else []), UNKNOWN), f"doc_id {kind}, {columns}").drop("bits")
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, (
        written(texts.mapInArrow(kernels.predict(model(counts, run), UNKNOWN), f"doc_id long, {columns}"))
        for run in runs)).withColumnRenamed("doc_id", "row")
    # Equal lengths go to the first language; a pass's score is 2 ** -bits over the sum of its languages.
    met = found.groupBy("row").agg(
        F.min(F.struct("bits", "lang_pred", "bits_per_byte")).alias("best"),
        F.array_sort(F.collect_list(F.struct("bits", "score"))).alias("passes"))
    total = F.aggregate("passes", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]) / x["score"])
    score = F.when(F.col("best.bits").isNull(), 0.0).otherwise(1 / total)
    return rows.select("doc_id", "row").join(met, "row").select(
        "doc_id", "best.lang_pred", score.alias("score"), "best.bits_per_byte")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte; learnt from the folds not held out."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return identify(docs, training_rows(docs)).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is recognised: not ``und``, and a score of at least ``least``."""
    packed = docs.select(F.struct("*").alias("doc_id"), "text")
    found = identify(packed, training_rows(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc_id.*")
