"""Periodic run detection by online dyadic square catching.

A run is a maximal stretch of words with smallest period q that is at least ``times`` periods and at
least ``least`` words long. Every text is one growing sequence: catchers are kept over its completed
blocks of 1, 2, 4, ... words, each appended word is compared with the two catchers of every size that
its distance fits and moves open suffix comparisons on, and squares that are found merge into runs
(``periodic_kernels.SquareCatchers``). That is O(log n) comparisons a word, whatever the periods.

A map over the documents without a shuffle. Inside a task texts of like length are appended to one
sequence, parted by words that occur once, some ``STREAM_WORDS`` words at a time; a longer text is a
sequence of its own. All counts are exact: names may collide, so every run is compared word by word.

Defined cases: a null or empty text has no words and no runs; null ids, repeated rows and empty tables
need no care (rows are judged one by one); further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from meterfold.llm import periodic_kernels as kernels

TIMES = 4
LEAST = 6
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best (greatest exponent), kept.

    ``kept``: the words joined by single spaces (binary), without those that a run holds after its
    first period.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernels.runs_of(times, least),
        f"doc_id {kind}, n_words long, runs array<{_RUN}>, best {_RUN}, kept binary")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by crc32 of the id) gets a periodic tail.

    Word i >= a becomes word a + (i - a) % p of the text, for an a and a p that the id decides.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("_words"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(
        F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    chosen = (h % 10 == 0) & F.col("text").isNotNull()
    return docs.select("doc_id", "text", F.when(chosen, words).alias("_words")).select(
        "doc_id", F.when(F.coalesce(n, F.lit(0)) > 0, planted).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def run_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, digests of all runs and of the kept words."""
    best = F.col("best")
    return periodic_runs(docs, **options).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))
