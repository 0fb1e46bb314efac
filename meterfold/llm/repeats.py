"""Substring dedup by recompression.

Words get names (64-bit content hashes), and rounds of recompression name runs of one symbol and pairs
of neighbouring symbols by what they are made of, so that equal substrings get equal interior symbols
on every executor without an exchange. Each symbol also knows the range of words its being there
depends on; if that range lies inside a window, the window holds that symbol wherever it occurs.

1. Equal whole texts: the smallest doc_id stands for them; the others, if long enough, are all removed.
2. A Spark round counts the names: a window that repeats in another text has only symbols that two
   texts hold. Every window is stood for by one anchor, its longest certain symbol of the highest
   level it has one of; neighbouring windows share anchors, so a row for some ten words is shuffled.
3. Only windows whose anchor is shared are verified, by two 64-bit hashes of their words: a second
   Spark round finds the smallest doc_id of each window.
4. Words in verified windows are removed, document by document.

Names and windows are combined per task before they are shuffled, and go back to documents by joins
with one unique side, so a passage in a third of all documents is spread over tasks.

Defined cases: a null text has no words; texts shorter than a window stay; rows with the same doc_id
never remove words from one another; rows without a doc_id are returned whole and remove nothing;
further columns are ignored by ``repeat_report``.
"""

from pyspark.sql import DataFrame, functions as F

from meterfold.llm import repeats_kernels as kernels
from meterfold.llm.common import written

WINDOW = 50
DOC = ["doc_id", "text_hash"]


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = kernels.ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by single spaces (kept, binary)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    real = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # The smallest id of equal texts; whole copies need no comparison.
    first = written(real.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(
        F.min("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash")).select(*DOC))
    found = written(real.select("text_hash", "text").mapInArrow(
        kernels.symbols(window, rounds), "name long, text_hash long"))
    shared = found.groupBy("name").agg(
        F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b").select("name")
    names = found.join(shared, "name").groupBy("text_hash").agg(F.collect_set("name").alias("names"))
    asked = written(names.join(first, "text_hash").select(*DOC, "names"))
    windows = written(rows.join(asked, DOC).select(*DOC, "text", "names").mapInArrow(
        kernels.candidates(window, rounds),
        f"h1 long, h2 long, doc_id {kind}, text_hash long, place long"))
    lowest = windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h1", "h2", "low")
    places = windows.join(lowest, ["h1", "h2"]).where(F.col("doc_id") > F.col("low")).groupBy(*DOC).agg(
        F.collect_list("place").alias("places"))
    judged = first.join(places, DOC, "left").withColumn("is_first", F.lit(True))
    whole = rows.join(judged, DOC, "left").select(
        "doc_id", "text", "places",
        (F.col("is_first").isNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).alias("copy"))
    return whole.mapInArrow(
        kernels.removals(window), f"doc_id {kind}, n_words long, n_removed long, kept binary")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return without_repeats(docs, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
