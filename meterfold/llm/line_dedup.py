"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

Every batch of documents is reduced to one row per line key (two 64-bit hashes, the number of
documents, the largest doc_id) and merge-anti-joined with the runs already stored. Keys that no run
holds are new: they form the batch's own run, so every key is new in exactly one run. The others are
stored beside them as repeats. A key's total is its one new row plus the sum of its repeats; keys
without repeats, nearly all, enter no sum. Runs are bucketed by the key hash and sorted inside each
bucket, so a join with them shuffles only the new batch; the bucket count follows the number of
lines. When a level holds ``fanout`` runs they are merged into one run of the next level: new rows
are put together, repeats summed, and a row is rewritten once per level.

Everything is DataFrame functions; a line that a third of all documents hold is one row per task
after the partial aggregation, and the join of line occurrences with the dropped keys is a
sort-merge join with a unique side, which adaptive execution splits.

Defined cases: a null or empty text is one empty line; rows with the same doc_id and text count as
one document; rows without a doc_id are returned whole, their lines neither count nor go; further
columns are ignored by ``line_report`` and kept by ``dedup_lines``.
"""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterfold.llm.common import BLANKS, ascii_lower, written
from meterfold.session import scratch_root

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 4
BUCKET_LINES = 8_000_000  # lines of a batch a bucket is meant for: some 250 MB before they are summed
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs of (h1, h2, n_docs, last_doc, is_new), level by level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, lines: int = 0):
        """``lines``: about how many lines one batch has; more of them make more buckets."""
        self.spark, self.fanout = spark, fanout
        self.root = scratch_root(spark)
        self.buckets = min(
            max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES)),
            int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        self.levels: list[list[str]] = []

    @property
    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _store(self, rows: DataFrame) -> str:
        """``rows``, dealt by ``_dealt``, as a bucketed and sorted table."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *KEY)

    def _union(self, names: list[str]) -> DataFrame:
        # Computed keys: a union of bucketed scans is taken for bucketed, but reads them one after
        # another, so a sum over it without a shuffle would leave a key in several rows.
        runs = [self.spark.table(name).withColumns({k: F.coalesce(k, F.lit(0)) for k in KEY}) for name in names]
        return reduce(DataFrame.unionByName, runs)

    def _new(self, name: str) -> DataFrame:
        return self.spark.table(name).where("is_new")

    def merged(self) -> DataFrame | None:
        """One row per key over all runs: its new row and the sum of its repeats."""
        if not self.names:
            return None
        again = self._union(self.names).where("NOT is_new").groupBy(*KEY).agg(
            F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        totals = [self._new(name).join(again, KEY, "left").select(
            *KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"),
            F.greatest("last_doc", "later").alias("last_doc")) for name in self.names]
        return reduce(DataFrame.unionByName, totals)

    def marked(self, batch: DataFrame) -> DataFrame:
        """An aggregated batch with ``is_new``: no run holds the key. One merge join per run."""
        held = []
        for i, name in enumerate(self.names):
            held.append(F.col(f"_in{i}").isNotNull())
            batch = batch.join(self._new(name).select(*KEY, F.lit(True).alias(f"_in{i}")), KEY, "left")
        is_new = ~reduce(Column.__or__, held) if held else F.lit(True)
        return batch.withColumn("is_new", is_new).drop(*[f"_in{i}" for i in range(len(held))])

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Keys of an aggregated batch that no run holds yet."""
        return self.marked(batch).where("is_new").drop("is_new")

    def add(self, occurrences: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id) occurrences: its new keys as a run, the others as repeats."""
        own = occurrences.distinct().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._push(0, self._store(self.marked(self._dealt(own))))

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._dealt(self._union(old)).groupBy(*KEY, "is_new").agg(
                F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
            self._push(level + 1, self._store(merged.select(*KEY, "n_docs", "last_doc", "is_new")))
            for table in old:
                self.spark.sql(f"DROP TABLE {table}")

    def close(self) -> None:
        """Forget the table names; the files stay with the scratch folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def occurrences(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(batch, doc_id, text_hash, pos, h1, h2) of every line whose key is long enough."""
    doc = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))))
    key = doc.select("doc_id", "text_hash", "pos", line_key(F.col("col")).alias("key"))
    return key.where(F.length("key") >= min_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


def split_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, _lines and the sorted positions ``_gone`` of lines to drop."""
    spark = docs.sparkSession
    found = written(occurrences(docs, min_chars, batches), "batch")
    runs = LineRuns(spark, lines=found.count() // batches)
    for b in range(batches):
        runs.add(found.where(F.col("batch") == b).select(*KEY, "doc_id"))
    frequent = written(
        runs.merged().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"))
    runs.close()
    gone = found.join(frequent, KEY).where(F.col("doc_id") != F.col("last_doc")).groupBy(
        "doc_id", "text_hash").agg(F.array_sort(F.collect_list("pos")).alias("_gone"))
    texts = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_doc") if keep else F.lit(None).alias("_doc"),
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        lines_of(F.col("text")).alias("_lines"))
    return texts.join(gone, ["doc_id", "text_hash"], "left")


def kept_text(lines: str = "_lines", gone: str = "_gone") -> Column:
    """The lines that stay, joined; positions are subtracted as hash sets, in linear time."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_except(places, gone), lambda i: F.get(F.col(lines), i))
    return F.when(F.col(gone).isNull(), F.array_join(F.col(lines), "\n")).otherwise(
        F.array_join(kept, "\n"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    rows = split_lines(docs, **options)
    return rows.select(
        "doc_id", F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with their repeated lines removed; ``n_chars`` follows the text."""
    rows = split_lines(docs, keep=docs.columns, **options).withColumn("_text", kept_text())
    gone = F.col("_gone").isNotNull()
    columns = []
    for c in docs.columns:
        value = F.col("_doc").getField(c)
        if c == "text":
            value = F.when(gone, F.col("_text")).otherwise(value)
        elif c == "n_chars":
            value = F.when(gone, F.length("_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return rows.select(*columns)
