"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A run holds one row per line key: 128 bits of hash, the number of documents that
have it and the largest doc_id among them.  Runs are bucketed and sorted by hash
when they are written, so that whatever joins them reads them as they lie, without a
shuffle.  Each batch of documents is merge-anti-joined with the runs: keys not seen
before become a run of level 0, keys seen before a row that adds to their counts.
When a level holds ``fanout`` runs, they are merged into one run of the next level.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import application_dir, materialize, table

SPACE = " \t\n\x0b\x0c\r"
BATCHES, FANOUT = 4, 3
#: Lines that one bucket of a run is made for, and the fewest buckets.
BUCKET_LINES, LEAST_BUCKETS = 2_000_000, 8
HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, in order: stripped, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(low, "\n", -1), lambda line: F.trim(line, F.lit(SPACE)))


def key_hash(key: Column) -> list[Column]:
    """128 bits: two XXH64 of the key, from seeds that do not depend on it."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs in the shared folder, ``h1, h2, docs, last`` each; a key is in one run only."""

    def __init__(self, spark: SparkSession, buckets: int = LEAST_BUCKETS, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.folder = f"{application_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[DataFrame]] = []
        #: What later batches add to the counts of keys of the runs.
        self.more: list[DataFrame] = []

    def _written(self, run: DataFrame) -> DataFrame:
        """``run`` in buckets by hash, sorted; its name in the catalog goes at once, the files stay."""
        name = f"emberlog_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs as one, bucket by bucket: full outer joins of what lies sorted already."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.alias("a").join(b.alias("b").hint("merge"), HASH, "full")
            docs = F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))
            return joined.select(*HASH, docs.alias("docs"), F.greatest("a.last", "b.last").alias("last"))

        return reduce(both, runs)

    def add(self, lines: DataFrame) -> None:
        """Add a batch ``lines(doc_id, h1, h2)``; no document may be in two batches."""
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        keys = once.groupBy("h1", "h2").agg(F.count("one").alias("docs"), F.max("doc_id").alias("last"))
        batch = self._written(keys.repartition(self.buckets, "h1", "h2"))
        if any(self.levels):
            fresh = self._written(self.unseen(batch))
            self.more.append(self._written(batch.join(fresh.hint("merge"), HASH, "left_anti")))
            batch = fresh
        self._place(batch, 0)
        if len(self.more) >= self.fanout:
            self.more = [self._written(self._merged(self.more))]

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._place(self._written(self._merged(merged)), level + 1)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Rows of ``lines(h1, h2, ...)`` whose key is in no run, by merge-anti-joins."""
        for run in (r for level in self.levels for r in level):
            lines = lines.join(run.hint("merge"), HASH, "left_anti")
        return lines

    def often(self, least: int) -> DataFrame:
        """Keys of at least so many documents, with the largest of them."""
        found = self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        for run in (r for level in self.levels for r in level):
            for more in self.more:
                added = more.select(*HASH, F.col("docs").alias("again"), F.col("last").alias("later"))
                run = run.join(added.hint("merge"), HASH, "left")
                run = run.select(*HASH, (F.col("docs") + F.coalesce("again", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))
            found = found.union(run.where(F.col("docs") >= least))
        return found


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped``.

    A line whose key has at least ``min_chars`` code points and occurs in at least
    ``min_docs`` documents stays only in the largest doc_id that holds it; there,
    all its lines stay.

    A null or empty text is one empty line and becomes an empty text.  Rows that
    repeat a doc_id are one document for the count, and each keeps its row.  A
    null doc_id is a document below all others.  Texts are whole at any length.
    Columns named ``n_lines`` or ``n_dropped`` are replaced, others are kept; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), line_keys(F.col(text)).alias("keys"))
    lines = rows.select("doc_id", "row", F.posexplode("keys").alias("pos", "key")).where(F.char_length("key") >= min_chars)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    path = f"{application_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = lines.select("doc_id", "row", "pos", *key_hash(F.col("key")), batch)
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    # a batch is a folder: its scan reads no other
    lines = spark.read.schema("doc_id long, row long, pos int, h1 long, h2 long, batch long").parquet(path)
    runs = LineRuns(spark, max(LEAST_BUCKETS, -(-lines.count() // BUCKET_LINES)))
    for n in range(batches):
        runs.add(lines.where(F.col("batch") == n).select("doc_id", "h1", "h2"))
    often = materialize(runs.often(min_docs).select("h1", "h2", "last"), "often")
    hit = lines.join(often, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    hit = hit.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("__dropped"))
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "__dropped")

    kept = docs.withColumns({"__row_": F.xxhash64(body)})
    kept = kept.join(hit, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__row_") == F.col("__row")), "left")
    parts, none = F.split(body, "\n", -1), F.array().cast("array<int>")
    begins = F.concat(F.array(F.lit(0)), F.transform("__dropped", lambda p: p + 1))
    ends = F.concat(F.col("__dropped"), F.array(F.size(parts)))
    left = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(parts, b + 1, e - b)))
    whole = F.col("__dropped").isNull()
    return kept.withColumns(
        {
            "n_lines": (F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"))) + 1).cast("long"),
            "n_dropped": F.size(F.coalesce("__dropped", none)).cast("long"),
            text: F.when(whole, body).otherwise(F.array_join(left, "\n")),
        }
    ).drop("__id", "__row", "__row_", "__dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM parts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.doc_id, line, pos, coalesce(keyed.doc_id <> last, false) AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
