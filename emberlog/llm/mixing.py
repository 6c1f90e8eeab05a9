"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key; the key's leading bits deal a source's
documents into ranges of few documents each, so that a source of any size is
sorted and summed range by range: sums per range, a prefix sum over ranges, and
a running sum inside each range give every document its place in its source.
Where a source's budget ends is then a comparison of a document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Documents that one range holds on average.
RANGE_ROWS = 20_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` of ``sources(source, source_size)``.

    Sources by code point, null last, have the weights in turn.  Targets share
    ``share`` of all sizes by weight; none goes above ``most`` times its source's
    size, and what it leaves is shared among the rest by weight.  Sorted by the
    point at which they are full, the sources that end up full come first: the
    level of the rest is what is left over the weight that is left.  One row per
    source, so these windows are over a table of that size.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    named = sources.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("full"))
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = named.withColumn("ratio", F.col("full") / F.col("w")).withColumns({"level": level, "place": F.row_number().over(by_ratio)})
    # the first source whose own limit is not below the level, and all after it, are not full
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)
    return levels.withColumn("found", found).select(
        "source", "source_size", F.least("full", F.coalesce(F.col("found.level") * F.col("w"), F.col("full"))).alias("target")
    )


def random_keys(columns: list[str]) -> list[Column]:
    """Two numbers of 60 bits from the MD5 of a row's columns."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x02")) for c in columns]
    digest = F.md5(F.concat_ws("\x01", F.lit("mix"), *cells).cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def mix(docs: DataFrame, size: Column, source: str = "source", keep: list[str] | None = None, range_rows: int = RANGE_ROWS, **targets) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``; ``keep`` names the columns that stay, if not all.

    ``taken`` is how much of the document the mix takes: its size once per whole
    epoch that the source's target holds, and once more if it lies, in hash-random
    order, before the point where the rest of the target ends.  A document that
    straddles that point is in if at least half of it lies before.  The order is
    that of hashes of all columns.

    Null sizes count 0; documents of size 0 take 0.  A null source is a source of
    its own.  Null and repeated doc_ids are rows like any other, and every row
    comes out once: of fully equal rows as many are taken as fit, whichever they
    are.  Reruns agree, whatever the partitions.  Columns of the four names are
    replaced.  An empty table gives no rows.
    """
    own = {"size": F.coalesce(size, F.lit(0)).cast("long"), **{f"__key{n}": k for n, k in enumerate(random_keys(docs.columns))}, "__of": F.col(source)}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    sized = materialize(docs.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(n) for n, c in own.items())), "sized")
    rows = sized.count()
    bits = max(8, (rows // range_rows).bit_length())
    ranged = sized.withColumn("__range", F.shiftright("__key0", 60 - bits))
    # sums per range; at most 2^bits rows per source
    sums = materialize(ranged.groupBy(F.col("__of").alias("source"), F.col("__range").alias("range")).agg(F.sum("size").alias("range_size")), "ranges")
    goals = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), **targets)
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("range_size").over(over), F.lit(0)))
    starts = starts.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "range_size")
    starts = starts.select(F.col("source").alias("__source"), F.col("range").alias("__at"), F.col("start").alias("__start"), "source_size", "target")
    placed = ranged.join(materialize(starts, "starts"), F.col("__of").eqNullSafe(F.col("__source")) & (F.col("__range") == F.col("__at")))
    inside = Window.partitionBy("__of", "__range").orderBy("__key0", "__key1").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    again = (begin + F.col("size") / 2 <= rest).cast("long")
    return placed.select(*(F.col(f"`{c}`") for c in keep), "size", "source_size", "target", (F.col("size") * (epochs + again)).alias("taken"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, word_count(F.col("text")), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix' || chr(1) || coalesce(doc_id::VARCHAR, chr(2)) || chr(1) || coalesce(source, chr(2)) || chr(1) || coalesce(text, chr(2))) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS "full" FROM sources
), levels AS (
  SELECT *, "full" / w AS ratio, row_number() OVER by_ratio AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum("full") OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW by_ratio AS (ORDER BY "full" / w, source NULLS LAST)
), goals AS (
  SELECT source, source_size, least("full", coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= ratio) * w, "full")) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN start + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
