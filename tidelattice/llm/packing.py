"""Optimal length buckets and token-budget batches.

The boundaries come from an exact dynamic program over the global length histogram;
the documents of a bucket are dealt to batches whose padded size stays within the budget.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Upper ends of at most so many buckets with the least padding, and that padding.

    lengths ascending.  Padding of a bucket: sum of (upper end - length).  For each
    number of buckets the best split is a lower envelope of lines with falling
    slopes asked at rising lengths, so a layer takes linear time; whole numbers only.
    """
    n = len(lengths)
    if not n:
        return [], 0
    c, s = [0], [0]
    for x, k in zip(lengths, counts, strict=True):
        c.append(c[-1] + k)
        s.append(s[-1] + x * k)
    best = [0] + [lengths[j - 1] * c[j] - s[j] for j in range(1, n + 1)]
    come: list[list[int]] = []
    for _ in range(1, min(buckets, n)):
        layer, from_, hull = [0] * (n + 1), [0] * (n + 1), []
        at = 0

        def value(i: int, x: int) -> int:
            return best[i] + s[i] - x * c[i]

        def useless(i: int, j: int, k: int) -> bool:
            # line j is nowhere below both of i and k; slopes fall strictly
            bi, bj, bk = best[i] + s[i], best[j] + s[j], best[k] + s[k]
            return (bk - bi) * (c[j] - c[i]) <= (bj - bi) * (c[k] - c[i])

        for j in range(1, n + 1):
            while len(hull) >= 2 and useless(hull[-2], hull[-1], j - 1):
                hull.pop()
            hull.append(j - 1)
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and value(hull[at + 1], x) <= value(hull[at], x):
                at += 1
            i = hull[at]
            layer[j], from_[j] = value(i, x) + x * c[j] - s[j], i
        come.append(from_)
        best = layer
    ends, j = [], n
    for from_ in reversed(come):
        ends.append(lengths[j - 1])
        j = from_[j]
        if not j:
            break
    if j:
        ends.append(lengths[j - 1])
    return sorted(ends), best[n]


def pack(
    docs: DataFrame,
    length: Column,
    buckets: int = 8,
    budget: int = 65_536,
    id_col: str = "doc_id",
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """docs with n_tokens, bucket, padded_to, batch and place added, under names that replace equal ones.

    A batch is a bucket's next floor(budget / padded_to) documents (one, if a
    document alone is over the budget), in an order by a hash of the id.  Documents
    of length 0, or null, form buckets like others; an empty table gives no rows.  Null ids and
    repeated rows are rows like any other.
    The driver holds the histogram: one entry for each distinct length.
    """
    spark = docs.sparkSession
    added = ["n_tokens", "bucket", "padded_to", "batch", "place"]
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"))
    histogram = sorted((r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    ends, _ = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    count = sum(n for _, n in histogram)
    filled = [0] * len(ends)
    for x, n in histogram:
        filled[bisect_left(ends, x)] += n
    subs = max(1, -(-count // rows_per_block))
    if not ends:
        ends = [0]
    bounds = F.array(*[F.lit(x).cast("long") for x in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda x: x < F.col("n_tokens"))).cast("int"))
    rows = rows.withColumn("padded_to", F.element_at(bounds, F.col("bucket") + 1))
    # global rank in a bucket: counts of the hash cells before, plus the rank in the cell
    rows = rows.withColumn("_key", F.xxhash64(F.col(f"`{id_col}`"))).withColumn("_cell", F.pmod(F.shiftright("_key", 20), F.lit(subs)))
    cell = Window.partitionBy("bucket", "_cell").orderBy("_key", f"`{id_col}`")
    counted = rows.groupBy("bucket", "_cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("bucket", "_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_rank", F.row_number().over(cell)).join(counted, ["bucket", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1)
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1)))).cast("long")
    return rows.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "bucket", "padded_to", F.floor(F.col("_rank") / fit).alias("batch"), F.pmod("_rank", fit).cast("int").alias("place"))


def word_count(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none in a null."""
    trimmed = F.regexp_replace(F.col(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    # the texts are read once; what follows needs their lengths alone
    rows = common.stored(docs.select("doc_id", word_count().cast("long").alias("words")))
    return pack(rows, F.col("words")).select("doc_id", "n_tokens", "bucket", "padded_to", "batch", "place")
