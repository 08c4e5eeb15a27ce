"""Resharding by minimum-cost flow.

The old shards and their sizes, and the capacities of the new shards, make a
transportation problem; its optimum says how many bytes go from where to where.  Each
old shard is a line of blocks (largest texts first, so that cuts fall among
small ones); the flow cuts the line into intervals, and a document goes where the
middle of it lies.  Only shard sizes (a few numbers a shard) reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def min_cost_flow(supply: list[int], demand: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from i to j at least total cost; supply and demand have the same sum.

    Successive shortest augmenting paths with potentials (Dijkstra) on the bipartite
    network.  Costs must not be negative.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    m, n = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    high = [0] * (m + n)
    while any(left):
        dist, back = [None] * (m + n), [-1] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                dist[i] = -high[i]
                heap.append((dist[i], i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < m:
                steps = ((m + j, cost(u, j)) for j in range(n))
            else:
                steps = ((i, -cost(i, u - m)) for i in range(m) if flow.get((i, u - m)))
            for v, c in steps:
                to = d + c + high[u] - high[v]
                if dist[v] is None or to < dist[v]:
                    dist[v], back[v] = to, u
                    heapq.heappush(heap, (to, v))
        end = min((m + j for j in range(n) if need[j] and dist[m + j] is not None), key=lambda v: dist[v] + high[v])
        for v in range(m + n):
            if dist[v] is not None:
                high[v] += min(dist[v], dist[end])
            else:
                high[v] += dist[end]
        path, v = [], end
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        push = min([left[v], need[end - m], *(flow[y, x - m] for x, y in path if x >= m)])
        for x, y in path:
            if x < m:
                flow[x, y - m] = flow.get((x, y - m), 0) + push
            else:
                flow[y, x - m] -= push
        left[v] -= push
        need[end - m] -= push
    return {k: x for k, x in flow.items() if x}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(
    docs: DataFrame,
    old_shard: Column,
    old_shards: int,
    new_shards: int,
    capacities: list[int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_block: int = 2_000_000,
) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, moved for every row of docs.

    size: UTF-8 bytes of the text plus 8 (a null text has no bytes and the CRC of
    nothing).  A null id and repeated rows are rows like any other; a null old shard, or one that
    is not among them, counts as shard 0; other columns are not looked at; an empty table
    gives no rows.  capacities: bytes of each new shard, equal parts if None; their sum must be
    the sum of the sizes.  Shard i of the new layout stands where the old shard i stood:
    bytes that stay cost nothing.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(old_shard.between(0, old_shards - 1), old_shard).otherwise(0).cast("int").alias("old_shard"),
    )
    sizes = {r["old_shard"]: (r["b"], r["n"]) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    supply = [sizes.get(i, (0, 0))[0] for i in range(old_shards)]
    count = sum(n for _, n in sizes.values())
    plan = min_cost_flow(supply, capacities or equal_capacities(sum(supply), new_shards))
    subs = max(1, -(-count // rows_per_block))
    lines = []
    for i in range(old_shards):
        to = sorted((j for (x, j) in plan if x == i), key=lambda j: (j != i, j))
        cuts, at = [], 0
        for j in to[:-1]:
            at += plan[i, j]
            cuts.append(at)
        lines.append((i, cuts, to or [min(i, new_shards - 1)]))
    # a row for each old shard: bounded by the number of shards, not by the data
    lines = F.broadcast(spark.createDataFrame(lines, "old_shard int, cuts array<bigint>, targets array<int>"))

    rows = rows.withColumn("step", F.floor(F.log2("size") * 2).cast("int")).withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int"))
    block = ["old_shard", "step", "sub"]
    inside = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "text_crc32")
    blocks = rows.groupBy(*block).agg(F.sum("size").alias("bytes"))
    line = Window.partitionBy("old_shard").orderBy(F.desc("step"), "sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("base"))
    placed = (
        rows.withColumn("rank", F.row_number().over(inside).cast("long"))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(blocks, block)
        .join(lines, "old_shard")
        .withColumn("middle", F.col("base") + F.col("upto") - F.floor(F.col("size") / 2))
        .withColumn("shard", F.expr("targets[size(filter(cuts, c -> c <= middle))]"))
        .select("doc_id", "size", "text_crc32", "shard", "rank", *block)
    )
    parts = placed.groupBy("shard", *block).agg(F.count("*").alias("n"), F.min("rank").alias("from"))
    before = Window.partitionBy("shard").orderBy("old_shard", F.desc("step"), "sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", *block, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).alias("shift"))
    return placed.join(parts, ["shard", *block]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("rank") + F.col("shift")).alias("slot"), (F.col("shard") != F.col("old_shard")).alias("moved")
    )


def rewrite(docs: DataFrame, layout: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Writes the shards that gained or lost documents below path (shard=N); returns their numbers.

    Ids must be unique and not null, as the rows are found by them.
    """
    moved = layout.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = sorted(r["shard"] for r in moved.collect())  # as many as there are shards
    rows = docs.join(layout.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col).where(F.col("shard").isin(affected))
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return affected


OLD_SHARDS, NEW_SHARDS = 16, 24


def op1_mincost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie in 16 old shards by source (one of them hot) and go to 24 equal ones."""
    docs = common.table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    out = reshard(docs, old, OLD_SHARDS, NEW_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")
