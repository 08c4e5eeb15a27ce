"""What the two similarity joins share: blocks of records that may link, and DivideSkip inside them.

Records meet through keys.  Two rounds of least neighbours name a label for what lies close together; a label is a block, or
several of at most BLOCK records.  Wherever a key has records in one block or in two, these meet in a cell of that block or
pair of blocks, with their whole sets.  A cell holds two blocks of records at most, so that a key or a group of near copies
of any size is spread over many cells, and no pair of records is ever a row.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textvec as tv

#: Records of a block.
BLOCK = 256
#: The constant that weighs probing a long list against merging it.
MU = 0.0085


def merge_skip(lists: list[list[int]], need: int):
    """(id, occurrences) of the ids that are in `need` or more of the ascending lists, by a heap that skips what can't reach it."""
    k = len(lists)
    at = [0] * k
    heap = [x[0] * k + i for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0] // k
        popped = []
        while heap and heap[0] // k == top:
            popped.append(heapq.heappop(heap) % k)
        if len(popped) >= need:
            yield top, len(popped)
            to = top + 1
        else:  # the lists that have the need - 1 least ids can't make a result before the next one's id
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap) % k)
            if not heap:
                return
            to = heap[0] // k
        for i in popped:
            x = lists[i]
            at[i] = j = bisect_left(x, to, at[i])
            if j < len(x):
                heapq.heappush(heap, x[j] * k + i)


class Index:
    """The inverted lists of some records; a record is an array of distinct keys."""

    def __init__(self, records: list[np.ndarray]):
        self.n = len(records)
        self.size = np.array([len(x) for x in records], np.int64)
        every = np.concatenate(records) if records else np.zeros(0, np.uint64)
        self.names, key = np.unique(every, return_inverse=True)
        self.entries = np.sort(key * self.n + np.repeat(np.arange(self.n), self.size))
        self.length = np.bincount(key, minlength=1)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.held: dict[int, list[int]] = {}

    def list_of(self, key: int) -> list[int]:
        if key not in self.held:
            self.held[key] = (self.entries[self.first[key] : self.first[key + 1]] - key * self.n).tolist()
        return self.held[key]

    def search(self, query: np.ndarray, least: int, alone: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(records, overlap): all records that share `least` keys or more with the query; lists of up to `alone` records are its own.

        The lists of the query's keys are ordered by length.  The L longest are only probed, the others merged: a result is
        in least - L of those at least.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.names):
            return none
        keys = np.minimum(np.searchsorted(self.names, query), len(self.names) - 1)
        keys = keys[self.names[keys] == query]
        keys = keys[np.argsort(self.length[keys], kind="stable")]
        if int((self.length[keys] > alone).sum()) < least:
            return none
        n_long = min(least - 1, int(least / (MU * np.log2(max(2, int(self.length[keys[-1]]))) + 1)))
        short, long_ = keys[: len(keys) - n_long], keys[len(keys) - n_long :]
        found = list(merge_skip([self.list_of(k) for k in short.tolist()], least - n_long))
        if not found:
            return none
        ids, n = np.array(found, np.int64).T
        step = max(1, (1 << 21) // max(1, n_long))
        for a in range(0, len(ids) if n_long else 0, step):
            want = (long_[:, None] * self.n + ids[None, a : a + step]).ravel()
            place = np.minimum(np.searchsorted(self.entries, want), len(self.entries) - 1)
            n[a : a + step] += (self.entries[place] == want).reshape(n_long, -1).sum(axis=0)
        enough = n >= least
        return ids[enough], n[enough]


def searches(records: list[np.ndarray], side: np.ndarray | None, least: Callable[[int], int]):
    """(q, ids, overlap): for each record q of a cell those it shares least(q's size) keys or more with, each pair once."""
    held = np.arange(len(records)) if side is None else np.flatnonzero(~side)
    index = Index([records[i] for i in held.tolist()])
    for q in range(len(records)) if side is None else np.flatnonzero(side).tolist():
        ids, n = index.search(records[q], least(len(records[q])), 1 if side is None else 0)
        ids = held[ids]
        if side is None:
            later = ids > q
            ids, n = ids[later], n[later]
        yield q, ids, n


class Roots:
    """Connected groups of the records of a cell."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.groups = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.groups -= 1


def blocks(postings: DataFrame) -> DataFrame:
    """(id, block) of the ids of postings (key, id)."""
    least = postings.groupBy("key").agg(F.min("id").alias("m"))
    label = postings.join(least, "key").groupBy("id").agg(F.min("m").alias("label"))
    least = postings.join(label, "id").groupBy("key").agg(F.min("label").alias("m"))
    label = common.stored(postings.join(least, "key").groupBy("id").agg(F.min("m").alias("label")))
    parts = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return label.join(parts, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def cells(postings: DataFrame) -> DataFrame:
    """(cell, id, side): who meets where; side is null in a block's own cell, else which of the two blocks the id is of."""
    own = common.stored(blocks(postings))
    p = common.stored(postings.join(own, "id"))
    torn = p.groupBy("key").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x < y").select("key")
    p = p.join(torn, "key")
    other = p.select("key", F.col("block").alias("other")).distinct()
    cross = p.join(other, "key").where("block <> other").select("id", "block", "other").distinct()
    cross = cross.select(F.xxhash64(F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "id", (F.col("block") < F.col("other")).alias("side"))
    return own.select(F.col("block").alias("cell"), "id", F.lit(None).cast("boolean").alias("side")).unionByName(cross)


def split(members: DataFrame) -> DataFrame:
    """(cell, id, side) with at most BLOCK records of a side in a cell, from cells of any size; side is null where all meet all.  Cells that lack a side go."""
    parts = members.groupBy("cell", "side").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    of = parts.groupBy("cell").agg(F.max(F.when(~F.col("side"), F.col("parts"))).alias("zero"), F.max(F.when(F.col("side"), F.col("parts"))).alias("one"), F.max(F.when(F.col("side").isNull(), F.col("parts"))).alias("all"))
    of = of.where("all is not null or (zero is not null and one is not null)")
    x = members.join(of, "cell")
    few = F.coalesce(F.greatest("all", "zero", "one"), F.lit(1)) == 1
    small, x = x.where(few).select("cell", "id", "side"), x.where(~few)
    own = F.pmod(F.xxhash64("id"), F.coalesce("all", F.when(F.col("side"), F.col("one")).otherwise(F.col("zero"))))
    x = x.withColumn("own", own.cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("all", F.when(F.col("side"), F.col("zero")).otherwise(F.col("one"))) - 1))
    x = x.withColumn("other", other)
    whole = F.col("side").isNull()
    low = F.when(whole, F.least("own", "other")).when(F.col("side"), F.col("other")).otherwise(F.col("own"))
    high = F.when(whole, F.greatest("own", "other")).when(F.col("side"), F.col("own")).otherwise(F.col("other"))
    side = F.when(~whole, F.col("side")).when(F.col("own") != F.col("other"), F.col("own") < F.col("other"))
    return small.unionByName(x.select(F.xxhash64("cell", low, high).alias("cell"), "id", side.alias("side")))


#: Records of the cells that are solved at once, and bytes of their payloads.
BATCH, BATCH_BYTES = 4096, 1 << 20


def meet(members: DataFrame, records: DataFrame, solve: Callable) -> DataFrame:
    """(id, root, links): what solve says of each cell, (cell, id, side) in members, over records (id, weight, payload).

    solve takes a list of cells, each a list of payloads, an array of weights and an array of sides (or None), and gives for
    each cell the records' roots (places in the cell) and links.  Records without links give no row.
    """

    def run(batches):
        name, ids, weights, sides, held = None, [], [], [], []
        waiting: list = []
        records = size = 0

        def close() -> None:
            if len(ids) > 1:
                waiting.append((np.array(ids, np.int64), (held, np.array(weights, np.int64), None if sides[0] is None else np.array(sides, bool))))

        def solved():
            for (own, _), (root, links) in zip(waiting, solve([x for _, x in waiting]), strict=True):
                use = np.flatnonzero((root != np.arange(len(own))) | (np.bincount(root, minlength=len(own)) > 1) | (links > 0))
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array(own[use]), pa.array(own[root[use]]), pa.array(links[use])], ["id", "root", "links"])
            waiting.clear()
            tv.trim()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "side", "id", "weight", "payload")]
            for cell, side, own, weight, payload in zip(*columns, strict=True):
                if cell != name:
                    close()
                    if records >= BATCH or size >= BATCH_BYTES:
                        yield from solved()
                        records = size = 0
                    name, ids, weights, sides, held = cell, [], [], [], []
                ids.append(own)
                weights.append(weight)
                sides.append(side)
                held.append(payload)
                records, size = records + 1, size + len(payload)
        close()
        yield from solved()

    x = members.join(records, "id").select("cell", "id", "side", "weight", "payload")
    x = x.repartition(common.cells(members.sparkSession), "cell").sortWithinPartitions("cell", "id")
    return x.mapInArrow(run, "id long, root long, links long")


def classes(met: DataFrame) -> DataFrame:
    """(id, component, links) of the records with links, from what meet() gives."""
    met = common.stored(met)
    joined = common.components(met.where("id <> root"), "id", "root")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    return joined.join(links, "id", "left").select("id", "component", F.coalesce("links", F.lit(0)).alias("links"))
