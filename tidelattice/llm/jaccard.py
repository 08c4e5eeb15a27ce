"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's inverted lists are ordered from short to long by their lengths over all documents.  With similarity at least
J, two sets of which one has s members share at least T = ceil(J s) of them, so at least
one in the s - T + 1 shortest lists of each; these name who can meet (see setjoin), and a document with fewer than T lists
that anybody else is in meets nobody.  Among those that meet, each document's short lists are merged by a heap, the long
ones probed by binary search, and those that reach the overlap of their pair link.

List lengths are exact: slices of the input send their packed shingles to buckets of the hash, and get back
how many documents hold each that two or more do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, setjoin
from . import passages as ps
from . import textvec as tv

#: Bits of a shingle's hash by which lists are told apart before the sets themselves are compared.
KEY_BITS = 48
SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n + 1 offsets in them."""
    w = tv.Words(raw, offsets, lower=True)
    counts = np.diff(w.first)
    texts = len(counts)
    g, ok = w.grams(k)
    of = w.doc()
    at = np.flatnonzero(ok)
    keys, doc = g[at], of[at]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):  # the whole short sequence is the one shingle
        whole = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            has = counts[few] > i
            x = w.hash[np.minimum(w.first[few] + i, len(w.hash) - 1)]
            whole = np.where(has, whole * np.uint64(tv.BASE) + x, whole)
        whole = tv.mix(whole ^ counts[few].astype(np.uint64))
        keys, doc = np.concatenate([keys, whole]), np.concatenate([doc, few])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts))]).astype(np.int64)


def required(size: np.ndarray | int, percent: int):
    """The least overlap of a set of that size with any partner: ceil(J * size)."""
    return -(-size * percent // 100)


class Sets:
    """The shingle sets of a slice: keys, n + 1 offsets, and two sums that equal sets share."""

    def __init__(self, row, k: int):
        self.slice, self.s = row["slice"], ps.Slice(row)
        self.keys, self.at = shingle_sets(self.s.raw, self.s.offsets, k)
        self.size = np.diff(self.at)
        self.prints = [self._sum(tv.mix(self.keys ^ np.uint64(x))) for x in SALTS]

    def _sum(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def firsts(self) -> np.ndarray:
        """The first row of each set that is not empty."""
        order = np.lexsort((np.arange(len(self.size)), self.size, *self.prints))
        new = np.zeros(len(order), bool)
        for x in (*self.prints, self.size):
            new |= tv.changes(x[order])
        return np.sort(order[new & (self.size[order] > 0)])

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in keys of the given rows' members, and the row (its place among those given) of each."""
        n = self.size[rows]
        own = np.repeat(np.arange(len(rows)), n)
        return np.repeat(self.at[rows] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum())), own


def fingerprints(slices: DataFrame, k: int) -> DataFrame:
    """(id, doc_id, n, f1, f2) of every row: its number, the size of its shingle set and two 64-bit sums that equal sets share."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Sets(row, k)
                ids = pa.array(x.s.ids, mask=~x.s.there)
                number = (x.slice << 20) + np.arange(len(x.size))
                yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(x.size), *[pa.array(v.view(np.int64)) for v in x.prints]], ["id", "doc_id", "n", "f1", "f2"])

    return slices.mapInArrow(run, "id long, doc_id long, n long, f1 long, f2 long")


def list_lengths(slices: DataFrame, k: int, buckets: int) -> DataFrame:
    """(slice, bucket, keys, n): the slice's shingles (ascending, packed) that two or more documents hold, and how many do; equal sets of a slice count once."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Sets(row, k)
                at, _ = x.members(x.firsts())
                keys = np.sort(x.keys[at] >> np.uint64(64 - KEY_BITS))
                new = np.flatnonzero(tv.changes(keys)) if len(keys) else np.zeros(0, np.int64)
                keys, n = keys[new], np.diff(np.append(new, len(keys)))
                rows = {"slice": [], "bucket": [], "keys": [], "n": []}
                for b, own in enumerate(ps.deal(keys, buckets)):
                    if len(own):
                        rows["slice"].append(x.slice)
                        rows["bucket"].append(b)
                        rows["keys"].append(tv.squeeze(tv.rising(keys[own])))
                        rows["n"].append(tv.squeeze(n[own]))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]))
                del x, at, keys, n, rows
            tv.trim()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["keys"]])
        n = np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["n"]])
        order = np.argsort(every)
        first = np.flatnonzero(tv.changes(every[order]))
        n[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(every))))
        del order, first
        out, lengths, at = [], [], 0
        for x in pdf["keys"]:
            own = slice(at, at + int.from_bytes(x[:6], "little"))
            at = own.stop
            use = n[own] > 1
            out.append(tv.squeeze(tv.rising(every[own][use])))
            lengths.append(tv.squeeze(n[own][use]))
        done = pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "keys": out, "n": lengths})
        del every, n
        tv.trim()
        return done

    sent = slices.mapInArrow(send, "slice long, bucket int, keys binary, n binary")
    return sent.groupBy("bucket").applyInPandas(add, "slice long, bucket int, keys binary, n binary")


def required(size: np.ndarray | int, percent: int):
    """The least overlap of a set of that size with any partner: ceil(J * size)."""
    return -(-size * percent // 100)


def candidates(slices: DataFrame, lengths: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, members, short): rows with enough shared lists to have a partner, their sets, and the keys of their short lists that are shared."""

    def find(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            x = Sets(row, k)
            keys = [np.cumsum(tv.unsqueeze(v), dtype=np.uint64) for v in right["keys"]]
            shared = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            n = np.concatenate([tv.unsqueeze(v).view(np.int64) for v in right["n"]]) if keys else np.zeros(0, np.int64)
            order = np.argsort(shared)
            shared, n = shared[order], n[order]
            rows = x.firsts()
            at, own = x.members(rows)
            own_keys = x.keys[at] >> np.uint64(64 - KEY_BITS)
            place = np.minimum(np.searchsorted(shared, own_keys), max(len(shared) - 1, 0))
            hit = shared[place] == own_keys if len(shared) else np.zeros(len(own_keys), bool)
            length = np.where(hit, n[place], 1) if len(shared) else np.ones(len(own_keys), np.int64)
            need = required(x.size[rows], percent)
            alive = np.bincount(own[hit], minlength=len(rows)) >= need
            use = alive[own]
            at, own, own_keys, length = at[use], own[use], own_keys[use], length[use]
            order = np.lexsort((own_keys, length, own))
            at, own, own_keys, length = at[order], own[order], own_keys[order], length[order]
            left_ = np.flatnonzero(alive)
            size = x.size[rows[left_]]
            first = np.concatenate([[0], np.cumsum(size)])
            for i, r in enumerate(left_.tolist()):
                a, b = int(first[i]), int(first[i + 1])
                end = a + int(size[i] - need[r] + 1)
                short = own_keys[a:end][length[a:end] > 1].view(np.int64)
                out.append(((x.slice << 20) + int(rows[r]), int(size[i]), int(x.prints[0][rows[r]].view(np.int64)), int(x.prints[1][rows[r]].view(np.int64)), x.keys[at[a:b]].tobytes(), short))
        done = pd.DataFrame(out, columns=["id", "n", "f1", "f2", "members", "short"])
        tv.trim()
        return done

    return slices.groupBy("slice").cogroup(lengths.groupBy("slice")).applyInPandas(find, "id long, n long, f1 long, f2 long, members binary, short array<long>")


def links_of(percent: int):
    """Solves cells: links at a similarity of `percent` or more."""

    def one(payloads: list[bytes], weights: np.ndarray, side: np.ndarray | None):
        records = [np.frombuffer(x, np.uint64) for x in payloads]
        size = np.array([len(x) for x in records], np.int64)
        roots, links = setjoin.Roots(len(records)), np.zeros(len(records), np.int64)
        for q, ids, shared in setjoin.searches(records, side, lambda n: int(required(n, percent))):
            ids = ids[100 * shared >= percent * (size[q] + size[ids] - shared)]
            links[q] += weights[ids].sum()
            links[ids] += weights[q]
            for i in ids.tolist():
                roots.join(q, i)
        return np.array([roots.find(i) for i in range(len(records))], np.int64), links

    return lambda cells: (one(*x) for x in cells)


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for every row of docs: classes of documents linked at similarity percent or more.

    Texts are lower-cased (A-Z) and cut into words [^\\x20\\x09-\\x0D]+.  n_links counts the rows that a row itself links
    with, copies among them.  A document without words (a null text, too) has the empty set, no links and its own id as
    component.  Rows that repeat an id are documents of their own.  component_id is the least id of the class that
    is not null; a row with a null id takes part in links, and has a null component if no row of its class has an id.
    Columns other than the two are not looked at.  An empty table gives no rows.

    Rows of one set are one record from the start, however many.  What is left is compared in cells (see setjoin): the
    links of a group of different near copies are all found and counted, and never become rows.
    """
    slices = ps.slice_rows(common.texts(docs, id_col, text_col))
    prints = common.stored(fingerprints(slices, k))
    lengths = list_lengths(slices, k, 2 * common.cells(docs.sparkSession))  # a bucket is sorted whole in one task
    found = common.stored(candidates(slices, lengths, k, percent))
    groups = prints.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"))
    reps = found.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"))
    reps = common.stored(reps.join(groups, ["f1", "f2", "n"]).select("id", "f1", "f2", "n", "weight"))
    postings = found.join(reps.select("id"), "id", "left_semi").select(F.explode("short").alias("key"), "id")
    shared = postings.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    postings = common.stored(postings.join(shared, "key"))
    records = found.select("id", F.col("members").alias("payload")).join(reps.select("id", "weight"), "id")
    met = setjoin.classes(setjoin.meet(setjoin.cells(postings), records, links_of(percent)))
    classes = reps.join(met, "id").select("f1", "f2", "n", F.col("component").alias("class"), "links")
    of = groups.join(classes, ["f1", "f2", "n"], "left")
    least = of.where("class is not null").groupBy("class").agg(F.min("least").alias("of_class"))
    of = of.join(least, "class", "left").select("f1", "f2", "n", F.coalesce("of_class", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return prints.join(of, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def op5_jaccard_divideskip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(common.table(spark, sf_dir, "documents"), k=3, percent=90)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * k >= 90 * (na + nb - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
l AS (SELECT a, count(*) AS links FROM e2 GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id, CAST(coalesce(l.links, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN c ON c.a = s.doc_id LEFT JOIN l ON l.a = s.doc_id
"""
