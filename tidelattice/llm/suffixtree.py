"""Scoring by a probabilistic suffix tree over the words of a text.

A text is its words in lower case (A-Z) and an end; before it stands an end.  The tree's states are contexts of up to `depth`
words that training texts hold twice or more.  A context is retained if its next-word distribution diverges enough from what the
tree says without it.  The root is the add-0.1 distribution of all words seen and one that stands for all others; a retained context's distribution is
smoothed by absolute discounting towards that of its longest retained suffix.  A word is scored by the longest retained suffix
of what stands before it.

The tree is nowhere held whole, and grows with the input.  Slices of the input, coded as numbers of their own words, send counts to buckets of the
contexts' hash, a depth at a time; there a context has all its next words, is tested, and each slice gets back the counts of what it asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textvec as tv

DISCOUNT = 0.75
#: The root's count of words never seen, and what is added to all others.
ADDED = 0.1
#: The end, as a word's hash.
END = np.uint64(0xA24BAED4963EE407)
#: Bits of a next word's hash beside its context's, and fractions of a bit in which code lengths are added up.
NEXT_BITS, BIT_PARTS = 40, 1024


def is_training(doc_id: Column, folds: int = 10, held: int = 0) -> Column:
    """Not held out: crc32 of the id as text, modulo folds, is not `held`.  A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each text's end after them, as hashes, and n + 1 offsets."""
    w = tv.Words(raw, offsets, lower=True)
    at = w.first + np.arange(len(w.first))
    out = np.full(int(at[-1]), END, np.uint64)
    out[np.arange(len(w.hash)) + w.doc()] = w.hash
    return out, at


def coded(rows: DataFrame) -> DataFrame:
    """Slices (slice, ids, there, train, lens, vocab, tokens) of rows (doc_id, train, text), in their order, stored by slice; tokens are places in vocab, which ascends."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, raw, offsets in tv.slices(batch.column("text")):
                h, at = token_hashes(raw, offsets)
                vocab, tokens = np.unique(h, return_inverse=True)
                part = batch.slice(a, b - a)
                ids = part.column("doc_id")
                packed = [np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.int64)]
                packed += [np.asarray(part.column("train").to_numpy(zero_copy_only=False), np.int64), np.diff(at), tv.rising(vocab), tokens.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([task << 20 | made]), *[pa.array([tv.squeeze(x)], pa.binary()) for x in packed]], ["slice", *CODED])
                made += 1

    return common.stored_by(rows.select("doc_id", "train", "text").mapInArrow(run, "slice long, " + ", ".join(f"{c} binary" for c in CODED)), "slice")


CODED = ["ids", "there", "train", "lens", "vocab", "tokens"]


class Grams:
    """The asked-for (context, next word) pairs of one depth in a slice, in order of (context, next); which of them each token is, or -1."""

    def __init__(self, ctx: np.ndarray, nxt: np.ndarray, asked: np.ndarray, train: np.ndarray, below: np.ndarray):
        at = np.flatnonzero(asked)
        c, x = ctx[at], nxt[at] >> np.uint64(64 - NEXT_BITS)
        order = np.lexsort((x, c))
        c, x, at = c[order], x[order], at[order]
        new_ctx = tv.changes(c)
        new = new_ctx | tv.changes(x)
        self.of = np.full(len(ctx), -1)
        self.of[at] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.ctx, self.next = c[new_ctx], x[first]
        own = np.cumsum(new_ctx) - 1
        self.ctx_of = own[first]  # of each pair
        self.n = np.add.reduceat(train[at], first) if len(at) else np.zeros(0, np.int64)
        # what the training tokens cost without the context
        self.cost = np.add.reduceat(train[at] * below[at], np.flatnonzero(new_ctx)) if len(at) else np.zeros(0, np.int64)


class State:
    """A slice's tokens and, depth by depth, their probabilities by what the buckets have answered."""

    def __init__(self, row, total: int, kinds: int):
        self.slice, x = row["slice"], {c: tv.unsqueeze(row[c]) for c in CODED}
        self.ids, self.there, self.lens = (x[c].view(np.int64) for c in ("ids", "there", "lens"))
        self.tokens, self.vocab = x["tokens"].view(np.int64), np.cumsum(x["vocab"], dtype=np.uint64)
        self.h = self.vocab[self.tokens]
        self.train = np.repeat(x["train"].view(np.int64), self.lens)
        at = np.cumsum(self.lens) - self.lens
        self.place = np.arange(len(self.h)) - np.repeat(at, self.lens)
        self.begin = at
        self.total, self.kinds, self.depth = total, kinds, 0

    def root(self, counts: np.ndarray) -> None:
        self.counts = counts[self.tokens]
        self.base = np.log10(self.counts + ADDED) - np.log10(self.total + ADDED * (self.kinds + 1))
        self.p = (self.counts + ADDED) / (self.total + ADDED * (self.kinds + 1))
        before = np.concatenate([[np.int64(0)], self.counts[:-1]])
        ends = int(counts[np.searchsorted(self.vocab, END)]) if len(self.vocab) else 0
        #: How often the context that ends before each token stands in training texts.
        self.before = np.where(self.place == 0, ends, before)
        previous = np.concatenate([[END], self.h[:-1]])
        self.ctx = tv.mix(np.where(self.place == 0, END, previous))

    def grams(self) -> Grams:
        """What is asked for at the next depth."""
        cost = np.round(-np.log2(self.p) * BIT_PARTS).astype(np.int64)
        return Grams(self.ctx, self.h, self.before >= 2, self.train, cost)

    def learn(self, pairs: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> None:
        """One depth more, by the answers to grams(): counts of the pairs, and total (0: not retained) and kinds of the contexts."""
        g = self.grams()
        hit = np.flatnonzero(g.of >= 0)
        k = g.of[hit]
        n, total, kind = pairs[k], totals[g.ctx_of[k]], kinds[g.ctx_of[k]]
        keep = total > 0
        at, n, total, kind = hit[keep], n[keep], total[keep], kind[keep]
        self.p = self.p.copy()
        self.p[at] = np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * kind / total * self.p[at]
        seen = np.zeros(len(self.h), np.int64)
        seen[hit] = pairs[k]
        self.depth += 1
        # the context one word longer is the pair that ends before the token
        before = np.concatenate([[np.int64(0)], seen[:-1]])
        self.before = np.where(self.place >= self.depth, before, 0)
        self.ctx = tv.mix(np.concatenate([[np.uint64(0)], self.ctx[:-1]]) * np.uint64(tv.BASE) + np.concatenate([[np.uint64(0)], self.h[:-1]]))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of ascending hashes begin, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def word_counts(slices: DataFrame, buckets: int) -> DataFrame:
    """(depth 0, slice, bucket, pairs, n, v): the training counts of each slice's words, in their order; n, v: the bucket's tokens and different words, once."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = {c: tv.unsqueeze(row[c]) for c in ("train", "lens", "vocab", "tokens")}
                train = np.repeat(x["train"].view(np.int64), x["lens"].view(np.int64))
                vocab = np.cumsum(x["vocab"], dtype=np.uint64)
                n = np.bincount(x["tokens"].view(np.int64)[train > 0], minlength=len(vocab)).astype(np.int64)
                at = cuts(vocab, buckets)
                rows = {"slice": [], "bucket": [], "words": [], "n": []}
                for b in np.flatnonzero(np.diff(at)).tolist():
                    own = slice(int(at[b]), int(at[b + 1]))
                    rows["slice"].append(row["slice"])
                    rows["bucket"].append(b)
                    rows["words"].append(tv.squeeze(tv.rising(vocab[own])))
                    rows["n"].append(tv.squeeze(n[own]))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("n", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["words"]]
        every, n = np.concatenate(words), np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["n"]])
        order = np.argsort(every)
        first = np.flatnonzero(tv.changes(every[order]))
        sums = np.add.reduceat(n[order], first)
        total = np.empty(len(every), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(every))))
        out, at = [], 0
        for x in words:
            out.append(tv.squeeze(total[at : at + len(x)]))
            at += len(x)
        once = np.zeros((2, len(out)), np.int64)
        once[:, 0] = sums.sum(), (sums > 0).sum()
        return pd.DataFrame({"depth": 0, "slice": pdf["slice"], "bucket": pdf["bucket"], "pairs": out, "totals": b"", "kinds": b"", "n": once[0], "v": once[1]})

    sent = slices.select("slice", "train", "lens", "vocab", "tokens").mapInArrow(send, "slice long, bucket int, words binary, n binary")
    return sent.groupBy("bucket").applyInPandas(add, ANSWER + ", n long, v long")


ANSWER = "depth int, slice long, bucket int, pairs binary, totals binary, kinds binary"


def replay(row, answers: pd.DataFrame, total: int, kinds: int, depth: int) -> State:
    """The state of a slice after the answers of depths 0 to `depth`."""
    state = State(row, total, kinds)
    for d in range(depth + 1):
        own = answers[answers["depth"] == d].sort_values("bucket")
        got = [np.concatenate([np.zeros(0, np.int64), *[tv.unsqueeze(x).view(np.int64) for x in own[c]]]) for c in (("pairs",) if not d else ("pairs", "totals", "kinds"))]
        if d:
            state.learn(*got)
        else:
            state.root(*got)
    return state


def retained(ctx: np.ndarray, n: np.ndarray, cost: np.ndarray, first: np.ndarray, bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, total, kinds) of contexts that begin at `first` among pairs with counts n; cost: of their tokens without the context.

    A context passes if it saves at least `bits` of code length for each different next word.
    """
    total = np.add.reduceat(n, first)
    kinds = np.add.reduceat((n > 0).astype(np.int64), first)
    entropy = np.add.reduceat(n * np.log2(np.maximum(n, 1)), first) - total * np.log2(np.maximum(total, 1))
    return (total >= 2) & (cost / BIT_PARTS + entropy >= bits * kinds), total, kinds


def next_counts(slices: DataFrame, answers: DataFrame, total: int, kinds: int, depth: int, bits: float, buckets: int) -> DataFrame:
    """The answers of one depth: counts of the pairs each slice asks for, total (0: not retained) and kinds of their contexts."""

    def send(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = {"slice": [], "bucket": [], "ctx": [], "cost": [], "many": [], "next": [], "n": []}
        for _, row in left.iterrows():
            g = replay(row, right, total, kinds, depth - 1).grams()
            at = cuts(g.ctx, buckets)
            pairs = np.searchsorted(g.ctx_of, at)
            for b in np.flatnonzero(np.diff(at)).tolist():
                own, mine = slice(int(at[b]), int(at[b + 1])), slice(int(pairs[b]), int(pairs[b + 1]))
                rows["slice"].append(row["slice"])
                rows["bucket"].append(b)
                rows["ctx"].append(tv.squeeze(tv.rising(g.ctx[own])))
                rows["cost"].append(tv.squeeze(g.cost[own]))
                rows["many"].append(tv.squeeze(np.bincount(g.ctx_of[mine] - own.start, minlength=own.stop - own.start).astype(np.int64)))
                rows["next"].append(tv.squeeze(g.next[mine]))
                rows["n"].append(tv.squeeze(g.n[mine]))
        return pd.DataFrame(rows)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        ctx = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["ctx"]]
        many = [tv.unsqueeze(x).view(np.int64) for x in pdf["many"]]
        own = np.concatenate(ctx)
        contexts, which = np.unique(own, return_inverse=True)
        cost = np.zeros(len(contexts), np.int64)
        np.add.at(cost, which, np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["cost"]]))
        of = np.repeat(which, np.concatenate(many))
        nxt, n = np.concatenate([tv.unsqueeze(x) for x in pdf["next"]]), np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["n"]])
        order = np.lexsort((nxt, of))
        new_ctx = tv.changes(of[order])
        first = np.flatnonzero(new_ctx | tv.changes(nxt[order]))
        sums = np.add.reduceat(n[order], first)
        pair = np.empty(len(of), np.int64)
        pair[order] = np.repeat(sums, np.diff(np.append(first, len(of))))
        kept, totals, kinds_ = retained(contexts, sums, cost, np.flatnonzero(new_ctx[first]), bits)
        totals, kinds_ = np.where(kept, totals, 0)[which], np.where(kept, kinds_, 0)[which]
        out = {"pairs": [], "totals": [], "kinds": []}
        a = b = 0
        for x, y in zip(ctx, many, strict=True):
            out["totals"].append(tv.squeeze(totals[a : a + len(x)]))
            out["kinds"].append(tv.squeeze(kinds_[a : a + len(x)]))
            m = int(y.sum())
            out["pairs"].append(tv.squeeze(pair[b : b + m]))
            a, b = a + len(x), b + m
        return pd.DataFrame({"depth": depth, "slice": pdf["slice"], "bucket": pdf["bucket"], **out})

    sent = slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(send, "slice long, bucket int, ctx binary, cost binary, many binary, next binary, n binary")
    return sent.groupBy("bucket").applyInPandas(test, ANSWER)


def by_slice(answers: DataFrame, made: int) -> DataFrame:
    """answers stored by slice, for which what was stored since there were `made` folders goes: the next depth reads them without shuffle files that would stay as long as its own."""
    spark = answers.sparkSession
    out = common.stored_by(answers.repartition(common.cells(spark, 1), "slice"), "slice")  # one file a task
    common.discard(spark, made, out)
    return out


def score_texts(docs: DataFrame, train: Column | None = None, depth: int = 2, bits: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    train: which rows to learn from (default: is_training of the id; null: not).  A null text is an
    empty one: one token, the end.  A null id counts as the empty text in the default
    split; rows that repeat an id and text are rows of their own and count as often as they occur.  Other columns are not looked at.  An empty
    table gives no rows; without training rows every word has the one probability of words never seen.
    """
    train = is_training(F.col(id_col).cast("long")) if train is None else train
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    buckets = 2 * common.cells(docs.sparkSession)  # a bucket is sorted whole in one task
    slices = coded(rows)
    made = len(common.MADE)
    answers = common.stored(word_counts(slices, buckets))
    n, v = answers.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    answers = answers.drop("n", "v")
    for d in range(1, depth + 1):
        if d > 1:
            answers = by_slice(answers, made)
        more = common.stored(next_counts(slices, answers, n, v, d, bits, buckets))
        answers = answers.unionByName(more)

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            x = replay(row, right, n, v, depth)
            ids = pd.array(x.ids, dtype="Int64")
            ids[x.there == 0] = pd.NA
            sums = [np.add.reduceat(y, x.begin) for y in (x.base, np.log10(x.p))]
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": x.lens, "n_known": np.add.reduceat((x.counts > 0).astype(np.int64), x.begin), "train_tokens": n, "base_score": sums[0], "score": sums[1]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
