"""Suffix-array deduplication with deep-shallow sorting.

Only suffixes that start a window whose seed recurs (see passages) can repeat; they are sorted in
the bucket of their seed, those of equal pieces of text once.  Multikey quicksort orders them by symbols of eight bytes to a shallow
depth; what still is together shares a long prefix, and blind tries order those
groups to the full depth.  Equal suffixes then stand together, and the least document id among
them decides which occurrences go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import passages as ps
from . import textvec as tv


def symbols(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each place as one number, zeros beyond the end."""
    out = np.zeros(len(buf), np.uint64)
    for k in range(min(8, len(buf))):
        out[: len(buf) - k] |= buf[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def multikey_quicksort(sym: np.ndarray, starts: np.ndarray, length: int, depth_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first symbols up to a depth, and for each place in it whether it differs from the one before.

    Every group is split three ways at a pivot symbol: the lesser, the equal, of which the next symbol counts from then on, and
    the greater; all groups of a round are split at once.
    """
    order = np.arange(len(starts))
    new = np.zeros(len(starts) + 1, bool)
    new[[0, -1]] = True
    first, size, depth = np.array([0]), np.array([len(starts)]), np.array([0])
    while True:
        open_ = (size > 1) & (depth < min(depth_most, length))
        first, size, depth = first[open_], size[open_], depth[open_]
        if not len(first):
            return order, new[:-1]
        begin = np.cumsum(size) - size
        group = np.repeat(np.arange(len(first)), size)
        place = np.arange(len(group)) + (first - begin)[group]
        own = order[place]
        x = sym[starts[own] + depth[group]]
        short = length - depth < 8  # a last symbol of fewer bytes
        if short.any():
            cut = np.where(short, 64 - 8 * (length - depth), 0).astype(np.uint64)[group]
            x = x >> cut << cut
        three = np.sort(np.stack([x[begin], x[begin + size // 2], x[begin + size - 1]]), axis=0)
        pivot = three[1][group]
        side = (x > pivot).astype(np.int8) + (x >= pivot)
        key = group * 3 + side
        many = np.bincount(key, minlength=3 * len(first))
        to = np.cumsum(many) - many
        at = np.empty(len(x), np.int64)
        for k in range(3):
            mine = np.flatnonzero(side == k)
            rank = np.arange(len(mine))
            before = np.cumsum(many[k::3]) - many[k::3]
            at[mine] = to[key[mine]] + rank - before[group[mine]]
        moved = np.empty_like(own)
        moved[at] = own
        order[place] = moved
        first = (to + np.repeat(first - begin, 3))[many > 0]
        new[first] = True
        depth = (np.repeat(depth, 3) + np.tile([0, 8, 0], len(many) // 3))[many > 0]
        size = many[many > 0]


class _Node:
    __slots__ = ("skip", "next", "leaf")

    def __init__(self, skip: int, leaf=None):
        self.skip, self.next, self.leaf = skip, {}, leaf


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Groups of equal strings (of one length) in order: a compacted trie that holds one byte for each branch."""
    root = None
    for i, s in enumerate(strings):
        if root is None:
            root = _Node(len(s), [i])
            continue
        node, path = root, []
        while node.leaf is None:  # blind descent by branching bytes alone
            path.append(node)
            node = node.next.get(s[node.skip]) or next(iter(node.next.values()))
        other = strings[node.leaf[0]]
        if other == s:
            node.leaf.append(i)
            continue
        common_ = next(k for k, (x, y) in enumerate(zip(s, other, strict=True)) if x != y)
        up = None
        for x in path:
            if x.skip >= common_:
                break
            up = x
        below = root if up is None else up.next.get(s[up.skip])
        if up is not None and below is None:
            up.next[s[up.skip]] = _Node(len(s), [i])
        elif below.leaf is None and below.skip == common_:
            below.next[s[common_]] = _Node(len(s), [i])
        else:
            split = _Node(common_)
            split.next = {other[common_]: below, s[common_]: _Node(len(s), [i])}
            if up is None:
                root = split
            else:
                up.next[s[up.skip]] = split
    out, todo = [], [root] if root else []
    while todo:
        node = todo.pop()
        if node.leaf is not None:
            out.append(node.leaf)
        else:
            todo += [node.next[b] for b in sorted(node.next, reverse=True)]
    return out


def deep_shallow(buf: np.ndarray, starts: np.ndarray, length: int, shallow: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes buf[start : start + length], and for each place in it whether it differs from the one before."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    sym = symbols(buf)
    order, new = multikey_quicksort(sym, starts, length, shallow)
    group = np.cumsum(new) - 1
    head = order[new][group]
    # deep: groups whose members all equal the first need no trie
    differs, depth = np.zeros(len(order), bool), -(-min(shallow, length) // 8) * 8
    while depth < length:
        cut = np.uint64(max(0, 64 - 8 * (length - depth)))
        differs |= (sym[starts[order] + depth] >> cut) != (sym[starts[head] + depth] >> cut)
        depth += 8
    firsts = np.append(np.flatnonzero(new), len(order))
    for k in np.unique(group[differs]).tolist():
        a, b = int(firsts[k]), int(firsts[k + 1])
        own = order[a:b].copy()
        at = a
        for same in blind_trie([buf[x : x + length].tobytes() for x in starts[own].tolist()]):
            order[at : at + len(same)] = own[same]
            new[at] = True
            at += len(same)
    return order, new


def same_pieces(buf: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each piece buf[begin : begin + n], pieces back to back, the first one that equals it."""
    local = np.arange(len(buf)) - np.repeat(begin, n)
    h = tv.mix(np.add.reduceat(tv.BYTE[buf] * tv.powers(int(n.max()))[local], begin) + n.astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    of = one[which]
    of = np.where(n[of] == n, of, np.arange(len(n)))
    # equal in hash is not yet equal
    differs = np.add.reduceat(buf != buf[np.repeat(begin[of], n) + local], begin, dtype=np.int64) > 0
    return np.where(differs, np.arange(len(n)), of)


class Contexts:
    """The windows of a slice whose seeds recur, as pieces of text around each seed, equal pieces once."""

    def __init__(self, s: ps.Slice, length: int, seed: int):
        self.s, self.length = s, length
        self.starts = ps.inside(s.offsets, s.there, length)
        n = len(s.raw)
        sums = tv.prefix(s.raw)
        at = np.arange(max(n - seed + 1, 0))
        self.h = tv.span_hash(s.raw, at, at + seed, sums) >> np.uint64(64 - ps.SEED_BITS) if n >= seed else np.zeros(0, np.uint64)
        place = tv.minimizers(self.h, length - seed + 1)
        self.place = place[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.sums = sums

    def seeds(self) -> np.ndarray:
        return self.h[self.place[tv.changes(self.place)]]  # places never fall

    def cut(self, recurring: np.ndarray, buckets: int):
        """Windows (starts) that take part, the piece of each and its place in it; pieces in order of (bucket, seed, hash)."""
        new = tv.changes(self.place)
        use = np.repeat(ps.member(self.h[self.place[new]], recurring), np.diff(np.append(np.flatnonzero(new), len(new))))
        starts, place = self.starts[use], self.place[use]
        of = np.searchsorted(self.s.offsets, starts, "right") - 1
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])]) if len(starts) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        begin, count = starts[first], np.diff(np.append(first, len(starts)))
        end = begin + count + self.length - 1
        seed = self.h[place[first]]
        whole = tv.span_hash(self.s.raw, begin, end, self.sums)
        key = ps.bucket_of(seed, buckets)
        order = np.lexsort((begin, whole, place[first] - begin, seed, key))
        k, sd, wh, lf = key[order], seed[order], whole[order], (place[first] - begin)[order]
        other = np.concatenate([[True], (sd[1:] != sd[:-1]) | (wh[1:] != wh[:-1]) | (lf[1:] != lf[:-1])]) if len(order) else np.zeros(0, bool)
        piece = np.empty(len(order), np.int64)
        piece[order] = np.cumsum(other) - 1
        head = order[other]
        least = np.minimum.reduceat(self.s.ids[of[first]][order], np.flatnonzero(other)) if len(order) else np.zeros(0, np.int64)
        self.of, self.used = of, starts
        self.piece, self.inner = piece[run], starts - begin[run]
        return {"bucket": k[other], "begin": begin[head], "count": count[head], "id": least}


def drop_repeats(docs: DataFrame, length: int = 50, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs.

    A byte of the UTF-8 text goes if a string of so many bytes covers it that also
    starts in a document with a smaller id; strings never cross documents.  n_spans counts the
    maximal removed runs; kept are the bytes that stay.  A null text is empty.  A row with a
    null id keeps all its bytes and takes none from others; rows that repeat an id take nothing from each
    other.  Other columns are not looked at.  An empty table gives no rows.
    """
    docs = common.texts(docs, id_col, text_col)
    buckets = 4 * common.cells(docs.sparkSession)  # a bucket is sorted whole in one task
    slices = ps.slice_rows(docs)

    def seeds_of(s: ps.Slice) -> tuple[np.ndarray, np.ndarray]:
        h = Contexts(s, length, seed).seeds()
        return h, np.zeros((len(h), 0), np.uint8)

    # seeds are few beside the text they stand for: a quarter of the buckets, each slice sends a blob to each
    seeds = common.stored(ps.recurring(slices, seeds_of, common.cells(docs.sparkSession)).drop("letters"))

    def pieces(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = {"slice": [], "bucket": [], "text": [], "count": [], "id": []}
        for _, row in left.iterrows():
            x = Contexts(ps.Slice(row), length, seed)
            p = x.cut(ps.unpack_sorted(right["seeds"]), buckets)
            for b in np.unique(p["bucket"]).tolist():
                own = slice(*np.searchsorted(p["bucket"], [b, b + 1]).tolist())
                begin, count = p["begin"][own], p["count"][own]
                n = count + length - 1
                src = np.repeat(begin - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
                rows["slice"].append(row["slice"])
                rows["bucket"].append(b)
                rows["text"].append(pa.compress(x.s.raw[src].tobytes(), codec="zstd", asbytes=True))
                rows["count"].append(tv.squeeze(count))
                rows["id"].append(tv.squeeze(p["id"][own]))
        return pd.DataFrame(rows)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [tv.unsqueeze(x).view(np.int64) for x in pdf["count"]]
        count = np.concatenate(counts)
        n = count + length - 1
        sizes = [int((x + length - 1).sum()) for x in counts]
        buf = np.concatenate([np.frombuffer(pa.decompress(x, k, codec="zstd", asbytes=True), np.uint8) for x, k in zip(pdf["text"], sizes, strict=True)])
        ids = np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["id"]])
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        of = same_pieces(buf, begin, n)
        np.minimum.at(ids, of, ids.copy())
        own = np.flatnonzero(of == np.arange(len(of)))
        base = np.zeros(len(of), np.int64)
        base[own] = np.cumsum(count[own]) - count[own]
        starts = np.repeat(begin[own] - base[own], count[own]) + np.arange(int(count[own].sum()))
        by, new = deep_shallow(buf, starts, length)
        once = np.empty(len(starts), np.int64)
        once[by] = np.repeat(np.minimum.reduceat(np.repeat(ids[own], count[own])[by], np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(by))))
        least = once[np.repeat(base[of] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        out, at = [], 0
        for x in counts:
            m = int(x.sum())
            out.append(tv.squeeze(np.diff(least[at : at + m], prepend=np.int64(0))))
            at += m
        return pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "least": out})

    def remove(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("bucket")
        for _, row in left.iterrows():
            x = Contexts(ps.Slice(row), length, seed)
            p = x.cut(ps.unpack_sorted(right["seeds"].dropna()), buckets)
            least = [np.cumsum(tv.unsqueeze(v).view(np.int64)) for v in right["least"].dropna()]
            least = np.concatenate(least) if least else np.zeros(0, np.int64)
            base = np.concatenate([[0], np.cumsum(p["count"])])
            s = x.s
            gone = least[base[x.piece] + x.inner] < s.ids[x.of] if len(x.used) else np.zeros(0, bool)
            cover = ps.covered(x.used[gone], length, len(s.raw))
            stay = ~cover
            raw = s.raw[stay].tobytes()
            lost = np.concatenate([[0], np.cumsum(cover)])[s.offsets]
            head = cover & ~np.concatenate([[False], cover[:-1]]) if len(cover) else cover
            cuts = s.offsets[:-1][s.offsets[:-1] < len(cover)]
            head[cuts] = cover[cuts]
            spans = np.concatenate([[0], np.cumsum(head)])[s.offsets]
            at = s.offsets - lost
            ids = pd.array(s.ids, dtype="Int64")
            ids[~s.there] = pd.NA
            kept = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            out.append(pd.DataFrame({"doc_id": ids, "n_bytes": np.diff(s.offsets), "n_removed": np.diff(lost), "n_spans": np.diff(spans), "kept": kept}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}, dtype=object)

    by = slices.groupBy("slice")
    sent = by.cogroup(seeds.groupBy("slice")).applyInPandas(pieces, "slice long, bucket int, text binary, count binary, id binary")
    least = sent.groupBy("bucket").applyInPandas(order, "slice long, bucket int, least binary")
    none = F.lit(None).cast("binary")
    both = seeds.select("slice", "bucket", "seeds", none.alias("least")).unionByName(least.select("slice", "bucket", none.alias("seeds"), "least"))
    return by.cogroup(both.groupBy("slice")).applyInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
