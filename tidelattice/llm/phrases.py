"""Substring deduplication by repeated-phrase automata.

Phrases that recur are found by seeds (see passages): buckets of the seeds' hash tell each slice of the documents
the words of those of its phrases that recur anywhere.  They are the patterns of the slice's Aho-Corasick automaton, one letter a word; every document of the
slice is streamed through it, and its matches alone say where a window can recur.  Windows around them are compared over the
corpus by 96 bits of hash; the first occurrence of each stays, the words of all others go.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import passages as ps
from . import textvec as tv


def _string(letters: np.ndarray) -> str:
    """A character for each letter, above those that UTF-16 keeps for itself."""
    return (letters.astype("<u4") + 0x10000).tobytes().decode("utf-32-le")


class Phrases:
    """The words, seeds and windows of a slice."""

    def __init__(self, s: ps.Slice, window: int, seed: int):
        self.s, self.window, self.seed = s, window, seed
        self.w = tv.Words(s.raw, s.offsets)
        self.starts = ps.inside(self.w.first, s.there, window)
        g, _ = self.w.grams(seed)
        self.g = g >> np.uint64(64 - ps.SEED_BITS)
        place = tv.minimizers(g, window - seed + 1)
        self.place = place[self.starts] if len(self.starts) else np.zeros(0, np.int64)

    def seed_places(self) -> np.ndarray:
        return self.place[tv.changes(self.place)]  # places never fall

    def letters(self) -> np.ndarray:
        """Two bytes of hash for each word."""
        return (self.w.hash & np.uint64(0xFFFF)).astype(np.uint16)

    def spelled(self, at: np.ndarray) -> np.ndarray:
        """The letters of the seeds at these places, a row of bytes for each."""
        return self.letters()[at[:, None] + np.arange(self.seed)].view(np.uint8).reshape(len(at), 2 * self.seed)

    def located(self, phrases: set[bytes]) -> np.ndarray:
        """Whether one of the phrases starts at each word, by streaming the texts through their automaton."""
        out = np.zeros(len(self.w.hash) + 1, bool)
        if not phrases:
            return out
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for x in phrases:
            machine.add_word(_string(np.frombuffer(x, np.uint16)), 1)
        machine.make_automaton()
        letters = self.letters()
        for a, b in zip(self.w.first[:-1].tolist(), self.w.first[1:].tolist(), strict=True):
            if b - a >= self.window:
                ends = [e for e, _ in machine.iter(_string(letters[a:b]))]
                out[np.array(ends, np.int64) + (a - self.seed + 1)] = True
        return out

    def windows(self, starts: np.ndarray, salt: int = 0) -> np.ndarray:
        h, k = self.w.hash, self.window
        h = tv.mix(h ^ np.uint64(0x9FB21C651E98DF25)) if salt else h
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tv.powers(len(h)), dtype=np.uint64)])
        return tv.mix((sums[starts + k] - sums[starts]) * tv.powers(len(h) + 1, tv.INV)[starts])

    def order(self, starts: np.ndarray):
        """Windows by (hash, document, start): the order, and which is another hash's first."""
        h = self.windows(starts)
        of = np.searchsorted(self.w.first, starts, "right") - 1
        ids = self.s.ids[of]
        begin = starts - self.w.first[of]
        order = np.lexsort((begin, ids, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        return h, ids, begin, order, new


def drop_repeats(docs: DataFrame, window: int = 20, seed: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs.

    Words are [^\\x20\\x09-\\x0D]+, unchanged.  A word goes if a window of so many words of its
    document covers it whose word sequence also starts earlier: in a document with a smaller
    id, or earlier in the same document.  kept: the words that stay, joined by one space.
    A null text has no words.  A row with a null id keeps all its words and takes none from others; rows
    that repeat an id take nothing from each other.  Other columns are not looked at.  An empty table gives no rows.
    """
    docs = common.texts(docs, id_col, text_col)
    buckets = common.cells(docs.sparkSession)
    slices = ps.slice_rows(docs)

    def seeds_of(s: ps.Slice) -> tuple[np.ndarray, np.ndarray]:
        x = Phrases(s, window, seed)
        at = x.seed_places()
        return x.g[at], x.spelled(at)

    seeds = common.stored(ps.recurring(slices, seeds_of, buckets))

    def locate(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = {"slice": [], "bucket": [], "h": [], "more": [], "id": []}
        for _, row in left.iterrows():
            x = Phrases(ps.Slice(row), window, seed)
            phrases = {v[i : i + 2 * seed] for v in right["letters"] for i in range(0, len(v), 2 * seed)}
            at = x.located(phrases)
            starts = x.starts[at[x.place]]
            h, ids, _, order, new = x.order(starts)
            own = order[new]
            more = x.windows(starts[own], 1) >> np.uint64(32)
            h, ids = h[own], ids[own]
            for k, part in enumerate(ps.deal(h, buckets)):
                if len(part):
                    rows["slice"].append(row["slice"])
                    rows["bucket"].append(k)
                    rows["h"].append(tv.squeeze(tv.rising(h[part])))
                    rows["more"].append(tv.squeeze(more[part]))
                    rows["id"].append(tv.squeeze(ids[part]))
        return pd.DataFrame(rows)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["h"]]
        every, ids = np.concatenate(h), np.concatenate([tv.unsqueeze(x).view(np.int64) for x in pdf["id"]])
        more = np.concatenate([tv.unsqueeze(x) for x in pdf["more"]])
        order = np.lexsort((ids, more, every))
        new = tv.changes(every[order]) | tv.changes(more[order])
        least = np.empty(len(every), np.int64)
        least[order] = ids[order][new][np.cumsum(new) - 1]
        late, out, at = ids > least, [], 0
        for x in h:
            out.append(tv.squeeze(tv.rising(x[late[at : at + len(x)]])))
            at += len(x)
        return pd.DataFrame({"slice": pdf["slice"], "late": out})

    def remove(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            x = Phrases.__new__(Phrases)
            s = x.s = ps.Slice(row)
            x.window, x.seed = window, seed
            w = x.w = tv.Words(s.raw, s.offsets)
            starts = ps.inside(w.first, s.there, window)
            h, ids, begin, order, new = x.order(starts)
            group = np.cumsum(new) - 1
            head = order[new]
            gone = np.zeros(len(starts), bool)
            if len(head):
                i, b = ids[order], begin[order]
                gone[order] = (i > ids[head][group]) | (b > begin[head][group])
            gone |= ps.member(h, ps.unpack_sorted(right["late"]))
            cover = ps.covered(starts[gone], window, len(w.hash))
            stay = ~cover
            size = np.where(stay, w.ends - w.starts + 1, 0)
            upto = np.concatenate([[0], np.cumsum(size)])
            text = np.full(int(upto[-1]), 32, np.uint8)
            a, b = w.starts[stay], w.ends[stay]
            n = b - a
            src = np.repeat(a - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
            dst = np.repeat(upto[:-1][stay] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))
            text[dst] = s.raw[src]
            raw, at = text.tobytes(), upto[w.first]
            lost = np.concatenate([[0], np.cumsum(cover)])[w.first]
            kept = [raw[p : max(p, q - 1)].decode() for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ids = pd.array(s.ids, dtype="Int64")
            ids[~s.there] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_words": np.diff(w.first), "n_removed": np.diff(lost), "kept": pd.Series(kept, dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept": []}, dtype=object)

    by = slices.groupBy("slice")
    found = by.cogroup(seeds.groupBy("slice")).applyInPandas(locate, "slice long, bucket int, h binary, more binary, id binary")
    late = found.groupBy("bucket").applyInPandas(first, "slice long, late binary")
    return by.cogroup(late.groupBy("slice")).applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept string")


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
n AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id)
"""
