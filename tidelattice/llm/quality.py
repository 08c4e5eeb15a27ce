"""Quality rules: base statistics of a text and n-gram perplexity bands by language.

The model is a modified Kneser-Ney n-gram model over characters, counted by Spark
over every document, two for each language.  An n-gram of up to five characters packs into
60 bits exactly, so that one that was seen and one that was not are told apart at any size.  A model of more rows than go
to all tasks at once is dealt into lots by the two characters before the last one, and the texts are read once a lot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from . import textvec as tv

#: Bits of a character.
CHAR_BITS = 12
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: The models learn from texts with at most one symbol in so many characters: symbol junk must not teach them that it is likely.
SYMBOL_SHARE = 50
#: Texts are scored so many bytes at a time: a character needs some hundred bytes of working memory, beside the model that each worker holds.
SCORE_BYTES = tv.SLICE // 4


def char_ids(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit ids of the characters (from 2048 on by a hash) and each text's offsets in them."""
    head = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(head)])[offsets]
    c = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) != at[-1]:  # not valid UTF-8: bytes stand for characters
        c, at = raw.astype(np.uint32), offsets
    c = np.where(c < 2048, np.maximum(c, 1), 2048 + ((c * np.uint32(2654435761)) >> np.uint32(21)))
    return c.astype(np.uint64), at


def packed(c: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The order characters that end at each place; 0 stands before a text."""
    out = c.copy()
    place = np.arange(len(c)) - np.repeat(at[:-1], np.diff(at))
    for k in range(1, order):
        before = np.zeros_like(c)
        before[k:] = c[:-k] if k < len(c) else 0
        before[place < k] = 0
        out |= before << np.uint64(CHAR_BITS * k)
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.append(new, len(x)))


def _by_lang(lang: pa.Array, n: int) -> tuple[list[str], np.ndarray]:
    lang = pa.array(lang.fill_null("")).dictionary_encode()
    return lang.dictionary.to_pylist(), np.asarray(lang.indices)


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, g, c): counts of all character n-grams of the highest order in texts without many symbols; a null language is ''."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                keys, n = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * 1).take(pa.array(np.zeros(len(keys), np.int64))), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "g", "c"])

        for batch in batches:
            names, which = _by_lang(batch.column("lang"), batch.num_rows)
            for a, b, raw, offsets in tv.slices(batch.column("text")):
                c, at = char_ids(raw, offsets)
                g = packed(c, at, order)
                symbols = np.diff(np.concatenate([[0], np.cumsum(SYMBOLS[raw])])[offsets])
                of = np.repeat(np.where(SYMBOL_SHARE * symbols > np.diff(at), -1, which[a:b]), np.diff(at))
                for i in np.unique(which[a:b]):
                    keys, n = _runs(g[of == i])
                    parts = held.setdefault(names[i], [])
                    parts.append((keys, n))
                    size += len(keys)
                    if len(parts) > 8:
                        merged = _merge(parts)
                        size += len(merged[0]) - sum(len(x) for x, _ in parts)
                        held[names[i]] = [merged]
            if size > 6_000_000:
                yield from out()
                held, size = {}, 0
        yield from out()
        held.clear()
        tv.trim()

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, g long, c long")
    return rows.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(kind, n, lang, g, v, c) from counts (lang, g, c): kind p: log10 probability of an n-gram, b: log10 back-off weight of a context."""
    tables = {order: common.stored(counts)}
    for n in range(order - 1, 0, -1):
        mask = (1 << CHAR_BITS * n) - 1
        tables[n] = tables[n + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count("*").alias("c"))
        tables[n] = common.stored(tables[n])
    out, lower = None, None
    for n in range(1, order + 1):
        t = tables[n]
        few = t.groupBy("lang").agg(*[F.count(F.when(F.col("c") == k, 1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("size"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y=y):
            d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            # counts of counts that are empty or out of order (tiny corpora) leave half a count
            return F.coalesce(F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (d > 0) & (d < k), d), F.lit(0.5)).alias(f"d{k}")

        few = common.stored(few.select("lang", "size", *[discount(k) for k in (1, 2, 3)]))
        t = t.join(F.broadcast(few), "lang")  # a row for each language
        t = t.withColumn("ctx", F.shiftright("g", CHAR_BITS))
        t = t.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        heads = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        heads = common.stored(heads.select("lang", "ctx", "total", (F.col("freed") / F.col("total")).alias("gamma")))
        t = t.join(heads, ["lang", "ctx"])
        if n == 1:
            p = t.withColumn("below", 1 / (F.col("size") + 1))
        else:
            mask = (1 << CHAR_BITS * (n - 1)) - 1
            p = t.withColumn("tail", F.col("g").bitwiseAND(F.lit(mask))).join(lower, ["lang", "tail"])
        p = p.select("lang", "g", "c", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("below")).alias("p"))
        p = common.stored(p) if n < order else p
        rows = p.select(F.lit("p").alias("kind"), F.lit(n).alias("n"), "lang", "g", F.log10("p").alias("v"), "c")
        rows = rows.unionByName(heads.select(F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), "lang", F.col("ctx").alias("g"), F.log10("gamma").alias("v"), F.col("total").alias("c")))
        out = rows if out is None else out.unionByName(rows)
        lower = p.select("lang", F.col("g").alias("tail"), F.col("p").alias("below"))
    return out


class Table:
    """Keys in the order of their hash, values, and where each hash prefix begins."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = tv.mix(keys)
        order = np.argsort(h)
        self.bits = max(1, min(self.BITS, len(keys).bit_length()))
        self.keys, self.values = keys[order], values[order].astype(np.float64)
        self.start = np.searchsorted(h[order] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def find(self, g: np.ndarray) -> np.ndarray:
        slot = (tv.mix(g) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.start[slot]
        out = np.full(len(g), np.nan)
        if not len(self.keys):
            return out
        last = len(self.keys) - 1
        first = np.minimum(at, last)
        hit = self.keys[first] == g
        out[hit] = self.values[first[hit]]
        rest = np.flatnonzero(~hit & (self.start[slot + 1] - at > 1))
        for k in range(1, self.most):
            if not len(rest):
                break
            x = np.minimum(at[rest] + k, last)
            hit = self.keys[x] == g[rest]
            out[rest[hit]] = self.values[x[hit]]
            rest = rest[~hit & (self.start[slot[rest] + 1] - at[rest] > k + 1)]
        return out


class Model:
    """A table of whole n-grams for each (kind, order, language), and scoring by them."""

    def __init__(self, order: int, arrays: dict):
        self.order, self.tables = order, {k: Table(*v) for k, v in arrays.items()}

    def find(self, kind: str, n: int, lang: str, g: np.ndarray) -> np.ndarray:
        table = self.tables.get((kind, n, lang))
        return np.full(len(g), np.nan) if table is None else table.find(g)

    def score(self, g: np.ndarray, lang: str) -> np.ndarray:
        """log10 probability of the last character of each packed n-gram."""
        n = self.order
        out = self.find("p", n, lang, g)
        open_ = np.flatnonzero(np.isnan(out))
        weight = np.zeros(len(open_))
        while len(open_) and n > 1:
            x = g[open_] & np.uint64((1 << CHAR_BITS * n) - 1)
            weight += np.nan_to_num(self.find("b", n - 1, lang, x >> np.uint64(CHAR_BITS)), nan=0.0)
            n -= 1
            got = self.find("p", n, lang, x & np.uint64((1 << CHAR_BITS * n) - 1)) + weight
            out[open_] = got
            left = np.isnan(got)
            open_, weight = open_[left], weight[left]
        base = self.find("b", 0, lang, np.zeros(1, np.uint64))[0]
        # a language without counts: all characters are alike
        size = len(self.tables["p", 1, lang].keys) + 1 if ("p", 1, lang) in self.tables else 1 << CHAR_BITS
        out[open_] = weight + np.nan_to_num(base, nan=0.0) - np.log10(size)
        return out


def models(docs: DataFrame, order: int):
    """(lot, lots, Model) of every document of docs (text, lang): each model scores the n-grams of its lot."""
    counts = common.stored(count_ngrams(docs, order))
    rows = kneser_ney(counts, order).withColumn("kind", F.concat("kind", F.lit(":"), "lang"))
    # contexts and lower orders: about as many rows again
    for lot, lots, own in common.model_lots(rows.select("kind", "n", "g", "v"), CHAR_BITS, 2 * counts.count()):
        got = common.gathered(own.withColumnRenamed("g", "key")).items()
        yield lot, lots, Model(order, {(k[0], n, k[2:]): (keys.view(np.uint64), v) for (k, n), (keys, v) in got})


def fit(docs: DataFrame, order: int = 5) -> Model:
    """One model of every document of docs (text, lang), for small corpora."""
    rows = kneser_ney(count_ngrams(docs, order), order).withColumn("kind", F.concat("kind", F.lit(":"), "lang"))
    got = common.gathered(rows.select("kind", "n", F.col("g").alias("key"), "v")).items()
    return Model(order, {(k[0], n, k[2:]): (keys.view(np.uint64), v) for (k, n), (keys, v) in got})


def base_statistics(w: tv.Words) -> dict[str, np.ndarray]:
    """Statistics of each text, as whole numbers."""
    raw, offsets = w.raw, w.offsets

    def per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[at]).astype(np.int64)

    texts = len(offsets) - 1
    out = {"n_words": np.diff(w.first).astype(np.int64)}
    out["word_chars"] = per_text(((raw & 0xC0) != 0x80) & ~tv.SPACE[raw], offsets)
    out["n_symbols"] = per_text(SYMBOLS[raw], offsets)
    # lines lie between newlines and ends of texts; empty ones don't count
    ends = np.union1d(np.flatnonzero(raw == 10), offsets[1:])
    starts = np.concatenate([[0], ends[:-1] + (raw[ends[:-1]] == 10)])
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    s, e = starts[has], ends[has]
    doc = np.searchsorted(offsets, s, "right") - 1
    key = tv.mix(tv.span_hash(raw, s, e) + doc.astype(np.uint64) * np.uint64(tv.BASE))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=texts) - np.bincount(doc[first], minlength=texts)
    # words in 5-word windows that the text has twice
    g, ok = w.grams(5)
    of = w.doc()
    covered = np.zeros(len(of) + 1, np.int64)
    if len(g):
        at = np.flatnonzero(ok)
        key = tv.mix(g[at] + of[at].astype(np.uint64) * np.uint64(tv.BASE))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    out["n_repeat_words"] = per_text(np.cumsum(covered)[:-1] > 0, w.first)
    return out


SCORED = "doc_id long, th long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, log10_p double"


def score(docs: DataFrame, model: Model, lot: int, lots: int) -> DataFrame:
    """Base statistics (in lot 0, else null) and log10 probability of the lot's characters of every text (doc_id, th, lang, by, text); by: the language of the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by common.MODEL_ROWS

    def run(batches):
        m = shared.value
        for batch in batches:
            names, which = _by_lang(batch.column("by"), batch.num_rows)
            for a, b, raw, offsets in tv.slices(batch.column("text"), SCORE_BYTES):
                c, at = char_ids(raw, offsets)
                g = packed(c, at, m.order)
                of = np.repeat(which[a:b], np.diff(at))
                in_lot = common.lot_of(g >> np.uint64(CHAR_BITS) & np.uint64((1 << 2 * CHAR_BITS) - 1), lots) == lot
                p = np.zeros(len(g))
                for i in np.unique(which[a:b]):
                    own = (of == i) & in_lot
                    p[own] = m.score(g[own], names[i])
                out = base_statistics(tv.Words(raw, offsets)) if not lot else dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
                out["n_scored"] = np.diff(at).astype(np.int64)
                out["log10_p"] = np.diff(np.concatenate([[0.0], np.cumsum(p)])[at])
                part = batch.slice(a, b - a)
                cols = [pa.nulls(b - a, pa.int64()) if x is None else pa.array(x) for x in out.values()]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("doc_id", "th", "lang")), *cols], ["doc_id", "th", "lang", *out])
                del c, at, g, of, in_lot, p, out, cols
            tv.trim()

    return docs.select("doc_id", "th", "lang", "by", "text").mapInArrow(run, SCORED)


def scores(docs: DataFrame, order: int) -> DataFrame:
    """Base statistics and log10 probability of every row (doc_id, lang, text).

    Two models of each language, of the texts whose hash is even and odd, score each other's texts,
    so that no text is judged by its own counts or those of its copies.
    """
    th = F.xxhash64("text")
    rows = docs.withColumn("th", th)
    half = F.pmod(th, F.lit(2))
    fitted = docs.select("text", F.concat("lang", F.lit("/"), half.cast("string")).alias("lang"))
    rows = rows.withColumn("by", F.concat("lang", F.lit("/"), (1 - half).cast("string")))
    out = None
    for lot, lots, model in models(fitted, order):
        got = common.stored(score(rows, model, lot, lots))
        if out is None:
            out = got
            continue
        more = got.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("log10_p").alias("_p")).dropDuplicates(["_id", "_th"])
        out = out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th")), "left")
        out = out.withColumn("log10_p", F.col("log10_p") + F.coalesce("_p", F.lit(0.0))).drop("_id", "_th", "_p")
    return out


def bands(scored: DataFrame, width: float, floor: float) -> DataFrame:
    """(lang, low, high) of log10 perplexity a character: median and mean distance from it, from bins of 0.001 over all documents that pass the base rules."""
    x = scored.where(~F.col("base_failed") & F.col("log10_ppl").isNotNull()).groupBy("lang", F.round("log10_ppl", 3).alias("x")).agg(F.count("*").alias("n"))
    # a language has a few thousand bins at most
    by = Window.partitionBy("lang")
    x = x.withColumn("upto", F.sum("n").over(by.orderBy("x"))).withColumn("all", F.sum("n").over(by))
    x = x.withColumn("m", F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("x"))).over(by))
    x = x.withColumn("off", F.abs(F.col("x") - F.col("m"))).withColumn("near", F.sum("n").over(by.orderBy("off")))
    x = x.groupBy("lang").agg(F.first("m").alias("m"), F.min(F.when(2 * F.col("near") >= F.col("all"), F.col("off"))).alias("mad"))
    reach = F.greatest(F.lit(floor), width * 1.4826 * F.col("mad"))
    return x.select("lang", (F.col("m") - reach).alias("low"), (F.col("m") + reach).alias("high"))


def judge(
    docs: DataFrame,
    order: int = 5,
    width: float = 6.0,
    floor: float = 0.35,
    slack: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """A row for each row of docs: the base statistics, base_failed, log10_ppl (null: empty text), the band (low, high) of its language, kept.

    A null text is an empty one (fails the base rules); a null language is the
    language ''.  A null id and repeated rows are rows like any other; an empty table gives no rows.
    A document is kept if it passes the base rules and low <= log10_ppl <= high.  The band reaches at least `floor` from
    the median: on sf0.01 texts labelled clean stray by 0.30 (one by 0.47) beyond the slack of their length, symbol junk by 0.44 or more.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored = scores(rows, order)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = common.stored(scored.drop("th").select("*", failed.alias("base_failed"), F.when(F.col("n_scored") > 0, -F.col("log10_p") / F.col("n_scored")).alias("log10_ppl")))
    # the mean of a short text strays further
    stray = F.coalesce(F.try_divide(F.lit(slack), F.sqrt("n_scored")), F.lit(0.0))
    out = scored.join(F.broadcast(bands(scored, width, floor)), "lang", "left")  # a row for each language
    out = out.withColumn("low", F.col("low") - stray).withColumn("high", F.col("high") + stray)
    inside = F.col("log10_ppl").between(F.col("low"), F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op3_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log10_ppl", "low", "high")
