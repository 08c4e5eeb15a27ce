"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Postings (term, doc_id, pos) of every document are stored for the terms that the
benchmark uses.  A window's lists are shifted by the offset of their term, so that an
occurrence is one start that all lists share; they are intersected from the two rarest on, and
only what both share is looked up in the longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hash classes of document ids.
CLASSES = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in lower case (A-Z); none in a null."""
    parts = F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda x: x != "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, win, len, terms): all windows of so many consecutive words; a shorter item is one window, one without words has none."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(size)))
    w = w.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    w = w.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("terms"))
    return w.withColumn("win", F.xxhash64(F.array_join("terms", " "))).select("item_id", "win", "len", "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, pos): the positions of the given terms in all documents (doc_id, text)."""
    every = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    terms = common.sized(terms, F.octet_length("term") + 32)
    return common.stored(every.join(terms, "term", "left_semi").select("term", "doc_id", "pos"))


def ranked_terms(wins: DataFrame, index: DataFrame) -> DataFrame:
    """(win, len, off, term, rank) of the windows all of whose terms occur; rank 1 is the rarest term."""
    lengths = index.groupBy("term").agg(F.count("*").alias("n"))
    each = wins.select("win", "len", F.posexplode("terms").alias("off", "term")).join(lengths, "term")
    by = Window.partitionBy("win")
    each = each.withColumn("found", F.count("*").over(by)).where("found = len")
    return each.withColumn("rank", F.row_number().over(by.orderBy("n", "term", "off"))).select("win", "len", "off", "term", "rank")


def pairs_of(ranked: DataFrame) -> DataFrame:
    """(win, len, off, t1, t2, delta, pair): the two rarest terms of each window and the distance of the second from the first.

    Windows that overlap mostly share these; pair names one (t1, t2, delta), null for a window of one word.
    """
    one = ranked.where("rank = 1").select("win", "len", "off", F.col("term").alias("t1"))
    two = ranked.where("rank = 2").select("win", F.col("off").alias("off2"), F.col("term").alias("t2"))
    out = one.join(two, "win", "left").withColumn("delta", F.col("off2") - F.col("off"))
    return out.withColumn("pair", F.when(F.col("t2").isNotNull(), F.xxhash64("t1", "t2", "delta"))).drop("off2")


def phrases(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, len, doc_id, start): exact occurrences of the windows.

    The lists of a pair are intersected once for all windows that have it.  What hangs on the
    benchmark alone is broadcast where its measured size allows.
    """
    ranked = common.cut(ranked_terms(wins.select("win", "len", "terms").dropDuplicates(["win"]), index))
    tops = common.cut(pairs_of(ranked))
    width = F.octet_length("t1") + F.coalesce(F.octet_length("t2"), F.lit(0)) + 96
    pairs = common.sized(tops.where("pair is not null").select("pair", "t1", "t2", "delta").distinct(), width)
    own = common.sized(tops, width)

    one = index.join(pairs, F.col("term") == F.col("t1")).select("pair", "doc_id", F.col("pos").alias("at"))
    two = index.join(pairs, F.col("term") == F.col("t2")).select("pair", "doc_id", (F.col("pos") - F.col("delta")).alias("at")).where("at >= 0")
    both = one.join(two, ["pair", "doc_id", "at"], "left_semi").join(own.select("pair", "win", "len", "off"), "pair")
    single = index.join(own.where("pair is null").select("win", "len", "off", "t1"), F.col("term") == F.col("t1")).select("win", "len", "off", "doc_id", F.col("pos").alias("at"))
    starts = both.select(*single.columns).unionByName(single).select("win", "len", "doc_id", (F.col("at") - F.col("off")).alias("start"))
    starts = common.cut(starts.where("start >= 0").distinct())

    others = common.sized(ranked.where("rank > 2").select("win", "off", "term"), F.octet_length("term") + 64)
    need = starts.join(others, "win").select("win", "doc_id", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    # most documents hold no candidate: a broadcast of hash classes, at most CLASSES rows whatever the corpus, spares their postings the shuffle
    cls = F.pmod(F.xxhash64("doc_id"), F.lit(CLASSES)).cast("int")
    near = index.withColumn("cls", cls).join(F.broadcast(starts.select(cls.alias("cls")).distinct()), "cls", "left_semi").drop("cls")
    met = need.join(near, ["doc_id", "pos", "term"], "left_semi").groupBy("win", "doc_id", "start").agg(F.countDistinct("pos").alias("n"))
    return starts.join(met, ["win", "doc_id", "start"], "left").where(F.coalesce("n", F.lit(0)) == F.greatest(F.col("len") - 2, F.lit(0))).select("win", "len", "doc_id", "start")


def proximity(index: DataFrame, wins: DataFrame, slop: int = 8) -> DataFrame:
    """(win, doc_id, start, shift): places where the two rarest terms of a window stand in a document at most
    slop words off their distance in the window; shift 0 is the exact distance.  Windows of one word have none."""
    ranked = common.cut(ranked_terms(wins.select("win", "len", "terms").dropDuplicates(["win"]), index))
    one, two = (index.join(ranked.where(F.col("rank") == k), "term").select("win", "doc_id", (F.col("pos") - F.col("off")).alias("start")) for k in (1, 2))
    cell = F.floor(F.col("start") / (slop + 1))
    one = one.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    two = two.select("win", "doc_id", F.col("start").alias("other"), F.floor(F.col("start") / (slop + 1)).alias("cell"))
    near = one.join(two, ["win", "doc_id", "cell"]).withColumn("shift", F.col("other") - F.col("start"))
    return near.where(F.abs("shift") <= slop).select("win", "doc_id", "start", "shift").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for every row of docs.

    items: item_id, text.  A document word inside an occurrence of a window is hit;
    contaminated: some word is hit, and at least percent of 100 words are.  A null
    text has no words.  A null id is one like any other; rows that repeat an id and
    text have the same result, those that repeat an id alone their own; other columns are not looked at; items with a null id are left out; an empty table on either side gives no hits.
    """
    docs = common.texts(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    wins = common.cut(windows(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null"), size))
    index = build_index(docs.select(F.col("row").alias("doc_id"), "text"), wins.select(F.explode("terms").alias("term")).distinct())
    found = common.cut(phrases(index, wins))
    # starts of a document in runs: a word is counted once, however many windows cover it
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = found.select("doc_id", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    hits = spans.select("doc_id", new.alias("new")).groupBy("doc_id").agg(F.sum("new").cast("long").alias("n_hit"))
    own = found.select("win", "doc_id").distinct().join(wins.select("win", "item_id").distinct(), "win").groupBy("doc_id")
    own = own.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(hits.join(own, "doc_id").withColumnRenamed("doc_id", "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated")
    )


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT g.doc_id, g.i, g.k, win.item FROM g JOIN win ON g.k = win.k AND g.s = win.s),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
