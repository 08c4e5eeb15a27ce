"""Small helpers of the operators: tables, checkpoints, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that count, under fixed names; other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The folder of sessions that run on this machine alone and name none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one of this machine only where all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = _OWN[0]
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends here: an eager checkpoint in the folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables go to all tasks only if they are measured to be at most this large.
BROADCAST_BYTES = 32 << 20


def is_small(df: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, a table that is cheap to read, have at most so many bytes by the given size of a row."""
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def sized(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if it is small; joins with a larger one are shuffled."""
    return F.broadcast(df) if is_small(df, size) else df


def cells(spark: SparkSession, least: int = 16) -> int:
    """Partitions for data that Python tasks read whole: as many as Spark's shuffles have, which the cluster sizes by its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for all ids in edges; component is the least id that can be reached.

    Large-star and small-star rounds until nothing changes.  Each round costs two
    shuffles of the edges; the number of rounds grows with the logarithm of the
    longest path.  Self loops and repeated edges are allowed.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        # large star: neighbours above u hang on u's least neighbour
        two = both.where("u <> v").unionByName(both.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, hang on the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        both_next = cut(small.where("u <> v").distinct())
        now = both_next.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        both = both_next
        if (now["n"], now["s"]) == seen:
            break
        seen = (now["n"], now["s"])
    ids = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    roots = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Folders that stored() has written in this process.
MADE: list[str] = []


def release(spark: SparkSession, folders: list[str], docs: DataFrame) -> list[str]:
    """Deletes those of the folders that docs does not read; returns the others."""
    read = docs.inputFiles() if folders else []
    kept = []
    for path in folders:
        if any(path.rsplit("/", 1)[1] in x for x in read):
            kept.append(path)
        else:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return kept


def discard(spark: SparkSession, made: int, *keep: DataFrame) -> None:
    """Deletes the folders that were made since there were `made`, but for those that the tables in `keep` read."""
    new = MADE[made:]
    for docs in keep:
        new = [x for x in new if not any(x.rsplit("/", 1)[1] in y for y in docs.inputFiles())]
    MADE[made:] = [x for x in MADE[made:] if x not in new]
    for path in new:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files of what is run inside go as soon as it ends; without this they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read again; smaller than a checkpoint for large tables.

    The files go when the driver's JVM ends: tables that read them may be used until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, column: str) -> DataFrame:
    """As stored(), in buckets of a column: what is grouped by it later reads them as they are, without a shuffle of df."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with shuffles_go(spark):
        df.write.bucketBy(cells(spark, 1), column).option("compression", "zstd").option("path", path).saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    MADE.append(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name alone: the files stay, as they have a path of their own
    return out


def sweep(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of plans that nobody holds any more, as it would when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gathered(rows: DataFrame, parts: int = 16) -> dict:
    """{(kind, n): (keys, values)} of rows (kind, n, key long, v double) on the driver, as plain arrays.

    The tasks pack them, so that the driver holds twelve to sixteen bytes a row and no row objects.
    The caller bounds the number of rows.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"kind": [first["kind"]], "n": [first["n"]], "keys": [pdf["key"].to_numpy(np.int64).tobytes()], "v": [pdf["v"].to_numpy(np.float64).tobytes()]})

    packed = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("kind", "n", "part").applyInPandas(pack, "kind string, n int, keys binary, v binary")
    held: dict = {}
    for r in stored(packed).toLocalIterator():
        held.setdefault((r["kind"], r["n"]), []).append((np.frombuffer(r["keys"], np.int64), np.frombuffer(r["v"], np.float64)))
    return {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) for k, v in held.items()}


#: Rows of a model that go to all tasks at once.
MODEL_ROWS = 6_000_000


def lot_of(context, lots: int):
    """The lot of a number of at most 24 bits, in Spark as in numpy."""
    if isinstance(context, Column):
        return F.pmod(F.shiftright(context * F.lit(2654435761), 20), F.lit(lots))
    return (context.astype(np.int64) * 2654435761 >> 20) % lots


def model_lots(rows: DataFrame, symbol_bits: int, least: int, most: int = 0):
    """(lot, lots, rows of the lot) of a back-off model (kind p or b first, n, g); least: about how many rows it has.

    All that an n-gram can be scored by has the same two symbols before the last one, by which the
    rows are dealt; n-grams of two and contexts of one are in all lots.
    """
    lots = max(1, -(-least // (most or MODEL_ROWS)))
    if lots == 1:
        yield 0, 1, rows
        return
    context = F.when(F.col("kind").startswith("p"), F.shiftright("g", symbol_bits)).otherwise(F.col("g")).bitwiseAND(F.lit((1 << 2 * symbol_bits) - 1))
    rows = stored(rows.withColumn("lot", F.when(F.col("n") >= F.when(F.col("kind").startswith("p"), 3).otherwise(2), lot_of(context, lots))))
    for lot in range(lots):
        yield lot, lots, rows.where(F.col("lot").isNull() | (F.col("lot") == lot)).drop("lot")
