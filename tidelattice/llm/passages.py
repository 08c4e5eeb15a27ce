"""What the two passage operators share: slices of the input, and which seeds recur.

A repeated window of W units (words or bytes) holds a seed of k units: the one whose
hash is least among the W - k + 1 in it.  Equal windows have equal seeds, so only
windows whose seed occurs twice need a closer look; a seed stands for about (W - k) / 2 windows.

The input is cut into slices of a few megabytes of whole texts.  A slice's seeds go, sorted
and packed, to buckets of the hash; each bucket tells each slice which of its seeds occur
elsewhere too.  A seed counts once a slice, so that a very common passage is as many rows as
there are slices, not occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textvec as tv

#: Seeds are compared by so many bits; a chance match only costs a closer look.
SEED_BITS = 48


def slice_rows(docs: DataFrame) -> DataFrame:
    """(slice, ids, there, lens, text): the rows (doc_id, text) of docs in packed slices, in their order.

    Slices are numbered as they are cut, which hangs on the splits of this one scan; so they are stored here
    once, and all that follows reads what was stored, whatever executors come or go.
    """

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, raw, offsets in tv.slices(batch.column("text")):
                ids = batch.column("doc_id").slice(a, b - a)
                there = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.int64)
                text = pa.compress(raw.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""
                packed = [np.asarray(ids.fill_null(0), np.int64).tobytes(), there.tobytes(), np.diff(offsets).astype(np.int64).tobytes(), text]
                yield pa.RecordBatch.from_arrays([pa.array([task << 20 | made]), *[pa.array([x], pa.binary()) for x in packed]], ["slice", "ids", "there", "lens", "text"])
                made += 1

    return common.stored(docs.select("doc_id", "text").mapInArrow(run, "slice long, ids binary, there binary, lens binary, text binary"))


class Slice:
    def __init__(self, row):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.there = np.frombuffer(row["there"], np.int64) == 1
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))])
        size = int(self.offsets[-1])
        self.raw = np.frombuffer(pa.decompress(row["text"], size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (tv.mix(h) >> np.uint64(33)).astype(np.int64) % buckets


def deal(h: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of the values of each bucket, in the order of the values; h ascending."""
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    return np.split(order, np.searchsorted(b[order], np.arange(1, buckets)))


def recurring(slices: DataFrame, seeds_of: Callable[[Slice], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(slice, bucket, seeds, letters): the slice's seeds (ascending, packed) that occur twice or more in all, and what they spell.

    seeds_of gives the hash of each seed and a row of bytes for each, of one width (none, if nobody needs them).
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, letters = seeds_of(Slice(row))
                order = np.argsort(h, kind="stable")
                h = h[order]
                new = np.flatnonzero(tv.changes(h)) if len(h) else np.zeros(0, np.int64)
                twice = np.diff(np.append(new, len(h))) > 1
                h, letters = h[new], letters[order[new]]
                rows = {"slice": [], "bucket": [], "seeds": [], "twice": [], "letters": []}
                for k, own in enumerate(deal(h, buckets)):
                    if len(own):
                        rows["slice"].append(row["slice"])
                        rows["bucket"].append(k)
                        rows["seeds"].append(tv.squeeze(tv.rising(h[own])))
                        rows["twice"].append(np.packbits(twice[own]).tobytes())
                        rows["letters"].append(letters[own].tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), *[(x, pa.binary()) for x in ("seeds", "twice", "letters")]]))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["seeds"]]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(pdf["twice"], h, strict=True)]) == 1
        every = np.concatenate(h)
        order = np.argsort(every)
        same = every[order][1:] == every[order][:-1]
        again = twice.copy()
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        # a seed that one slice has twice recurs in every slice that has it: equal neighbours are flagged above
        out, letters, at = [], [], 0
        for x, y in zip(h, pdf["letters"], strict=True):
            own = again[at : at + len(x)]
            out.append(tv.squeeze(tv.rising(x[own])))
            letters.append(np.frombuffer(y, np.uint8).reshape(len(x), -1)[own].tobytes())
            at += len(x)
        return pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "seeds": out, "letters": letters})

    sent = slices.mapInArrow(send, "slice long, bucket int, seeds binary, twice binary, letters binary")
    return sent.groupBy("bucket").applyInPandas(meet, "slice long, bucket int, seeds binary, letters binary")


def unpack_sorted(blobs) -> np.ndarray:
    parts = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in blobs]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values of x are in the ascending array `among`."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Units covered by windows of so many units at the (distinct) starts."""
    steps = np.zeros(size + 1, np.int32)
    steps[starts] += 1
    steps[starts + length] -= 1
    return np.cumsum(steps)[:-1] > 0


def inside(offsets: np.ndarray, there: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of so many units that lie in one text that has an id."""
    n = np.where(there, np.maximum(np.diff(offsets) - length + 1, 0), 0)
    return np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))


def _packed_schema(names: list[str]) -> str:
    return "slice long, bucket int, " + ", ".join(f"{x} binary" for x in ("key", *names))


def entries(slices: DataFrame, of: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]], names: list[str], buckets: int) -> DataFrame:
    """Packed entries (slice, bucket, key, names): what `of` gives for each row of slices, keys and whole numbers beside them, dealt to buckets by the key's hash."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key, columns = of(row)
                order = np.argsort(key, kind="stable")
                key, columns = key[order], [np.ascontiguousarray(x[order]) for x in columns]
                rows: dict = {x: [] for x in ("slice", "bucket", "key", *names)}
                for b, own in enumerate(deal(key, buckets)):
                    if len(own):
                        rows["slice"].append(row["slice"])
                        rows["bucket"].append(b)
                        rows["key"].append(tv.squeeze(tv.rising(key[own])))
                        for name, x in zip(names, columns, strict=True):
                            rows[name].append(tv.squeeze(x[own]))
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), *[(x, pa.binary()) for x in ("key", *names)]]))
                del key, columns, order, rows
            tv.trim()

    return slices.mapInArrow(run, _packed_schema(names))


def unpacked(pdf: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Slice, key and the columns of all entries of packed rows."""
    keys = [np.cumsum(tv.unsqueeze(x), dtype=np.uint64) for x in pdf["key"]]
    columns = [np.concatenate([np.zeros(0, np.int64), *[tv.unsqueeze(x).view(np.int64) for x in pdf[name]]]) for name in names]
    return np.repeat(pdf["slice"].to_numpy(np.int64), [len(x) for x in keys]), np.concatenate([np.zeros(0, np.uint64), *keys]), columns


def regrouped(packed: DataFrame, by: str, names: list[str], f: Callable, out: list[str]) -> DataFrame:
    """Packed entries again, grouped by "bucket" or by "slice": f(slice, key, columns) says which stay, and the columns of all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slice_of, key, columns = unpacked(pdf, names)
        use, columns = f(slice_of, key, columns)
        rows: dict = {x: [] for x in ("slice", "bucket", "key", *out)}
        at = 0
        for s, b, x in zip(pdf["slice"].tolist(), pdf["bucket"].tolist(), pdf["key"], strict=True):
            own = slice(at, at + int.from_bytes(x[:6], "little"))
            at = own.stop
            mine = use[own]
            if mine.any():
                rows["slice"].append(s)
                rows["bucket"].append(b)
                rows["key"].append(tv.squeeze(tv.rising(key[own][mine])))
                for name, c in zip(out, columns, strict=True):
                    rows[name].append(tv.squeeze(np.ascontiguousarray(c[own][mine])))
        del slice_of, key, columns, use
        tv.trim()
        return pd.DataFrame(rows)

    return packed.groupBy(by).applyInPandas(run, _packed_schema(out))


def beside(slices: DataFrame, packed: DataFrame, names: list[str], f: Callable[..., bytes], name: str) -> DataFrame:
    """slices with a column of bytes: what f makes of the slice, key and columns of its packed entries (null for none). It goes to all tasks if it is measured to be small, else both are shuffled."""
    made = packed.groupBy("slice").applyInPandas(lambda pdf: pd.DataFrame({"slice": pdf["slice"].iloc[:1], name: [f(*unpacked(pdf, names))]}), f"slice long, {name} binary")
    made = common.stored(made)
    return slices.join(common.sized(made, F.octet_length(name) + 16), "slice", "left")
