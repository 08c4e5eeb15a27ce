"""Orders, deduplication, quotas and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_at_first_place(rows: DataFrame, key: str, place: str) -> DataFrame:
    """One row a key: the last value, at the place where the key first stood."""
    w = Window.partitionBy(key)
    x = rows.withColumns({"_first": F.min(place).over(w), "_last": F.max(place).over(w)})
    return x.where(F.col(place) == F.col("_last")).withColumn(place, F.col("_first")).drop("_first", "_last")


def market_order(rows: DataFrame, groups: list[str], group: str, *names: str) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(rank > 0, rank).otherwise(len(groups) + 1), *names)))


def round_robin(rows: DataFrame, category: str, metric: str, name: str, quota: int | None = None) -> DataFrame:
    """Best of each category first, then the second ones, and so on; at most quota of each."""
    x = rows.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(F.desc_nulls_last(metric), name)))
    x = x if quota is None else x.where(F.col("turn") <= quota)
    return x.withColumn("place", F.row_number().over(Window.orderBy("turn", category)))


def by_metrics(*metrics: str) -> list[Column]:
    """Descending, missing last, for orderBy."""
    return [F.desc_nulls_last(m) for m in metrics]


def merge_rankings(rankings: list[list], limit: int, quotas: list | None = None) -> list:
    """Names of several rankings, one from each in turn, each once; quotas come first."""
    out = list(dict.fromkeys(quotas or []))[:limit]
    seen, cursors = set(out), [0] * len(rankings)
    while len(out) < limit and any(c < len(r) for c, r in zip(cursors, rankings, strict=True)):
        for i, r in enumerate(rankings):
            while cursors[i] < len(r) and r[cursors[i]] in seen:
                cursors[i] += 1
            if cursors[i] < len(r) and len(out) < limit:
                out.append(r[cursors[i]])
                seen.add(r[cursors[i]])
    return out


def diverse(scores: np.ndarray, vectors: np.ndarray, n: int) -> list[int]:
    """Two fifths by score; the others by 0.7 of quality and 0.3 of distance from those chosen."""
    order = np.argsort(-scores, kind="stable")
    chosen = order[: max(1, int(np.ceil(0.4 * n)))].tolist()
    span = float(np.ptp(scores)) or 1.0
    quality = (scores - scores.min()) / span
    while len(chosen) < min(n, len(scores)):
        d = np.sqrt(((vectors[:, None, :] - vectors[None, chosen, :]) ** 2).mean(axis=2)).min(axis=1)
        value = 0.7 * quality + 0.3 * d
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
    return chosen


def evolve(evaluate, dims: int, members: int, generations: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """Differential evolution on the unit cube: Latin start, steps towards good members and along differences, kept if better.

    evaluate(matrix) gives the scores of a whole generation: one distributed job.
    """
    rng = np.random.default_rng(seed)
    x = np.stack([(rng.permutation(members) + rng.random(members)) / members for _ in range(dims)], axis=1)
    score = np.asarray(evaluate(x))
    for _ in range(generations):
        f, cr = np.clip(rng.normal(0.5, 0.15, members), 0.1, 1.0), np.clip(rng.normal(0.7, 0.1, members), 0.0, 1.0)
        top = np.argsort(-score)[: max(2, members // 10)]
        best = x[rng.choice(top, members)]
        one, two = x[rng.integers(0, members, members)], x[rng.integers(0, members, members)]
        trial = np.clip(x + f[:, None] * (best - x) + f[:, None] * (one - two), 0, 1)
        take = rng.random((members, dims)) < cr[:, None]
        take[np.arange(members), rng.integers(0, dims, members)] = True
        trial = np.where(take, trial, x)
        new = np.asarray(evaluate(trial))
        better = new > score
        x[better], score[better] = trial[better], new[better]
    k = int(np.argmax(score))
    return x[k], float(score[k])
