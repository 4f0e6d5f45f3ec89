"""Packing: length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_rank


def words(text: Column) -> Column:
    """Tokens by ASCII white space, from the whole text; null and empty texts have none."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(t.as_py().split()) if t.is_valid else 0 for t in texts], pa.int64())

    return count(text.cast("binary"))


def optimal_buckets(length: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding, by dynamic programming over cells in order of length.

    A bucket of cells i..j pads its ``count`` rows to length[j]; ``total`` is what they hold. best[j] after k buckets is the minimum over the last bucket's first cell i of
    best[i - 1] + total before i - length[j] * rows before i, and a part of j alone: a line in length[j] for each i. Slopes fall and lengths rise, so a
    queue of the lines on the lower hull gives all minima of a round in one pass, and every length can have its own cell. Whole numbers, of any size.
    """
    m = len(length)
    if not m:
        return []
    x = length.tolist()
    rows, held = [0], [0]
    for c, t in zip(count.tolist(), total.tolist(), strict=True):
        rows.append(rows[-1] + c)
        held.append(held[-1] + t)
    best = [x[j] * rows[j + 1] - held[j + 1] for j in range(m)]
    back = [[0] * m]
    for _ in range(1, min(buckets, m)):
        hull: list[tuple[int, int, int]] = []  # slope, height, cell
        new, first, head = [], [], 0
        for j in range(m):
            slope, height = -rows[j], held[j] + (best[j - 1] if j else 0)
            while len(hull) - head >= 2 and (height - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                hull.pop()
            hull.append((slope, height, j))
            while len(hull) - head >= 2 and hull[head + 1][0] * x[j] + hull[head + 1][1] <= hull[head][0] * x[j] + hull[head][1]:
                head += 1
            new.append(hull[head][0] * x[j] + hull[head][1] + x[j] * rows[j + 1] - held[j + 1])
            first.append(hull[head][2])
        best = new
        back.append(first)
    bounds, j = [], m - 1
    for first in reversed(back):
        bounds.append(x[j])
        j = first[j] - 1
        if j < 0:
            break
    return sorted(set(bounds))


def length_histogram(df: DataFrame, length: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, rows, sum of lengths) of each length that occurs: as many numbers as the longest text has tokens at most, however many texts there are."""
    cells = df.groupBy(F.col(length).alias("length")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    size, n = (cells[c].to_numpy() for c in ("length", "n"))
    return size, n, size * n


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 16, budget: int = 65_536, rows_per_range: int = 65_536, seed: int = 5) -> DataFrame:
    """``docs`` with n_tokens, bucket (from 0, by length), bucket_tokens (what its rows are padded to), batch (from 0 in the bucket) and place in the batch.

    The bucket bounds minimise padding over the histogram of all lengths. A batch of a bucket holds budget // bucket_tokens rows (one at
    least, so a text above the budget is a batch of its own), in a random order fixed by ``seed``; only a bucket's last batch is
    smaller. Ranks are exact at any size of bucket (see ``exact_rank``), so a bucket with a third of all rows is many tasks.

    Null and empty texts have length 0 and go to the first bucket. Repeated rows are rows like others. Columns named as the
    results are replaced. An empty table gives no rows.
    """
    added = ("n_tokens", "bucket", "bucket_tokens", "batch", "place")
    kept = [c for c in docs.columns if c not in added]
    inner = [f"_in{k}" for k in range(len(kept))]  # apart from the columns of the ranks; what a caller drops is never shuffled
    count_words = words(F.col(f"`{text}`"))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], count_words.alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("_h"), F.xxhash64(F.col(f"`{text}`"), F.col(f"`{key}`")).alias("_h2"),
    )
    length, count, held = length_histogram(docs.select(count_words.alias("n_tokens")), "n_tokens")
    bounds = optimal_buckets(length, count, held, buckets) or [0]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    rows = rows.withColumn("bucket", F.size(F.filter(array, lambda b: b < F.col("n_tokens"))))
    ranked = exact_rank(rows, ["bucket"], "_h", ["_h2"], max(1, -(-int(count.sum()) // rows_per_range)), "rank")
    top = F.get(array, F.col("bucket"))
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(top, F.lit(1))).cast("long"))
    back = [F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)]
    return ranked.select(*back, "n_tokens", "bucket", top.alias("bucket_tokens"), F.floor(F.col("rank") / each).cast("long").alias("batch"), (F.col("rank") % each).alias("place"))
