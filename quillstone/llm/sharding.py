"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import exact_rank, hash_range


def _let(fields: dict[str, Column], body) -> Column:
    """``body`` of a struct of ``fields``, each evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])), body)[0]


def _span(lo: Column, hi: Column) -> Column:
    """lo..hi, empty if hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(n: Column, k: Column, total: Column, u: Column) -> Column:
    """How many of ``k`` marked among ``total`` fall in a draw of ``n``: the inverse distribution at ``u`` in [0, 1).

    Weights start at 1 at the mode and follow the ratio of neighbouring probabilities, so no factorial is needed;
    nine standard deviations each way hold all mass that a double can show.
    """
    zero = F.lit(0).cast("bigint")

    def walk(x, down: bool, stop: Column) -> Column:
        """Sums the weights from the mode outwards; remembers where the sum first passes ``stop``."""
        N, K, T = x["n"], x["k"], x["total"]

        def step(acc, i):
            d = i.cast("double")
            up = (N - d) * (K - d) / ((d + 1) * (T - N - K + d + 1))
            dn = d * (T - N - K + d) / ((N - d + 1) * (K - d + 1))
            w = acc["w"] * (dn if down else up)
            s = acc["s"] + w
            at = F.when(acc["at"].isNotNull(), acc["at"]).when(s > stop, i + (-1 if down else 1))
            return F.struct(w.alias("w"), s.alias("s"), at.alias("at"))

        steps = F.reverse(_span(x["lo"] + 1, x["mode"])) if down else _span(x["mode"], x["hi"] - 1)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("bigint").alias("at"))
        return F.aggregate(steps, start, step)

    def bounded(x) -> Column:
        wide = F.ceil(9 * F.sqrt(F.greatest(x["var"], F.lit(0.0)))) + 24
        return _let(
            {"n": x["n"], "k": x["k"], "total": x["total"], "u": x["u"], "mode": x["mode"], "lo": F.greatest(x["lo"], x["mode"] - wide), "hi": F.least(x["hi"], x["mode"] + wide)},
            weighed,
        )

    def weighed(x) -> Column:
        none = F.lit(float("inf"))
        return _let({**{c: x[c] for c in ("n", "k", "total", "u", "mode", "lo", "hi")}, "up": walk(x, False, none)["s"], "down": walk(x, True, none)["s"]}, chosen)

    def chosen(x) -> Column:
        at = x["u"] * (1 + x["up"] + x["down"])
        above = F.coalesce(walk(x, False, at - 1)["at"], x["hi"])
        below = F.coalesce(walk(x, True, at - 1 - x["up"])["at"], x["lo"])
        return F.when(at < 1, x["mode"]).when(at < 1 + x["up"], above).otherwise(below)

    dn, dk, dt = (c.cast("double") for c in (n, k, total))
    lo, hi = F.greatest(zero, n + k - total), F.least(n, k)
    mode = F.least(hi, F.greatest(lo, F.floor((dn + 1) * (dk + 1) / (dt + 2))))
    var = F.when(total > 1, dn * dk / dt * (1 - dk / dt) * (dt - dn) / (dt - 1)).otherwise(F.lit(0.0))
    return _let({"n": n, "k": k, "total": total, "u": u, "lo": lo, "hi": hi, "mode": mode, "var": var}, bounded)


def _draw(n: Column, counts: Column, shards: int, seed: Column) -> Column:
    """A multivariate hypergeometric draw of ``n`` rows from ``counts`` rows for each shard."""

    def step(acc, s):
        k = F.get(counts, s)
        u = F.shiftrightunsigned(F.xxhash64(seed, s), 11) / F.lit(float(1 << 53))
        x = hypergeometric(acc["n"], k, acc["left"], u)
        return _let({"x": x, "n": acc["n"], "left": acc["left"], "out": acc["out"], "k": k}, lambda y: F.struct((y["n"] - y["x"]).alias("n"), (y["left"] - y["k"]).alias("left"), F.concat(y["out"], F.array(y["x"])).alias("out")))

    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)
    start = F.struct(n.alias("n"), total.alias("left"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step)["out"]


def communication_matrix(sizes: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """(part, n) of 2**levels parts to (part, counts): how many rows each part sends to each shard.

    The parts form a binary tree. At its root the counts are the shards' exact sizes; each node splits its
    counts between its halves by a multivariate hypergeometric draw, so rows of the matrix sum to the parts and
    columns to the shards, with the law of a uniform shuffle. Draws come from hashes of the seed: every rerun
    makes the same matrix.
    """
    spark = sizes.sparkSession
    parts = spark.range(1 << levels).withColumnRenamed("id", "part").join(sizes, "part", "left")
    root = parts.agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("n", F.lit(0)).alias("n")))).alias("x")).select(
        F.lit(0).cast("bigint").alias("part"), F.expr("transform(x, y -> cast(y.n as bigint))").alias("sizes")
    )
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, b: a + b)
    total = add(F.col("sizes"))
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0)).cast("bigint"))
    node = root.select("part", "sizes", share.alias("counts"), F.lit(0).alias("level"))
    half = (F.size("sizes") / 2).cast("int")
    left, right = F.slice("sizes", F.lit(1), half), F.slice("sizes", half + 1, half)
    drawn = _draw(add(left), F.col("counts"), shards, F.xxhash64(F.lit(seed), F.col("level"), F.col("part")))
    rest = F.zip_with("counts", "drawn", lambda a, b: a - b)
    two = F.array(
        F.struct((F.col("part") * 2).alias("part"), left.alias("sizes"), F.col("drawn").alias("counts"), (F.col("level") + 1).alias("level")),
        F.struct((F.col("part") * 2 + 1).alias("part"), right.alias("sizes"), rest.alias("counts"), (F.col("level") + 1).alias("level")),
    )
    for level in range(levels):
        if level == 6:  # many parts: the rest of the tree is drawn by many tasks
            node = node.repartition("part")
        node = node.withColumn("drawn", drawn).select(F.explode(two).alias("x")).select("x.*")
    return node.select("part", "counts")


def shuffle_into_shards(df: DataFrame, key: str, shards: int = 24, seed: int = 11, rows_per_part: int = 65_536, min_levels: int = 4) -> DataFrame:
    """All rows of ``df`` in a uniformly random order, dealt into ``shards`` shards whose counts differ by one at most.

    Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard); columns of these names in ``df`` are
    replaced. Parts are blocks of a hash of the key, so the result doesn't depend on how the input was laid out, and a
    lost task makes the same rows again. Each part permutes its rows and deals them out by its row of the communication
    matrix; each shard permutes what it got. Parts and permuted ranges hold about ``rows_per_part`` rows, so tasks stay
    bounded at any size. Repeated rows are rows like others; null keys hash like a value; an empty input gives no rows.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{key}`").alias("_key"))
    rows = rows.select("row", F.xxhash64(F.lit(seed), F.xxhash64("_key"), F.xxhash64("row")).alias("_h1"), F.xxhash64(F.lit(seed + 1), F.xxhash64("row"), F.xxhash64("_key")).alias("_h2"))
    n = df.count()
    levels = min_levels
    while (1 << levels) * rows_per_part < n:
        levels += 1
    rows = rows.withColumn("part", hash_range(F.col("_h1"), 1 << levels))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    matrix = communication_matrix(sizes, levels, shards, seed + 2)
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("counts", F.lit(1), s), F.lit(0).cast("bigint"), lambda a, b: a + b))
    matrix = matrix.select("part", upto.alias("upto"))
    local = W.partitionBy("part").orderBy("_h1", "_h2")
    dealt = rows.withColumn("_r", F.row_number().over(local)).join(matrix, "part")
    dealt = dealt.select("row", "_h2", "_h1", F.size(F.filter("upto", lambda c: c < F.col("_r"))).alias("shard"))
    ranges = max(1, -(-n // (shards * rows_per_part)))
    out = exact_rank(dealt, ["shard"], "_h2", ["_h1"], ranges, "slot")
    return out.select("row.*", "shard", "slot")
