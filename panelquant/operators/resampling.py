"""Bootstrap intervals and significance. Uniform numbers come from hashes of (seed, tag, replicate, position): order plays no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import log
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelquant.functions.columns import DAYS, NO_DEVIATION, ordered, ratio, so_far

EULER_GAMMA = 0.5772156649015329


def uniform(seed: int, tag: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def bootstrap_index(spark: SparkSession, n: DataFrame, replicates: int, mean_block: float = 20.0, seed: int = 0) -> DataFrame:
    """(rep, pos, idx) of stationary bootstrap samples for each length in ``n`` (column n): blocks of geometric length.

    A block starts at position 0 and at each later one with chance 1 / mean_block, at a uniform index; indices wrap around.
    """
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("rep"))
    grid = n.select("n").distinct().crossJoin(reps)  # lengths are few, replicates a parameter
    grid = grid.select("n", "rep", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos"))
    starts = (F.col("pos") == 0) | (uniform(seed, "restart", F.col("rep"), F.col("pos")) < 1.0 / mean_block)
    block = F.when(starts, F.struct(F.col("pos").alias("p"), F.floor(uniform(seed, "start", F.col("rep"), F.col("pos")) * F.col("n")).alias("s")))
    last = F.last(block, ignorenulls=True).over(so_far(ordered(["n", "rep"], "pos")))
    return grid.withColumn("b", last).select("n", "rep", "pos", F.pmod(F.col("b.s") + F.col("pos") - F.col("b.p"), F.col("n")).cast("int").alias("idx"))


def series_arrays(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str = "date") -> DataFrame:
    """One row a key: its values in order, as arrays, and their number."""
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, *columns))).alias("s"))
    return rows.select(*keys, F.size("s").alias("n"), *[F.col("s").getField(c).alias(c) for c in columns])


def sample_indices(seed: int, replicate: int, n: int, mean_block: float) -> np.ndarray:
    """One replicate of :func:`bootstrap_index`: the same hashes, the same positions."""

    def draws(tag: str, positions) -> np.ndarray:
        head = hashlib.md5(f"{seed}:{tag}:{replicate}:".encode())
        out = []
        for p in positions:
            own = head.copy()
            own.update(b"%d" % p)
            out.append(int.from_bytes(own.digest()[:6], "big"))
        return np.array(out, np.float64) / float(1 << 48)

    starts = draws("restart", range(n)) < 1.0 / mean_block
    starts[0] = True
    at = np.flatnonzero(starts)
    begin = np.floor(draws("start", at.tolist()) * n).astype(np.int64)
    block = np.cumsum(starts) - 1
    return (begin[block] + np.arange(n) - at[block]) % n


def resampled(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], replicates: int, mean_block: float, seed: int, by: str = "date", block: int = 50) -> DataFrame:
    """(keys, rep, mean and population deviation of each column): replicates use the same indices for all columns.

    A task row is a key's arrays and ``block`` replicates, and rows of one length and block meet in a
    task, which draws their indices once. Where there are more cores than blocks, a block's keys are
    dealt over several tasks. No index is shuffled.
    """
    keys, columns = list(keys), list(columns)
    parts = -(-replicates // block)
    salt = max(1, rows.sparkSession.sparkContext.defaultParallelism // parts)
    spread = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = series_arrays(rows, keys, columns, by).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    work = work.repartition(spread, "n", "part", F.pmod(F.xxhash64(*keys), F.lit(salt))).sortWithinPartitions("n", "part")
    names = [f"{name}_{c}" for c in columns for name in ("mean", "dev")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: tuple = (None, None)
        for batch in batches:
            for row in batch.to_dict("records"):
                reps = range(row["part"] * block, min(replicates, (row["part"] + 1) * block))
                if drawn[0] != (row["n"], row["part"]):
                    drawn = (row["n"], row["part"]), np.array([sample_indices(seed, rep, row["n"], mean_block) for rep in reps])
                out = {}
                for c in columns:
                    own = np.asarray(row[c], np.float64)[drawn[1]]
                    if np.isnan(own).any():
                        kept = [x[~np.isnan(x)] for x in own]
                        out[f"mean_{c}"] = [x.mean() if len(x) else None for x in kept]
                        out[f"dev_{c}"] = [x.std() if len(x) else None for x in kept]
                    else:
                        out[f"mean_{c}"], out[f"dev_{c}"] = own.mean(1), own.std(1)
                yield pd.DataFrame({**{k: [row[k]] * len(reps) for k in keys}, "rep": reps, **out})[[*keys, "rep", *names]]

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "rep int", *[f"{c} double" for c in names]])
    return work.select(*keys, "n", "part", *columns).mapInPandas(run, schema)


def sharpe_interval(rows: DataFrame, keys: Sequence[str], column: str = "ret", replicates: int = 2000, mean_block: float = 20.0, seed: int = 0, by: str = "date", periods: int = DAYS) -> DataFrame:
    """(keys, sharpe_point, sharpe_low, sharpe_high): the point has the sample deviation, replicates the population's; 5 and 95 %.

    ``mean_block`` 1 draws independently.
    """
    reps = resampled(rows, keys, [column], replicates, mean_block, seed, by)
    reps = reps.withColumn("sharpe", ratio(F.col(f"mean_{column}"), F.col(f"dev_{column}"), periods))
    ends = reps.groupBy(*keys).agg(F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    point = rows.groupBy(*keys).agg(ratio(F.avg(column), F.stddev_samp(column), periods).alias("sharpe_point"))
    return point.join(ends, list(keys)).select(*keys, "sharpe_point", F.col("q")[0].alias("sharpe_low"), F.col("q")[1].alias("sharpe_high"))


def paired_interval(rows: DataFrame, keys: Sequence[str], a: str, b: str, replicates: int = 2000, mean_block: float = 20.0, seed: int = 0, by: str = "date", periods: int = DAYS) -> DataFrame:
    """Difference of two series' Sharpe ratios over the same resampled days: 2.5 and 97.5 %, and the share not above 0."""
    reps = resampled(rows, keys, [a, b], replicates, mean_block, seed, by)
    gap = ratio(F.col(f"mean_{a}"), F.col(f"dev_{a}"), periods) - ratio(F.col(f"mean_{b}"), F.col(f"dev_{b}"), periods)
    reps = reps.withColumn("gap", gap)
    return reps.groupBy(*keys).agg(
        F.percentile("gap", 0.025).alias("gap_low"),
        F.percentile("gap", 0.975).alias("gap_high"),
        F.avg((F.col("gap") <= 0).cast("double")).alias("share_not_better"),
    )


def paired_mean_interval(rows: DataFrame, keys: Sequence[str], a: str, b: str, replicates: int = 2000, mean_block: float = 6.0, seed: int = 0, by: str = "t0") -> DataFrame:
    """(keys, mean_a, mean_b, difference, low, high): of two columns' means over the same resampled rows, 2.5 and 97.5 %."""
    reps = resampled(rows, keys, [a, b], replicates, mean_block, seed, by)
    ends = reps.groupBy(*keys).agg(F.percentile(F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    means = rows.groupBy(*keys).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return means.join(ends, list(keys)).select(*keys, "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("difference"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


#: Largest p-value of a verdict. Fixed value.
ALPHA = 0.05


def verdicts(rows: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", replicates: int = 2000, mean_block: float = 6.0, seed: int = 0, by: str = "t0") -> DataFrame:
    """Whether one forecast beats another on the same rows, ``a`` and ``b`` being 1 where they are right and 0 where not.

    ``a`` beats ``b`` if the paired interval of its mean difference lies above 0 and the exact test of the
    discordant rows gives less than ALPHA.
    """
    own, other = F.col(a) > F.col(b), F.col(a) < F.col(b)
    cells = rows.groupBy(*keys).agg(F.count("*").alias("months"), F.count_if(own).alias("only_a"), F.count_if(other).alias("only_b"))
    cells = cells.withColumn("p_value", two_sided_binomial(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")))
    out = paired_mean_interval(rows, keys, a, b, replicates, mean_block, seed, by).join(cells, list(keys))
    return out.withColumn("beats", (F.col("low") > 0) & (F.col("p_value") < ALPHA))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Spark has no error function; this runs on a few result rows."""
    return x.map(lambda v: None if pd.isna(v) else NormalDist().cdf(v))


@F.pandas_udf(T.DoubleType())
def two_sided_binomial(hits: pd.Series, trials: pd.Series) -> pd.Series:
    """Exact two-sided p-value against 1/2, on a few result rows."""
    from math import comb

    def p(k, n):
        tail = sum(comb(int(n), i) for i in range(int(min(k, n - k)) + 1)) / 2.0 ** int(n)
        return min(1.0, 2 * tail)

    return pd.Series([p(k, n) if n else 1.0 for k, n in zip(hits, trials)], dtype="float64")


def expected_best(trials: int) -> float:
    """The expected maximum of so many standard normal draws."""
    if trials < 2:
        return 0.0
    normal = NormalDist()
    return (1 - EULER_GAMMA) * normal.inv_cdf(1 - 1 / trials) + EULER_GAMMA * normal.inv_cdf(1 - 1 / (trials * 2.718281828459045))


def moments(rows: DataFrame, keys: Sequence[str], column: str = "ret") -> DataFrame:
    """Per-period Sharpe, biased skewness and Pearson kurtosis of each key."""
    dev = F.stddev_samp(column)
    return rows.groupBy(*keys).agg(
        F.count(column).alias("n_obs"),
        F.when(dev > NO_DEVIATION, F.avg(column) / dev).otherwise(0.0).alias("sharpe"),
        F.skewness(column).alias("skew"),
        (F.kurtosis(column) + 3).alias("kurtosis"),
    )


def deflated_z(stats: DataFrame, trials: int, benchmark: float | Column = 0.0) -> DataFrame:
    """Add the z of the deflated Sharpe ratio: how far above the best of ``trials`` lucky ones; :func:`normal_cdf` makes it a probability."""
    sr, n = F.col("sharpe"), F.col("n_obs")
    spread = F.sqrt((1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr) / (n - 1))
    bar = benchmark + expected_best(trials) / F.sqrt(n - 1)
    return stats.withColumn("z", (sr - bar) / spread)


def newey_west(rows: DataFrame, keys: Sequence[str], column: str = "ret", lags: int = 5, by: str = "date") -> DataFrame:
    """Standard error of the mean under autocorrelation up to ``lags``, Bartlett weights."""
    w = ordered(keys, by)
    mean = rows.groupBy(*keys).agg(F.avg(column).alias("m"))
    x = rows.join(mean, list(keys)).withColumn("x", F.col(column) - F.col("m"))
    x = x.withColumns({f"x{k}": F.lag("x", k).over(w) for k in range(1, lags + 1)})
    n = F.count("x")
    variance = F.sum(F.col("x") * F.col("x")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("x") * F.col(f"x{k}")), F.lit(0.0)) / n
    return x.groupBy(*keys).agg(F.sqrt(F.greatest(variance, F.lit(0.0)) / n).alias("se"), n.alias("n_obs"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the interval of a share."""
    p = hits / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
