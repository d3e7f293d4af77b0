"""Leakage-safe validation: chronological splits, rolling folds, purge and embargo, lookahead checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import ordered

from .reports import full_report


def split_position(n: Column, share: float) -> Column:
    """floor(n * share + 1e-9), with both sides non-empty."""
    return F.greatest(F.lit(1), F.least(F.floor(n * share + 1e-9), n - 1))


def numbered(rows: DataFrame, keys: Sequence[str], by: str = "date") -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` of each key."""
    return rows.withColumns({"pos": F.row_number().over(ordered(keys, by)) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})


def split_dates(rows: DataFrame, share: float = 0.7, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The date at which each key's second part starts."""
    split = numbered(rows, keys).where(F.col("pos") == split_position(F.col("n"), share))
    return split.select(*keys, F.col("date").alias("split_date"))


def halves(backtest: DataFrame, share: float = 0.7, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """Rows tagged in_sample or out_of_sample; the split date is in both, as both slices are inclusive."""
    rows = numbered(backtest, keys)
    split = split_position(F.col("n"), share)
    both = F.array(F.lit("in_sample"), F.lit("out_of_sample"))
    half = (
        F.when(F.col("pos") < split, F.array(F.lit("in_sample")))
        .when(F.col("pos") == split, both)
        .otherwise(F.array(F.lit("out_of_sample")))
    )
    return rows.withColumn("half", F.explode(half)).drop("pos", "n")


def evaluate_out_of_sample(backtest: DataFrame, share: float = 0.7, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """A full report for each half of each run."""
    return full_report(halves(backtest, share, keys), [*keys, "half"])


def mark_out_of_sample(signals: DataFrame, oos: DataFrame, keys: Sequence[str] = ("run_id", "series_id")) -> DataFrame:
    """Flat before each run's first out-of-sample date (``oos_from``)."""
    rows = signals.join(oos, list(keys), "left")
    live = F.col("oos_from").isNull() | (F.col("date") >= F.col("oos_from"))
    return rows.withColumn("signal", F.when(live, F.col("signal")).otherwise(0.0)).drop("oos_from")


def rolling_folds(rows: DataFrame, train: int = 756, test: int = 126, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Test rows of rolling folds: fold k tests positions train + k * test on, whole folds only."""
    rows = numbered(rows, keys)
    fold = F.floor((F.col("pos") - train) / test).cast("int")
    whole = train + (fold + 1) * test <= F.col("n")
    return rows.withColumn("fold", fold).where((F.col("pos") >= train) & whole).drop("pos", "n")


def training_windows(rows: DataFrame, train: int = 756, test: int = 126, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows replicated into each fold that trains or tests on them, with ``is_test``: input to refit a strategy a fold.

    A row is in at most (train + test) / test folds.
    """
    rows = numbered(rows, keys)
    folds = F.greatest(F.floor((F.col("n") - train) / test).cast("int"), F.lit(0))
    first = F.greatest(F.floor((F.col("pos") - train - test) / test).cast("int") + 1, F.lit(0))
    last = F.least(F.floor(F.col("pos") / test).cast("int"), folds - 1)
    wanted = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("fold", F.explode(wanted))
    return rows.withColumn("is_test", F.col("pos") >= F.col("fold") * test + train).drop("pos", "n")


def refit_signals(bars: DataFrame, build: Callable[[DataFrame], DataFrame], train: int = 756, test: int = 126) -> DataFrame:
    """Signals of a strategy built anew on each fold's rows: (series_id, fold, date, is_test, close, signal)."""
    windows = training_windows(bars, train, test)
    own = windows.withColumn("source", F.col("series_id")).withColumn("series_id", F.concat_ws("#", "series_id", "fold"))
    signals = build(own.drop("fold", "is_test", "source"))
    joined = own.join(signals, ["series_id", "date"])
    return joined.select(F.col("source").alias("series_id"), "fold", "date", "is_test", "close", "signal")


def fold_summary(reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sharpe over the folds in which a position could be held."""
    rows = reports.where("can_hold")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("folds"),
        F.avg("sharpe_ratio").alias("mean_sharpe"),
        F.median("sharpe_ratio").alias("median_sharpe"),
        F.stddev_samp("sharpe_ratio").alias("std_sharpe"),
        F.min("sharpe_ratio").alias("worst_sharpe"),
        F.avg((F.col("sharpe_ratio") > 0).cast("double")).alias("share_positive"),
    )


# Samples with label intervals [t0, t1] -----------------------------------------------------------------------


def positions(samples: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Samples numbered by t0; a missing end, a label that ends before its decision, or a t0 that repeats in a key is an error."""
    rows = numbered(samples, keys, "t0")
    again = F.lag("t0").over(ordered(keys, "t0")) == F.col("t0")
    wrong = F.col("t0").isNull() | F.col("t1").isNull() | (F.col("t1") < F.col("t0")) | F.coalesce(again, F.lit(False))
    message = F.lit("samples need t0 and t1, t0 <= t1, and rising t0")
    return rows.withColumn("t0", F.when(wrong, F.raise_error(message).cast(samples.schema["t0"].dataType)).otherwise(F.col("t0")))


def first_test(rows: DataFrame, min_train: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, start): the earliest position from ``min_train`` on that leaves as many training samples after purging.

    A sample before the test block is kept if its label ends before the block starts, so a
    running count of ended labels over both kinds of dates tells how many are left.
    """
    dates = rows.select(*keys, F.col("t0").alias("at"), F.lit(0).alias("ended"), "pos")
    dates = dates.unionByName(rows.select(*keys, F.col("t1").alias("at"), F.lit(1).alias("ended"), F.lit(None).cast("int").alias("pos")))
    kept = F.sum("ended").over(Window.partitionBy(*keys).orderBy("at", "ended").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dates = dates.withColumn("kept", kept).where((F.col("pos") >= min_train) & (F.col("kept") >= min_train))
    return dates.groupBy(*keys).agg(F.min("pos").alias("start"))


def walk_forward_folds(samples: DataFrame, min_train: int, test_size: int, embargo: int = 0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(fold, sample, role): expanding training windows; samples whose label interval meets the test span are purged.

    The first test block starts at :func:`first_test`; a key without such a position has no folds.
    """
    if min_train < 1 or test_size < 1 or embargo < 0:
        raise ValueError("min_train and test_size must be 1 or more, embargo 0 or more")
    rows = positions(samples, keys)
    spans = rows.join(first_test(rows, min_train, keys), list(keys)).where("pos >= start")
    spans = spans.withColumn("fold", F.floor((F.col("pos") - F.col("start")) / test_size).cast("int"))
    spans = spans.groupBy(*keys, "fold").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("t0").alias("span_start"), F.max("t1").alias("span_end")
    )
    joined = rows.join(spans, list(keys)).where(F.col("pos") <= F.col("last"))
    return _roles(joined, keys, embargo)


def purged_kfold(samples: DataFrame, folds: int, embargo: int = 0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(fold, sample, role): contiguous test blocks; training on both sides, purged, with an embargo after the block."""
    rows = positions(samples, keys).withColumn("own", F.ntile(folds).over(ordered(keys, "t0")) - 1)
    spans = rows.groupBy(*keys, F.col("own").alias("fold")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("t0").alias("span_start"), F.max("t1").alias("span_end")
    )
    return _roles(rows.drop("own").join(spans, list(keys)), keys, embargo)


def _roles(joined: DataFrame, keys: Sequence[str], embargo: int) -> DataFrame:
    """Intervals are closed: a label that ends on the first test date is purged. A key's folds are few."""
    test = F.col("pos").between(F.col("first"), F.col("last"))
    meets = (F.col("t0") <= F.col("span_end")) & (F.col("t1") >= F.col("span_start"))
    late = F.col("pos").between(F.col("last") + 1, F.col("last") + embargo)
    role = F.when(test, "test").when(meets, "purged").when(late, "embargoed").otherwise("train")
    return joined.select(*keys, "fold", "t0", "t1", "pos", role.alias("role"))


def fold_table(roles: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row a fold: its test span and how many samples have each role."""
    count = lambda role: F.count_if(F.col("role") == role).alias("n_" + role)
    return roles.groupBy(*keys, "fold").agg(
        F.min(F.when(F.col("role") == "test", F.col("t0"))).alias("test_start"),
        F.max(F.when(F.col("role") == "test", F.col("t0"))).alias("test_end"),
        *[count(r) for r in ("train", "test", "purged", "embargoed")],
    )


# Lookahead ---------------------------------------------------------------------------------------------------


def changed_rows(transform: Callable[[DataFrame], DataFrame], before: DataFrame, after: DataFrame, upto: Column) -> DataFrame:
    """Rows up to a date whose output differs between two inputs that agree until then, a series."""
    a, b = transform(before), transform(after)
    names = [c for c in a.columns if c not in ("series_id", "date")]
    left = a.where(upto).select("series_id", "date", F.struct(*names).alias("x"))
    right = b.where(upto).select("series_id", "date", F.struct(*names).alias("y"))
    joined = left.join(right, ["series_id", "date"], "full")
    return joined.groupBy("series_id").agg(F.count("*").alias("rows"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("changed"))


def lookahead_check(transform: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: str, rewrite: bool = True) -> DataFrame:
    """Change prices after ``cut`` (or drop them) and count earlier outputs that change: 0 if nothing looks ahead."""
    later = F.col("date") > F.lit(cut).cast("date")
    priced = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    other = bars.withColumns({c: F.when(later, F.col(c) * 1.5).otherwise(F.col(c)) for c in priced}) if rewrite else bars.where(~later)
    return changed_rows(transform, bars, other, ~later)
