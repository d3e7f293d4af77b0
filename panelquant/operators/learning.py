"""Monthly datasets, baselines, scores and direction models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelquant.functions.columns import DAYS, change, ordered, rolling

from .indicators import KEY, daily_features, month_ends, next_day_label, with_returns
from .validation import numbered, split_position

FLOOR = 1e-4
#: Samples that a task of an iterative fit reads; a step of a fit is a job, so small tables need few tasks.
FIT_ROWS = 1 << 15
BASE_FEATURES = ("ret_1m", "ret_3m", "ret_6m", "ret_12m", "mom_12_1", "sma200_gap", "vol_20", "vol_60", "drawdown")


def monthly_features(bars: DataFrame) -> DataFrame:
    """Momentum, trend, volatility and drawdown features on each series' decision dates."""
    w, close = ordered(), F.col("close")
    year = F.sqrt(F.lit(float(DAYS)))
    rows = with_returns(bars).select(
        "series_id",
        "date",
        "close",
        change(close, 21, w).alias("ret_1m"),
        change(close, 63, w).alias("ret_3m"),
        change(close, 126, w).alias("ret_6m"),
        change(close, 252, w).alias("ret_12m"),
        (F.lag("close", 21).over(w) / F.nullif(F.lag("close", 252).over(w), F.lit(0.0)) - 1).alias("mom_12_1"),
        (close / rolling(F.avg, close, 200, w) - 1).alias("sma200_gap"),
        (rolling(F.stddev_samp, F.col("r"), 20, w) * year).alias("vol_20"),
        (rolling(F.stddev_samp, F.col("r"), 60, w) * year).alias("vol_60"),
        (close / rolling(F.max, close, 252, w) - 1).alias("drawdown"),
    )
    return rows.join(month_ends(bars), ["series_id", "date"])


def monthly_dataset(bars: DataFrame) -> DataFrame:
    """Features at t0 with the direction to the next decision date t1, the label before it, and the forward return.

    The previous label is taken before rows without features are dropped.
    """
    w = ordered()
    rows = monthly_features(bars)
    rows = rows.withColumns({"t1": F.lead("date").over(w), "next_close": F.lead("close").over(w)})
    rows = rows.withColumn("forward_return", F.col("next_close") / F.col("close") - 1)
    rows = rows.withColumn("y", F.when(F.col("forward_return").isNotNull(), (F.col("forward_return") > 0).cast("int")))
    rows = rows.withColumn("previous", F.lag("y").over(w))
    rows = rows.withColumnRenamed("date", "t0").drop("close", "next_close")
    return rows.dropna(subset=["y", *BASE_FEATURES])


def regime_dataset(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and the label of the decision date (``regime_rules``), with the most frequent label up to the next decision date as ``y``, and the one before it.

    Rows without a feature, a target or a previous target are dropped.
    """
    w = ordered()
    ends = month_ends(bars)
    rows = monthly_features(bars).withColumn("t1", F.lead("date").over(w))
    rows = rows.join(labels.select("series_id", "date", F.when(F.col("label") >= 0, F.col("label")).cast("double").alias("regime_rules")), ["series_id", "date"], "left")
    rows = rows.drop("close").withColumnRenamed("date", "t0").join(modal_labels(labels, ends), ["series_id", "t0"], "left").where("t1 is not null")
    rows = rows.withColumn("previous", F.lag("y").over(ordered(by="t0")))
    return rows.dropna(subset=["y", "previous", "regime_rules", *BASE_FEATURES])


def modal_labels(labels: DataFrame, decisions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The most frequent label of the days after each decision date up to the next; on ties the one seen latest.

    A day belongs to the last decision date before it, found by one window.
    """
    marked = labels.join(decisions.select(*keys, "date", F.lit(True).alias("end")), [*keys, "date"], "left")
    past = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("t0", F.last(F.when(F.col("end"), F.col("date")), ignorenulls=True).over(past))
    counts = marked.where("t0 is not null and label <> -1").groupBy(*keys, "t0", "label").agg(F.count("*").alias("n"), F.max("date").alias("latest"))
    return counts.groupBy(*keys, "t0").agg(F.max(F.struct("n", "latest", "label")).alias("m")).select(*keys, "t0", F.col("m.label").alias("y"))


def label_determinacy(bars: DataFrame, samples: DataFrame, windows: dict[str, int], keys: Sequence[str] = KEY) -> DataFrame:
    """How much of the next month's label is known at the decision: one row a key.

    ``samples`` are those of :func:`regime_dataset`. ``decision_agrees`` and ``previous_agrees`` are the shares of samples whose
    label is the decision date's and the month's before. On day k of the m days after a decision, w - k of a look-back
    of w rows were known; ``known_<name>`` averages the share over the days, then over the samples.
    """
    place = bars.select(*keys, "date", F.row_number().over(ordered(keys)).alias("place"))
    rows = samples
    for c in ("t0", "t1"):
        rows = rows.join(place.withColumnsRenamed({"date": c, "place": f"place_{c}"}), [*keys, c])
    days = F.col("place_t1") - F.col("place_t0")

    def known(w: int) -> Column:
        n = F.least(days, F.lit(w))
        return F.avg((w * n - n * (n + 1) / 2) / (w * days))

    agrees = lambda c: F.avg((F.col("y") == F.col(c)).cast("double"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), agrees("regime_rules").alias("decision_agrees"), agrees("previous").alias("previous_agrees"),
        *[known(w).alias(f"known_{name}") for name, w in windows.items()],
    )


# Scores ------------------------------------------------------------------------------------------------------


def floored(shares: Sequence[Column]) -> list[Column]:
    """Class shares at least FLOOR, adding up to 1 again."""
    raised = [F.greatest(s, F.lit(FLOOR)) for s in shares]
    total = sum(raised[1:], raised[0])
    return [s / total for s in raised]


def prior_probabilities(train: DataFrame, classes: Sequence[int], keys: Sequence[str], y: str = "y") -> DataFrame:
    """Class shares of the training rows, floored: column ``proba``."""
    counts = train.groupBy(*keys).agg(F.count(y).alias("n"), *[F.count_if(F.col(y) == c).alias(f"c{c}") for c in classes])
    return counts.select(*keys, F.array(*floored([F.col(f"c{c}") / F.col("n") for c in classes])).alias("proba"))


def conditional_probabilities(train: DataFrame, test: DataFrame, given: str, classes: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Test rows with the training shares given a value, or the plain ones where it hadn't been seen."""
    conditional = prior_probabilities(train, classes, [*keys, given]).withColumnRenamed("proba", "own")
    prior = prior_probabilities(train, classes, keys).withColumnRenamed("proba", "plain")
    rows = test.join(conditional, [*keys, given], "left").join(prior, list(keys), "left")
    return rows.withColumn("proba", F.coalesce("own", "plain")).drop("own", "plain")


def majority(y: str = "y") -> Column:
    """The most frequent class, the smaller on ties."""
    return F.mode(y, True)


def log_loss(proba: str, position: Column) -> Column:
    """Of one row; ``position`` of its class in the array, from 1."""
    return -F.ln(F.element_at(proba, position))


def brier(proba: str, position: Column) -> Column:
    """Squared distance of one row's probabilities to its class."""
    hit = F.transform(F.col(proba), lambda p, i: F.pow(p - (i + 1 == position).cast("double"), 2))
    return F.aggregate(hit, F.lit(0.0), lambda a, b: a + b)


def balanced_accuracy(rows: DataFrame, keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Mean recall over the classes that occur."""
    recall = rows.groupBy(*keys, y).agg(F.avg((F.col(y) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def auc(rows: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Exact area under the curve by ranks, ties counted half; null if a class is missing."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, score))
    rank = F.rank().over(w.orderBy(score)) + (ties - 1) / 2
    rows = rows.withColumn("rank", rank)
    ones, n = F.count_if(F.col(y) == 1), F.count("*")
    area = (F.sum(F.when(F.col(y) == 1, F.col("rank"))) - ones * (ones + 1) / 2) / F.nullif(ones * (n - ones), F.lit(0))
    return rows.groupBy(*keys).agg(ones.alias("positives"), (n - ones).alias("negatives"), area.alias("auc"))


def calibration_bins(rows: DataFrame, keys: Sequence[str], score: str, y: str, bins: int, tie: str) -> DataFrame:
    """Bins of equal count by score: mean score, share of class 1, rows."""
    rows = rows.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*keys).orderBy(score, tie)))
    return rows.groupBy(*keys, "bin").agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("share"), F.count("*").alias("rows")
    )


def confusion(rows: DataFrame, classes: Sequence[int], keys: Sequence[str], y: str = "y", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(*keys, y).pivot(predicted, list(classes)).count().fillna(0, [str(c) for c in classes])


# Models ------------------------------------------------------------------------------------------------------


def daily_table(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """Daily features and next-day label; ``role`` train or test, the row whose label reaches into the test part left out."""
    rows = daily_features(bars).join(next_day_label(bars), ["series_id", "date"])
    rows = numbered(rows, ["series_id"]).withColumn("next", F.lead("date").over(ordered()))
    split = F.min(F.when(F.col("pos") == split_position(F.col("n"), share), F.col("date"))).over(Window.partitionBy("series_id"))
    rows = rows.withColumn("split", split)
    role = F.when(F.col("next") < F.col("split"), "train").when(F.col("date") >= F.col("split"), "test")
    return rows.withColumn("role", role).where("role is not null").drop("pos", "n", "next", "split").dropna()


def direction_pipeline(columns: Sequence[str], kind: str, rows: int) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    model = {
        "logistic": lambda: LogisticRegression(labelCol="y", regParam=1.0 / max(rows, 1), standardization=False),
        "forest": lambda: RandomForestClassifier(labelCol="y", numTrees=200, maxDepth=5, seed=1),
        "boosted": lambda: GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, seed=1),
    }[kind]()
    return Pipeline(stages=[assembler, scaler, model])


def train_direction(table: DataFrame, columns: Sequence[str], kind: str = "logistic") -> PipelineModel:
    train = table.where("role = 'train'")
    return direction_pipeline(columns, kind, train.count()).fit(train)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumns({"predicted": F.col("prediction").cast("int"), "score": vector_to_array("probability")[1]})


def train_by_regime(table: DataFrame, columns: Sequence[str], kind: str = "logistic", least: int = 150) -> tuple[PipelineModel, dict[int, PipelineModel]]:
    """A model for all rows, and one for each regime (column ``label``) with enough training rows of both classes."""
    train = table.where("role = 'train'")
    sizes = train.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).collect()
    own = {
        r["label"]: direction_pipeline(columns, kind, r["n"]).fit(train.where(F.col("label") == r["label"]))
        for r in sizes
        if r["n"] >= least and r["classes"] == 2
    }
    return train_direction(table, columns, kind), own


def predicted_by_regime(models: tuple[PipelineModel, dict[int, PipelineModel]], rows: DataFrame) -> DataFrame:
    """Each row by its regime's model, or by the one for all."""
    plain, own = models
    out = predicted(plain, rows.where(~F.col("label").isin(*own)) if own else rows)
    for label, model in own.items():
        out = out.unionByName(predicted(model, rows.where(F.col("label") == label)))
    return out


def nested_walk_forward(samples: DataFrame, roles: DataFrame, columns: Sequence[str], grid: Sequence[float], inner_share: float = 0.75) -> DataFrame:
    """Outer folds, each with its penalty (1 / C, summed over the rows) chosen by log loss on the last part of its training rows; ties to the earlier entry.

    Inner rows are split in time, and rows whose label reaches the inner test part are left out. Folds and grid are few.
    """
    joined = samples.join(roles.select("series_id", "t0", "fold", "role"), ["series_id", "t0"]).cache()
    keyed = joined.coalesce(max(1, -(-joined.count() // FIT_ROWS))).cache()
    out = None
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    make = lambda c, n: Pipeline(stages=[assembler, LogisticRegression(labelCol="y", regParam=1.0 / (c * max(n, 1)))])
    for (fold,) in sorted(r[:1] for r in keyed.select("fold").distinct().collect()):
        own = keyed.where(F.col("fold") == fold)
        train, test = own.where("role = 'train'"), own.where("role = 'test'")
        cut = train.agg(F.percentile(F.unix_date("t0").cast("double"), inner_share)).first()[0]
        if cut is None:
            continue
        early, late = train.where(F.unix_date("t1") < cut), train.where(F.unix_date("t0") >= cut)
        if early.select("y").distinct().count() < 2:
            continue
        losses, n = [], early.count()
        for c in grid:
            scored = predicted(make(c, n).fit(early), late)
            hit = F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))
            losses.append(scored.agg(F.avg(-F.ln(F.greatest(hit, F.lit(FLOOR))))).first()[0] or 0.0)
        best = grid[losses.index(min(losses))]
        mine = predicted(make(best, train.count()).fit(train), test).select("series_id", "fold", "t0", "y", "predicted", "score").withColumn("chosen", F.lit(float(best)))
        out = mine if out is None else out.unionByName(mine)
    return out
