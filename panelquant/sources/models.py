"""Model registry and prediction log: append-only tables of immutable rows.

A model is registered as the next version of its name, unless the same artifact is
registered on the same snapshot already. Its row holds the artifact, the input that it
serves (the features of the latest complete month) and the SHA-256 of both, which are
checked before anything is scored. Scoring appends to the log what isn't there yet, so
a job that runs again logs nothing twice. A store has one writer at a time; readers
may be many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelquant.operators.tuning import scored

from .folders import table
from .snapshots import next_versions

_FEATURES_FORMAT = "panelquant-features/1"
REGISTRY = (
    "name string, series_id string, snapshot_id string, version int, target string, feature_set string, kind string, params map<string,double>, "
    "features array<string>, classes int, n_train bigint, train_first date, train_last date, label_end date, metrics string, "
    "serving_as_of date, serving_features array<double>, features_sha256 string, artifact string, artifact_sha256 string, created_at timestamp"
)
LOG = "name string, series_id string, version int, as_of date, features_sha256 string, prediction int, proba array<double>, created_at timestamp"
_COLUMNS = [c.split()[0] for c in REGISTRY.split(", ")]
_LOG_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def features_hash(as_of: str, names: str, values: str) -> Column:
    """SHA-256 of a date and named values, which count in units of 1e-9 (:func:`serving_inputs` rounds to them)."""
    text = F.zip_with(F.col(names), F.col(values), lambda n, v: F.concat(n, F.lit("="), F.round(v * 1e9).cast("bigint").cast("string")))
    return F.sha2(F.concat_ws("|", F.lit(_FEATURES_FORMAT), F.date_format(as_of, "yyyy-MM-dd"), F.array_join(text, "|")), 256)


def serving_inputs(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series_id, serving_as_of, serving_features, features_sha256): each series' latest decision date; missing features are an error."""
    last = features.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))).where("n = 1")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(c), F.lit(c)) for c in columns]))
    values = F.array(*[F.round(F.col(c).cast("double"), 9) for c in columns])
    fault = F.concat(F.lit("features on "), F.col("date").cast("string"), F.lit(" are incomplete: "), F.array_join(missing, ", "))
    values = F.when(F.size(missing) == 0, values).otherwise(F.raise_error(fault).cast("array<double>"))
    rows = last.select("series_id", F.col("date").alias("serving_as_of"), values.alias("serving_features"), F.array(*[F.lit(c) for c in columns]).alias("features"))
    return rows.withColumn("features_sha256", features_hash("serving_as_of", "features", "serving_features"))


def register(spark: SparkSession, path: str, models: DataFrame) -> DataFrame:
    """Append the models that are new, as next versions; the registry's rows of all the given ones, with whether they are ``created`` now."""
    before = table(spark, path, REGISTRY)
    models = models.withColumns({"artifact_sha256": F.sha2("artifact", 256), "created_at": F.current_timestamp()})
    identity = ["name", "snapshot_id", "artifact_sha256"]
    fresh = next_versions(before, models.dropDuplicates(identity))
    last = before.agg(F.max("created_at")).first()[0]
    fresh.select(*[F.col(f.name).cast(f.dataType) for f in before.schema]).write.mode("append").parquet(path)
    created = F.lit(True) if last is None else F.col("created_at") > F.lit(last)
    return table(spark, path, REGISTRY).join(models.select(identity).distinct(), identity, "left_semi").withColumn("created", created)


def summaries(registry: DataFrame) -> DataFrame:
    """All versions without their artifacts, but with their sizes."""
    return registry.select(*[c for c in registry.columns if c != "artifact"], F.octet_length("artifact").alias("artifact_bytes"))


def version(registry: DataFrame, name: str, number: int) -> DataFrame:
    """The one row of a version; none if there is no such version."""
    return registry.where((F.col("name") == name) & (F.col("version") == number))


def latest(registry: DataFrame) -> DataFrame:
    """Each name's newest version."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return registry.withColumn("place", place).where("place = 1").drop("place")


def verified(registry: DataFrame) -> DataFrame:
    """The same rows; an artifact or input that doesn't match its SHA-256, or an artifact of other columns, is an error."""
    of = F.concat("name", F.lit(" version "), F.col("version").cast("string"))
    fault = (
        F.when(F.sha2("artifact", 256) != F.col("artifact_sha256"), "artifact doesn't match its SHA-256")
        .when(features_hash("serving_as_of", "features", "serving_features") != F.col("features_sha256"), "input doesn't match its SHA-256")
        .when(~F.from_json(F.get_json_object("artifact", "$.columns"), "array<string>").eqNullSafe(F.col("features")), "artifact has other columns")
    )
    checked = F.when(fault.isNull(), F.col("artifact")).otherwise(F.raise_error(F.concat_ws(": ", of, fault)).cast("string"))
    return registry.withColumn("artifact", checked)


def predict(spark: SparkSession, registry: DataFrame, log_path: str) -> DataFrame:
    """Score the given versions on the inputs stored with them, log what isn't logged yet, and return the log's rows of them."""
    rows = verified(registry)
    models = rows.select(F.concat_ws("#", "name", "version").alias("series_id"), "version", "artifact")
    inputs = rows.select(F.concat_ws("#", "name", "version").alias("series_id"), F.col("series_id").alias("of"), "name", F.col("serving_as_of").alias("as_of"), "features_sha256", F.col("serving_features").alias("x"))
    found = scored(models, inputs).drop("series_id").withColumnRenamed("of", "series_id").withColumn("created_at", F.current_timestamp())
    key = ["name", "version", "as_of", "features_sha256"]
    log = table(spark, log_path, LOG)
    found.join(log.select(key), key, "left_anti").select(_LOG_COLUMNS).write.mode("append").parquet(log_path)
    return table(spark, log_path, LOG).join(rows.select("name", "version", F.col("serving_as_of").alias("as_of"), "features_sha256"), key, "left_semi")


def write_trials(trials: DataFrame, path: str) -> None:
    """Append tuning trials as lines of JSON."""
    trials.select(F.to_json(F.struct(*sorted(trials.columns))).alias("value")).write.mode("append").text(path)


def read_trials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of :func:`write_trials` as rows; a line that is no such object is an error."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("t")).select("t.*")
