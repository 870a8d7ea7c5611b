"""The driver's tables as the frames that operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, series, unpack


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, value): each user's event values in order of time."""
    return series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


SERIES = "s AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value FROM events)"


def vectors(spark: SparkSession, sf_dir: str, dims: int, first: int = 1) -> DataFrame:
    """(sample_id, label, var_id, value) of some dimensions of the embeddings."""
    e = table(spark, sf_dir, "embeddings").withColumn("part", F.slice("embedding", first, dims))
    return unpack(e, "vec_id", "part", keep=["label"])


def vectors_sql(dims: int, first: int = 1, name: str = "v") -> str:
    return f"{name} AS (SELECT vec_id AS sample_id, label, j AS var_id, CAST(embedding[j + {first - 1}] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(1, {dims + 1})) AS j))"


def wide_vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(vec_id, label, x) with x the first dimensions, or all of them, as doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding" if dims is None else F.slice("embedding", 1, dims), lambda v: v.cast("double")).alias("x"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, user_id, value): mean value of each user and event type, summed in order of the events, so that ties of means do not hang on the run."""
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.col("value").cast("double").alias("v"))
    sums = e.withColumns({"s": F.sum("v").over(w), "n": F.count("v").over(w)})
    last = sums.groupBy("event_type", "user_id").agg(F.max_by("s", "n").alias("s"), F.max("n").alias("n"))
    return last.select("event_type", "user_id", ratio(F.col("s"), F.col("n")).alias("value"))


BLOCKS = "b AS (SELECT event_type, user_id, avg(value) AS value FROM events GROUP BY event_type, user_id)"
FULL_BLOCKS = f"{BLOCKS}, k AS (SELECT count(DISTINCT event_type) AS k FROM b), f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM b), k WHERE c = k)"


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, grp, t, y): mean value of each user in each of four weeks, for users seen in all of them."""
    w = F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(3)).cast("int")
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject"), w.alias("t")).agg(F.avg("value").alias("y"))
    whole = rows.withColumn("c", F.count("*").over(Window.partitionBy("subject"))).filter("c = 4")
    return whole.select("subject", (F.col("subject") % 2).cast("int").alias("grp"), "t", "y")


WEEKS = "w AS (SELECT subject, CAST(subject % 2 AS INT) AS grp, t, y FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS c FROM (SELECT user_id AS subject, CAST(least(floor((day(ts) - 1) / 7.0), 3) AS INT) AS t, avg(value) AS y FROM events GROUP BY 1, 2)) WHERE c = 4)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, value): mean value of each user and day of a grid of all users and days, null where unseen."""
    e = table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day"), "value")
    seen = e.groupBy("user_id", "day").agg(F.avg("value").alias("value"))
    grid = e.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(30))))
    return grid.join(seen, ["user_id", "day"], "left")


DAYS = "d AS (SELECT g.user_id, g.day, s.value FROM (SELECT DISTINCT user_id, day FROM events, (SELECT CAST(unnest(range(1, 31)) AS INT) AS day)) g LEFT JOIN (SELECT user_id, day(ts) AS day, avg(value) AS value FROM events GROUP BY 1, 2) s ON g.user_id = s.user_id AND g.day = s.day)"
