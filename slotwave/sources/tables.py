"""Readers with fixed schemas, and writers."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = "userId int, movieId int, rating float, timestamp long"
SNAPSHOT = ("Time", "videoId", "viewCount_diff")
TRIP = ("tpep_pickup_datetime", "PULocationID")
OWN_FOLDER = re.compile("[a-z-]+-[0-9a-f]{32}")
TRIP_FEATURES = ("fare_amount", "trip_distance", "passenger_count", "total_amount")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see (spark.checkpoint.dir); a temporary one only where all run on this machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("slotwave.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="slotwave-")
        spark.conf.set("slotwave.shared.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back; it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession, hours: float = 48.0) -> list[str]:
    """Deletes the library's own folders in the shared folder whose newest file is older than so many hours; their names.

    Only folders named as stored() names them, a word and 32 hexadecimal digits, are looked at. The
    age must exceed the longest job that may still read them.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(shared_dir(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    latest, removed = (time.time() - hours * 3600) * 1000, []
    for folder in files.listStatus(root):
        name = folder.getPath().getName()
        if not (folder.isDirectory() and OWN_FOLDER.fullmatch(name)) or folder.getModificationTime() > latest:
            continue
        inside, fresh = files.listFiles(folder.getPath(), True), False
        while not fresh and inside.hasNext():
            fresh = inside.next().getModificationTime() > latest
        if not fresh and files.delete(folder.getPath(), True):
            removed.append(name)
    return sorted(removed)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).option("header", True).csv(path)


def read_trips(spark: SparkSession, path: str, features: bool = False) -> DataFrame:
    """Pickup time and place, with whatever optional feature columns there are. A missing required column raises."""
    df = spark.read.parquet(path)
    if lost := [c for c in TRIP if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    return df.select(*TRIP, *[c for c in TRIP_FEATURES if features and c in df.columns])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    if lost := [c for c in SNAPSHOT if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    extra = [c for c in ("likeCount_diff", "dislikeCount_diff", "commentCount_diff") if c in df.columns]
    return df.select(F.try_to_timestamp("Time").alias("Time"), "videoId", *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("viewCount_diff", *extra)])


def unpivot_days(wide: DataFrame, key: str = "Page") -> DataFrame:
    """One column per day -> (key, day, views). The days must be consecutive and the keys unique and not null."""
    days = [c for c in wide.columns if c != key]
    from datetime import date, timedelta

    first = date.fromisoformat(min(days))
    if sorted(days) != [(first + timedelta(i)).isoformat() for i in range(len(days))]:
        raise ValueError("the day columns are not consecutive days")
    return wide.unpivot([key], days, "day", "views").withColumn("day", F.to_date("day"))


def key_violations(wide: DataFrame, key: str = "Page") -> DataFrame:
    """One row: number of rows, of null keys, of repeated keys."""
    return wide.agg(F.count("*").alias("n_rows"), F.sum(F.col(key).isNull().cast("long")).alias("n_null"), (F.count(key) - F.count_distinct(key)).alias("n_repeated"))


def parse_series_lines(lines: DataFrame, first_day: str, n_days: int) -> DataFrame:
    """Lines 'name[:attribute...]:date ...:v1,v2,?' -> (page, day, views); '?' is missing, longer series are cut.

    Header and comment lines (starting with @ or #) and empty ones are skipped. A series that
    starts on another day or has fewer values raises an error.
    """
    body = lines.where(~F.col("value").rlike(r"^\s*([@#]|$)"))
    head, values = F.regexp_extract("value", r"^(.*):([^:]*)$", 1), F.split(F.regexp_extract("value", r"^(.*):([^:]*)$", 2), ",")
    parts = F.split(head, ":")
    start = F.to_date(F.substring(F.element_at(parts, -1), 1, 10))
    # two attributes: name and start; six: name, article, project, access, agent, start
    page = F.when(F.size(parts) >= 6, F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_")).otherwise(F.element_at(parts, 1))
    fits = (start == F.lit(first_day).cast("date")) & (F.size(values) >= n_days)
    kept = F.when(fits, F.slice(values, 1, n_days)).otherwise(F.raise_error(F.concat(F.lit("series does not fit: "), head)))
    rows = body.select(page.alias("page"), F.posexplode(kept).alias("nth", "raw"))
    return rows.select("page", F.date_add(F.lit(first_day).cast("date"), F.col("nth")).alias("day"), F.expr("try_cast(raw AS double)").alias("views"))


def page_dictionary(pages: DataFrame, order: str = "page") -> DataFrame:
    """item_id (place in order, from 0) and page."""
    from ..operators.ranking import numbered

    return numbered(pages.select("page").distinct(), order).select(F.col("nth").cast("string").alias("item_id"), "page")


def read_many(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All Parquet files of a glob as one table."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(pattern)


def read_demand(spark: SparkSession, path: str) -> DataFrame:
    """A stored demand table, item ids as text."""
    df = spark.read.parquet(path) if not path.endswith(".csv") else spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(F.col("timestamp").cast("timestamp"), F.col("item_id").cast("string"), F.col("count").cast("long"), *[c for c in df.columns if c not in ("timestamp", "item_id", "count")])


def write_demand(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {kind}")
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def write_sorted(df: DataFrame, path: str) -> None:
    """CSV files that follow each other in order of (timestamp, item_id as text)."""
    by = [F.col("timestamp"), F.col("item_id").cast("string")]
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("header", True).csv(path)


def write_protocol(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy(*[c for c in ("scenario", "horizon", "method") if c in df.columns]).parquet(path)


def stack_runs(runs: dict[str, DataFrame], column: str = "run") -> DataFrame:
    """Outputs of several runs under each other, named in a column; columns that a run lacks are null."""
    out = None
    for name, df in runs.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def first_slots(demand: DataFrame, n: int) -> DataFrame:
    """The rows of the first n distinct timestamps."""
    keep = demand.select("timestamp").distinct().orderBy("timestamp").limit(n)
    return demand.join(keep, "timestamp", "left_semi")


def fingerprint(df: DataFrame) -> DataFrame:
    """Number of rows and an order-independent sum of row hashes: 48 bits of the md5 of each row's values as text, columns in order of name."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in sorted(df.columns)])
    row = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("content"))


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """Protocol rows as write_protocol lays them down; columns of the folders come last."""
    return spark.read.parquet(path)


#: Columns that a stored result table must have.
RESULT_TABLES = {
    "detailed": ("window_id", "item_id", "method", "stratum", "popularity_score", "actual_count", "mae", "rank_predicted", "rank_actual"),
    "strata": ("window_id", "method", "stratum", "n_items", "mae", "mape", "positive_share", "rank_difference"),
    "comparison": ("metric", "method", "n", "mean_diff"),
}


def _result(name: str, columns: list[str]) -> None:
    if name not in RESULT_TABLES:
        raise ValueError(f"unknown table: {name}")
    if missing := set(RESULT_TABLES[name]) - set(columns):
        raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")


def save_results(df: DataFrame, folder: str, name: str) -> None:
    """Writes a detailed, stratum or comparison table as Parquet (snappy) into a folder of results, by method where it has one."""
    _result(name, df.columns)
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("method").parquet(f"{folder}/{name}")


def load_results(spark: SparkSession, folder: str, name: str, methods: tuple[str, ...] | None = None) -> DataFrame:
    """A table of save_results, of some methods only if named (other folders are not read)."""
    df = spark.read.parquet(f"{folder}/{name}")
    _result(name, df.columns)
    return df if methods is None else df.where(F.col("method").isin(*methods))
