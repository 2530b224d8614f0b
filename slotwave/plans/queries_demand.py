"""Queries on sources, cleaning and slot aggregation."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import grid as G
from ..sources import tables as T
from . import checks_sql as Q
from . import popularity as P
from .registry import query, with_


def _ratings(spark, sf_dir):
    """Events as ratings: event types are the items."""
    return P.table(spark, sf_dir, "events").select(F.col("user_id").alias("userId"), F.col("event_type").alias("movieId"), F.col("value").alias("rating"), F.col("ts").alias("timestamp"))


_SIX = "to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP"


@query(f"SELECT date_trunc('week', ts) AS timestamp, event_type AS item_id, count(*) AS count, {Q.r6('avg(value)')} AS mean_rating, count(DISTINCT user_id) AS user_count FROM events WHERE value >= 10 GROUP BY 1, 2")
def c11_rating_weeks(spark, sf_dir):
    return P.rounded(C.rating_rows(_ratings(spark, sf_dir), "1W", 10.0))


@query("SELECT date_trunc('week', ts) AS timestamp, event_type AS item_id, count(*) AS count, count(DISTINCT user_id) AS user_count, true AS near FROM events GROUP BY 1, 2")
def c11_sketch_weeks(spark, sf_dir):
    """Distinct users a week from sketches of days, held against the exact number: within three standard errors."""
    ratings = _ratings(spark, sf_dir)
    weeks = C.roll_up(C.distinct_sketches(ratings, "1D"), "1W").withColumnRenamed("user_count", "estimate").drop("users")
    exact = C.rating_rows(ratings, "1W").select("timestamp", "item_id", "user_count")
    return weeks.join(exact, ["timestamp", "item_id"]).select("timestamp", "item_id", "count", "user_count", (F.abs(F.col("estimate") - F.col("user_count")) <= 0.05 * F.col("user_count") + 1).alias("near"))


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 6 HOUR * CAST(floor(extract(hour FROM ts) / 6) AS INTEGER) AS timestamp, CAST(user_id AS VARCHAR) AS item_id, count(*) AS count FROM events GROUP BY 1, 2")
def c9_six_hour_counts(spark, sf_dir):
    return C.slot_rows(P.table(spark, sf_dir, "events"), "ts", "user_id", "6h")


@query("SELECT date_trunc('hour', ts) AS timestamp, event_type AS item_id, sum(CAST(floor(value) AS BIGINT)) AS count FROM events WHERE value >= 0 GROUP BY 1, 2")
def c10_hour_sums(spark, sf_dir):
    rows = P.table(spark, sf_dir, "events").where(C.non_negative("value")).withColumn("n", F.floor("value"))
    return C.slot_sums(rows, "ts", "event_type", "n", "1h")


@query("SELECT event_type AS item_id, count(*) AS n_rows FROM events WHERE value BETWEEN 5 AND 60 AND ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2100-01-01' AND user_id > 0 GROUP BY 1")
def c5_range_filters(spark, sf_dir):
    rows = P.table(spark, sf_dir, "events").where(C.within({"value": (5, 60)}) & C.in_period(F.col("ts").cast("timestamp"), "2000-01-01", "2100-01-01") & C.valid_id(F.col("user_id")))
    return rows.groupBy(F.col("event_type").alias("item_id")).agg(F.count("*").alias("n_rows"))


@query("WITH r AS (SELECT CAST(epoch_ms(o_orderdate) AS VARCHAR) AS raw, o_orderdate FROM orders) SELECT o_orderdate AS timestamp, count(*) AS n FROM r GROUP BY 1")
def c1_epoch_times(spark, sf_dir):
    raw = P.table(spark, sf_dir, "orders").select((F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("raw"))
    return raw.select(C.parse_time(F.col("raw"), "ms").alias("timestamp")).groupBy("timestamp").agg(F.count("*").alias("n"))


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, cnt AS count FROM demand WHERE item_id IN (SELECT item_id FROM demand GROUP BY 1 HAVING sum(cnt) >= 600)")
def c12_min_total(spark, sf_dir):
    return C.min_total(P.supplier_weeks(spark, sf_dir), 600)


@query(with_(Q.DEMAND) + ", k AS (SELECT ts FROM demand WHERE item_id IN (SELECT item_id FROM demand GROUP BY 1 HAVING sum(cnt) >= 600)) SELECT DISTINCT ts AS timestamp FROM demand WHERE ts NOT IN (SELECT ts FROM k)")
def c13_same_slots(spark, sf_dir):
    demand = P.supplier_weeks(spark, sf_dir)
    return C.same_slots(demand, C.min_total(demand, 600))


_DAYS = "SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey AS VARCHAR) AS item_id, count(*) AS c FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1994-01-05' AND DATE '1995-03-15' GROUP BY 1, 2"


@query(f"WITH d AS ({_DAYS}), w AS (SELECT CAST(date_trunc('week', d) AS DATE) AS d, item_id, sum(c) AS c FROM d GROUP BY 1, 2) SELECT 'day' AS grain, CAST(d AS TIMESTAMP) AS timestamp, item_id, CAST(c AS BIGINT) AS count FROM d UNION ALL SELECT 'week', CAST(d AS TIMESTAMP), item_id, CAST(c AS BIGINT) FROM w WHERE d >= DATE '1994-01-05' AND d + 6 <= DATE '1995-03-15'")
def c14_full_weeks(spark, sf_dir):
    return C.daily_and_weekly(P.table(spark, sf_dir, "lineitem"), "l_shipdate", "l_suppkey", "1994-01-05", "1995-03-15")


@query("WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT user_id, min(day) AS first FROM p GROUP BY 1) SELECT day, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN day = first THEN n ELSE 0 END) AS BIGINT) AS n_first_day FROM p JOIN f USING (user_id) GROUP BY day")
def c15_first_days(spark, sf_dir):
    return C.first_day_counts(P.table(spark, sf_dir, "events"), "ts", "user_id")


@query("WITH p AS (SELECT p_name AS page, p_partkey FROM part WHERE p_name LIKE '%e%'), n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS nth, count(*) OVER () AS n FROM p) SELECT p_partkey AS item_id FROM n WHERE nth % CAST(ceil(n / 7.0) AS INTEGER) = 0")
def c17_systematic_sample(spark, sf_dir):
    items = P.table(spark, sf_dir, "part").where(F.col("p_name").contains("e")).select(F.col("p_partkey").alias("item_id"))
    return C.systematic_sample(items, 100, 700).select("item_id")


@query("SELECT CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_not_finite, CAST(count(*) FILTER (value < 0) AS BIGINT) AS n_negative, CAST(count(*) FILTER (value <> floor(value)) AS BIGINT) AS n_not_whole FROM events")
def c18_value_checks(spark, sf_dir):
    return C.value_violations(P.table(spark, sf_dir, "events"), "value")


@query(with_(Q.DEMAND) + f"SELECT count(*) AS n_records, count(DISTINCT item_id) AS n_items, min(ts) AS first, max(ts) AS last, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS n_days, CAST(sum(cnt) AS BIGINT) AS total, {Q.r6('CAST(sum(cnt) AS DOUBLE) / count(DISTINCT ts)')} AS mean_per_slot, {Q.r6('avg(cnt)')} AS mean_count, {Q.r6('stddev_samp(cnt)')} AS sd_count FROM demand")
def c21_statistics(spark, sf_dir):
    return P.rounded(C.statistics(P.supplier_weeks(spark, sf_dir)))


@query(with_(Q.DEMAND) + "SELECT CAST(year(ts) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, CAST(sum(cnt) AS BIGINT) AS requests FROM demand GROUP BY year(ts) UNION ALL SELECT NULL, count(*), count(DISTINCT item_id), CAST(sum(cnt) AS BIGINT) FROM demand")
def e27_year_profile(spark, sf_dir):
    return C.year_profile(P.supplier_weeks(spark, sf_dir))


@query("SELECT o_orderkey, l_linenumber, CAST(date_diff('second', o_orderdate, l_shipdate) // 604800 AS BIGINT) AS weeks, o_orderdate + INTERVAL 90 DAY AS in_three_months FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate")
def c22_slot_arithmetic(spark, sf_dir):
    orders = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = P.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    rows = orders.join(lines, "o_orderkey").where("l_shipdate >= o_orderdate")
    return rows.select("o_orderkey", "l_linenumber", C.slots_between(F.col("o_orderdate"), F.col("l_shipdate"), "weekly").alias("weeks"), C.add_slots(F.col("o_orderdate"), 3, "monthly").alias("in_three_months"))


@query("WITH w AS (SELECT event_type AS page, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT page, day, CAST(n AS DOUBLE) AS views FROM w")
def s5_series_lines(spark, sf_dir):
    """Daily series written as text lines and parsed back; '?' stands for a day without a row."""
    daily = P.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("page"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    days = daily.select("page").distinct().select("page", F.explode(F.sequence(F.lit(span.a), F.lit(span.b))).alias("day")).join(daily, ["page", "day"], "left")
    lines = days.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("day", F.coalesce(F.col("n").cast("string"), F.lit("?")).alias("v")))).alias("s"))
    lines = lines.select(F.concat(F.col("page"), F.lit(f":{span.a} 00-00-00:"), F.array_join(F.col("s.v"), ",")).alias("value"))
    return T.parse_series_lines(lines, str(span.a), (span.b - span.a).days + 1).where("views is not null")


def _wide_days(spark, sf_dir):
    """Views of each event type: one column for each day from the first to the last."""
    events = P.table(spark, sf_dir, "events").select(F.col("event_type").alias("Page"), F.to_date("ts").alias("day"))
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    names = [(span.a + timedelta(i)).isoformat() for i in range((span.b - span.a).days + 1)]
    return events.withColumn("day", F.col("day").cast("string")).groupBy("Page").pivot("day", names).count()


@query("SELECT event_type AS page, CAST(ts AS DATE) AS day, count(*) AS views FROM events GROUP BY 1, 2")
def s4_unpivot_days(spark, sf_dir):
    """All days as one column each, and back to rows."""
    return T.unpivot_days(_wide_days(spark, sf_dir)).where("views is not null").withColumnRenamed("Page", "page")


@query("WITH p AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)) SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS timestamp, CAST(k AS VARCHAR) AS item_id, count(*) AS count FROM events JOIN p USING (event_type) GROUP BY 1, 2")
def c19_view_rows(spark, sf_dir):
    """Wide views to demand: zeros for missing cells, zero rows dropped, items by number."""
    views = T.unpivot_days(_wide_days(spark, sf_dir)).withColumnRenamed("Page", "page")
    return C.view_rows(views, T.page_dictionary(views))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand || '_' || p_type LIKE '%\\_%' ESCAPE '\\' AND suffix(p_brand || '_' || p_type, '_' || (SELECT max(p_type) FROM part))")
def c16_suffix_items(spark, sf_dir):
    """Parts whose compound name ends in a given type."""
    part = P.table(spark, sf_dir, "part").withColumn("page", F.concat_ws("_", "p_brand", "p_type"))
    last = part.agg(F.max("p_type")).first()[0]
    return part.where(C.ends_with("page", last)).select("p_partkey", "p_name")


def _csv(df, name: str) -> str:
    path = f"{T.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


@query("SELECT user_id AS \"userId\", CAST(length(event_type) AS INTEGER) AS \"movieId\", count(*) AS n, CAST(sum(floor(epoch(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1, 2")
def s1_ratings_file(spark, sf_dir):
    """Events written as a ratings file and read with the fixed schema."""
    rows = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("userId"), F.length("event_type").alias("movieId"), F.col("value").alias("rating"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"))
    return T.read_ratings(spark, _csv(rows, "ratings")).groupBy(F.col("userId").cast("long").alias("userId"), "movieId").agg(F.count("*").alias("n"), F.sum("timestamp").alias("seconds"))


@query(f"SELECT user_id AS \"PULocationID\", count(*) AS n, {Q.r6('avg(value)')} AS fare FROM events WHERE user_id > 0 AND value BETWEEN 0 AND 50 GROUP BY 1")
def s2_trip_file(spark, sf_dir):
    """Events written as trips, required and optional columns read, ids and fares filtered."""
    path = f"{T.shared_dir(spark)}/trips-{uuid.uuid4().hex}"
    P.table(spark, sf_dir, "events").select(F.col("ts").alias("tpep_pickup_datetime"), F.col("user_id").alias("PULocationID"), F.col("value").alias("fare_amount"), "props").write.parquet(path)
    trips = T.read_trips(spark, path, True).where(C.valid_id(F.col("PULocationID")) & C.within({"fare_amount": (0, 50)}))
    return P.rounded(trips.groupBy("PULocationID").agg(F.count("*").alias("n"), F.avg("fare_amount").alias("fare")))


@query("SELECT CAST(ts AS TIMESTAMP) AS \"Time\", event_type AS \"videoId\", count(*) AS n FROM events WHERE value >= 0 AND ts >= TIMESTAMP '2018-05-01' GROUP BY 1, 2")
def s3_snapshot_file(spark, sf_dir):
    """Events written as snapshots and read; negative differences and early times go."""
    rows = P.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("Time"), F.col("event_type").alias("videoId"), F.col("value").alias("viewCount_diff"))
    found = T.read_snapshots(spark, _csv(rows, "snapshots")).where(C.non_negative("viewCount_diff") & C.in_period(F.col("Time"), "2018-05-01", "2200-01-01"))
    return found.groupBy("Time", "videoId").agg(F.count("*").alias("n"))


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, CAST(cnt AS BIGINT) AS count FROM demand")
def s9_written_demand(spark, sf_dir):
    """Demand written sorted as text and read back."""
    path = f"{T.shared_dir(spark)}/demand-{uuid.uuid4().hex}.csv"
    T.write_sorted(P.supplier_weeks(spark, sf_dir), path)
    return T.read_demand(spark, path)


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, CAST(cnt AS BIGINT) AS count FROM demand")
def s8_stored_demand(spark, sf_dir):
    """Demand written as Parquet and read back with text ids."""
    path = f"{T.shared_dir(spark)}/demand-{uuid.uuid4().hex}"
    T.write_demand(P.supplier_weeks(spark, sf_dir), path)
    return T.read_demand(spark, path)


@query(with_(Q.DEMAND) + "SELECT " + ", ".join(f"CAST(count(*) - count({c}) AS BIGINT) AS {n}_nulls" for c, n in (("ts", "timestamp"), ("item_id", "item_id"), ("cnt", "count"))) + " FROM demand")
def c20_validation(spark, sf_dir):
    return C.validate_schema(P.supplier_weeks(spark, sf_dir))


@query("SELECT event_type AS item_id, count(*) AS n_rows FROM events WHERE value >= 10 GROUP BY 1")
def c7_least_rating(spark, sf_dir):
    """Rows at or above a least rating."""
    return _ratings(spark, sf_dir).where(F.col("rating") >= 10).groupBy(F.col("movieId").alias("item_id")).agg(F.count("*").alias("n_rows"))


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, CAST(2 * cnt AS BIGINT) AS count FROM demand")
def s6_merge_files(spark, sf_dir):
    demand = P.supplier_weeks(spark, sf_dir)
    return C.merge_rows(demand.unionByName(demand))


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, cnt AS count FROM demand WHERE ts IN (SELECT DISTINCT ts FROM demand ORDER BY ts LIMIT 20)")
def s14_first_slots(spark, sf_dir):
    return T.first_slots(P.supplier_weeks(spark, sf_dir), 20)


@query(with_(Q.DEMAND) + "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(cnt || '|' || item_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 12) AS HUGEINT)) AS VARCHAR) AS content FROM demand")
def s15_fingerprint(spark, sf_dir):
    return T.fingerprint(P.supplier_weeks(spark, sf_dir))


@query(with_(Q.DEMAND) + "SELECT run, ts AS timestamp, item_id, cnt AS count FROM demand, (VALUES ('a'), ('b')) r(run) WHERE run = 'a' OR cnt >= 3")
def s13_stack_runs(spark, sf_dir):
    demand = P.supplier_weeks(spark, sf_dir)
    return T.stack_runs({"a": demand, "b": demand.where("count >= 3")})


@query(with_(Q.DEMAND) + "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS item_id, item_id AS page FROM (SELECT DISTINCT item_id FROM demand)")
def s10_page_dictionary(spark, sf_dir):
    return T.page_dictionary(P.supplier_weeks(spark, sf_dir).withColumnRenamed("item_id", "page"))


@query(with_(Q.DEMAND) + "SELECT item_id FROM demand GROUP BY 1 ORDER BY sum(cnt) DESC, item_id LIMIT 15")
def g6_top_items(spark, sf_dir):
    return G.select_items(P.supplier_weeks(spark, sf_dir), 15)


_TOTALS = "tt AS (SELECT item_id, avg(cnt) AS mean, CAST('0x' || substr(md5('42:' || item_id), 1, 12) AS BIGINT) AS h FROM demand GROUP BY 1)"


@query(with_(Q.DEMAND, _TOTALS, "tq AS (SELECT quantile_cont(mean, [0.25, 0.5, 0.9]) AS q, count(*) AS n FROM tt), tl AS (SELECT item_id, h, n, CASE WHEN mean < q[1] THEN 0 WHEN mean < q[2] THEN 1 WHEN mean < q[3] THEN 2 ELSE 3 END AS st FROM tt, tq), td AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, item_id) AS nth, floor(count(*) OVER (PARTITION BY st) * 30 / n::DOUBLE) AS quota FROM tl)") + "SELECT item_id FROM td ORDER BY nth > quota, h, item_id LIMIT 30")
def g6_stratified_items(spark, sf_dir):
    return G.select_items(P.supplier_weeks(spark, sf_dir), 30, "stratified")


@query(with_(Q.DEMAND, _TOTALS) + "SELECT item_id FROM tt ORDER BY h, item_id LIMIT 12")
def g6_random_items(spark, sf_dir):
    return G.select_items(P.supplier_weeks(spark, sf_dir), 12, "random")


@query(with_(Q.DEMAND) + "SELECT ts AS timestamp, item_id, cnt AS count FROM demand WHERE item_id IN (SELECT item_id FROM demand GROUP BY 1 HAVING sum(cnt) >= 610)")
def g5_catalogue(spark, sf_dir):
    return G.whole_file_catalogue(P.supplier_weeks(spark, sf_dir), 610)
