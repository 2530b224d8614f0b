"""Every registered query with SQL against DuckDB, the entry query, streams and sources."""

import math
import os
from datetime import datetime, timedelta

import duckdb
import pytest

from slotwave.plans.registry import ORACLE_SQL, QUERIES
from slotwave.sources import tables as T
from slotwave.streaming import online

from .conftest import SMALL

import slotwave.queries  # noqa: F401, I001  registers them

#: Tables that the SQL is compared on; sf0.01 shows more than the small ones and takes longer.
FOLDER = os.environ.get("SLOTWAVE_SF_DIR", SMALL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(ORACLE_SQL[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_series_lines(spark):
    lines = ["# c", "@data", "", "T1:2024-01-01 00-00-00:1,?,3,4", "T2:A_b:en.wiki:all:spider:2024-01-01 00-00-00:5,6,7"]
    got = {(r.page, r.day.isoformat()): r.views for r in T.parse_series_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "2024-01-01", 3).collect()}
    assert got == {("T1", "2024-01-01"): 1.0, ("T1", "2024-01-02"): None, ("T1", "2024-01-03"): 3.0} | {("A_b_en.wiki_all_spider", f"2024-01-0{i}"): 4.0 + i for i in (1, 2, 3)}
    with pytest.raises(Exception, match="does not fit"):
        T.parse_series_lines(spark.createDataFrame([("T1:2024-01-02 00-00-00:1,2,3",)], "value string"), "2024-01-01", 3).collect()


def test_round_trips(spark, tmp_path):
    d = spark.createDataFrame([(datetime(2024, 1, 1), "b", 2), (datetime(2024, 1, 1), "a", 1)], "timestamp timestamp, item_id string, count long")
    T.write_demand(d, f"{tmp_path}/p")
    T.write_sorted(d, f"{tmp_path}/c")
    assert T.read_demand(spark, f"{tmp_path}/p").exceptAll(d).isEmpty()
    assert [r.item_id for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="unknown format"):
        T.write_demand(d, f"{tmp_path}/x", "feather")


def test_decay_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), "i", n) for h, n in ((0, 4), (1, 2), (4, 8))]
    spark.createDataFrame(rows, "timestamp timestamp, item_id string, count long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("timestamp timestamp, item_id string, count long").parquet(f"{tmp_path}/in")
    out = online.drained(online.stream_decay_scores(stream, 3600), f"{tmp_path}/out", "update").collect()[-1]
    ewma = 0.2 * 8 + (0.2 * 2 + 4 * 0.8) * 0.8**3
    assert math.isclose(out.af, 8 + (2 + 4 / 2) / 8) and math.isclose(out.ewma, ewma)


def test_remove_stored(spark, tmp_path, monkeypatch):
    """Only the library's own folders go, and only when nothing in them is new."""
    monkeypatch.setattr(T, "shared_dir", lambda session: f"file://{tmp_path}")
    kept = T.stored(spark.range(3).toDF("v"), "kept")
    old = T.stored(spark.range(3).toDF("v"), "old").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    live = T.stored(spark.range(3).toDF("v"), "live").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    (tmp_path / "others").mkdir()
    for folder in (old, live, tmp_path / "others"):
        for path in (*[os.path.join(folder, f) for f in os.listdir(folder)], folder):
            os.utime(path, (1, 1))
    with open(f"{live}/new", "w") as f:
        f.write("x")
    os.utime(live, (1, 1))
    assert T.remove_stored(spark, 1) == [os.path.basename(old)]
    assert os.path.isdir(live) and (tmp_path / "others").is_dir() and kept.count() == 3 and T.remove_stored(spark, 1) == []


def test_snapshot_totals_do_not_fall_by_rounding(spark, tmp_path):
    """A total of values from zero on never falls, however many values it has; the SQL says the same."""
    con = duckdb.connect()
    con.execute("create table events as select i as event_id, timestamp '2024-01-01' + interval (i) second as ts, i % 5 as user_id, 'view' as event_type, case when i // 5 % 3 > 0 then 0.0 else (i * 7919 % 56021) / 100.0 end::double as value, '' as props from range(200000) t(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    found = con.execute(ORACLE_SQL["q7_snapshot_profile"])
    names = [x[0] for x in found.description]
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    assert all(r[names.index("n_falls")] == 0 for r in want)
    got = QUERIES["q7_snapshot_profile"](spark, str(tmp_path)).select(names).collect()
    assert sorted(tuple(plain(v) for v in r) for r in got) == want
