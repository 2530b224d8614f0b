"""State that expires: its size, its scores, late rows, items that come back."""

from datetime import datetime, timedelta

import pytest

from slotwave.streaming import online

START = datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp, item_id string, count long"


def run(spark, folder, batches, dormant):
    """Rows given out and (rows in state, late rows) of each micro-batch, where each list of (hour, item, count) is one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame([(START + timedelta(hours=h), item, n) for h, item, n in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = []
    with online.rocksdb(spark):
        scores = online.stream_expiring_scores(stream, 3600, dormant, "2 hours")
        query = scores.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode("update").foreachBatch(lambda batch, i: out.extend(batch.collect())).start()
        query.awaitTermination()
    return out, online.state_sizes(query.recentProgress)


def test_items_that_stop(spark, tmp_path):
    """One item goes on, each batch brings one that never returns: the state stays small, and what is dropped has decayed to where it was dropped."""
    batches = [[(20 * b, "live", 2 + b), (20 * b, f"once{b}", 4)] for b in range(8)]
    batches[6].append((0, "late", 9))
    out, sizes = run(spark, tmp_path, batches, 30)
    # 'once' items live for some 30 slots, less than two batches, and timers fire one batch later
    assert max(rows for rows, _ in sizes) <= 4 and sum(late for _, late in sizes) == 1
    assert "late" not in {r.item_id for r in out}
    first = int(START.timestamp()) // 3600
    gone = {r.item_id: r for r in out if r.dropped}
    assert {"once0", "once1", "once2", "once3"} <= gone.keys() and "live" not in gone
    assert all(gone[f"once{b}"].slot - gone["once0"].slot == 20 * b for b in range(4))
    assert gone["once0"].slot - min(r.slot for r in out if r.item_id == "live") == 30 and first > 0
    assert gone["once0"].af == pytest.approx(4 * 0.5**30) and gone["once0"].ewma == pytest.approx(4 * 0.8**30)
    live = [r for r in out if r.item_id == "live"][-1]
    assert live.af == pytest.approx(sum((2 + b) * 0.5 ** (20 * (7 - b)) for b in range(8)))
    assert live.ewma == pytest.approx(sum((2 + b) * (0.2 if b else 1) * 0.8 ** (20 * (7 - b)) for b in range(8)))


def test_item_that_returns(spark, tmp_path):
    """After its state has gone an item starts anew; before that it does not."""
    batches = [[(0, "a", 8), (0, "b", 8)], [(3, "b", 1), (3, "clock", 1)], [(40, "clock", 1)], [(41, "clock", 1)], [(42, "a", 1), (42, "clock", 1)]]
    out, _ = run(spark, tmp_path, batches, 5)
    a = [r for r in out if r.item_id == "a"]
    assert [r.dropped for r in a] == [False, True, False] and a[-1].af == 1
    assert [r.af for r in out if r.item_id == "b"][:2] == [8, 2]
