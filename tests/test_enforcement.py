from __future__ import annotations

import random

from pyspark.sql import functions as F

from bulwark.operators import sessions as ss
from bulwark.streaming import enforcement as en

SCHEMA = "key string, micros long, severity string, clear boolean"


def test_state_is_read_back(spark, tmp_path):
    """Counts of a live stream, and statistics read from its checkpoint, equal a batch recount."""
    rng = random.Random(1)
    rows = sorted({(f"k{rng.randint(0, 9)}", rng.randint(0, 2000) * 1_000_000) for _ in range(300)}, key=lambda r: r[1])
    rows = [(k, m, rng.choice(["low", "high", "critical", None]), False) for k, m in rows] + [("k0", 2_000_000_001, None, True), ("k1", 2_000_000_001, None, True), ("k1", 2_000_000_002, "high", False)]
    folder = str(tmp_path / "in")
    for cut in range(0, len(rows), 100):
        spark.createDataFrame(rows[cut : cut + 100], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = en.enforced(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), 1, 2, 300)
        checkpoint = str(tmp_path / "c")
        query = live.writeStream.format("memory").queryName("enforced").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
        stats = {r.key: r for r in en.violation_stats(spark, checkpoint, 2_000_000_002).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    plain = spark.createDataFrame(rows, SCHEMA).filter("NOT clear AND micros <= 2000000000")
    batch = ss.escalated(plain, "key", "micros", 1, 2, 300).cache()
    want = sorted((r.key, r.micros, r["count"], r.phase) for r in batch.collect())
    assert sorted((r.key, r.micros, r["count"], r.phase) for r in spark.table("enforced").filter("micros <= 2000000000").collect()) == want
    assert "k0" not in stats and (stats["k1"]["count"], stats["k1"].high, stats["k1"].window_start) == (1, 1, 2_000_000_002)
    last = batch.filter("key NOT IN ('k0', 'k1')").groupBy("key").agg(F.max_by(F.struct("window_start", "count"), "micros").alias("w")).select("key", "w.*")
    current = {r.key: (r.window_start, r["count"]) for r in last.filter("2000000002 - window_start <= 300000000").collect()}
    assert {k: (r.window_start, r["count"]) for k, r in stats.items() if k != "k1"} == current and len(current) > 3
    for k, r in stats.items():
        seen = [x for x in rows if x[0] == k and x[1] >= r.window_start and not x[3]]
        assert {s: r[s] for s in ("low", "medium", "high", "critical")} == {s: sum(x[2] == s for x in seen) for s in ("low", "medium", "high", "critical")}
