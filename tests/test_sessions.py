"""Sessions in append and update mode against plain grouping."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import sessions

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, at timestamp, label int, score double"


def plain(rows, gap):
    out = []
    for user in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == user)
        groups = [[own[0]]]
        for r in own[1:]:
            if (r[1] - groups[-1][-1][1]).total_seconds() < gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            out.append((user, g[0][1], g[-1][1] + timedelta(seconds=gap), len(g), sum(y == 1 and s >= 0.5 for _, _, y, s in g), sum(y == 0 and s >= 0.5 for _, _, y, s in g), round(sum(r[3] for r in g) / len(g), 9)))
    return sorted(out)


def rows(seed, n=120):
    rng = random.Random(seed)
    return [(rng.randrange(4), START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(10**6)), rng.randrange(2), rng.random()) for _ in range(n)]


def key(r):
    return (r["user_id"], r["start"], r["end"], r["count"], r["tp"], r["fp"], round(r["mean_score"], 9))


def test_sessions_of_a_table(spark):
    given = rows(1)
    found = sessions.sessions(spark.createDataFrame(given, SCHEMA), "10 minutes").collect()
    assert sorted(map(key, found)) == plain(given, 600)
    assert sessions.sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merged_state_equals_all_at_once():
    rng = random.Random(4)
    for _ in range(50):
        events = [(rng.randrange(3000), rng.randrange(2), 0, 1.0) for _ in range(40)]
        held, gap = [], 60
        for k in range(0, 40, 7):
            held, changed, gone = sessions.merged(held, events[k : k + 7], gap)
            assert all(c in held for c in changed) and not gone & {s[0] for s in held}
        assert held == sessions.merged([], events, gap)[0]


@pytest.mark.parametrize("mode", ["append", "update"])
def test_streams_with_late_and_unordered_events(spark, tmp_path, mode):
    given = sorted(rows(2), key=lambda r: r[1])
    parts = [given[:50], given[50:90], given[90:]]
    parts[1].append((1, given[45][1], 1, 0.9))  # out of order, within the delay of an hour
    late = (2, START - timedelta(hours=9), 1, 0.9)
    parts[2].append(late)
    folder, table = tmp_path / "in", f"sessions_{mode}"
    frame = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out: dict = {}
    for part in [*parts, [(9, START + timedelta(days=2), 0, 0.1)], [(9, START + timedelta(days=4), 0, 0.1)]]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        live = sessions.sessions(frame(), "10 minutes", "1 hour") if mode == "append" else sessions.live_sessions(frame(), 600, "1 hour")

        def keep(batch, _):
            for r in batch.collect():
                if mode == "update" and r["gone"]:
                    out.pop((r["user_id"], r["start"]), None)
                else:
                    assert mode == "update" or (r["user_id"], r["start"]) not in out  # once only
                    out[r["user_id"], r["start"]] = r

        live.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(tmp_path / table)).trigger(availableNow=True).start().awaitTermination()
    want = plain([r for p in parts for r in p if r != late], 600)
    assert sorted(key(r) for r in out.values() if r["user_id"] != 9) == want
