"""Sessions of scored events: windows that grow and merge under a watermark (Z-05).

A session of a user holds events less than a gap apart and ends a gap after the last one.
``sessions`` works on tables and, in append mode, on streams: a session is given out once,
when the watermark has passed its end. ``live_sessions`` is for update mode, where Spark has
no session windows: after every micro-batch it gives out the sessions that have changed, and
``gone`` marks one that has been merged into an earlier one. An event older than the watermark
is too late and is left out by both.

A user's state is the sessions that are still open, so it is bounded by what arrives within
the watermark's delay; events themselves are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(scores: DataFrame, gap: str = "10 minutes", late: str = "10 minutes", threshold: float = 0.5) -> DataFrame:
    """user_id, start, end, count, tp, fp, mean_score from scores(user_id, at, label, score)."""
    rows = scores.withWatermark("at", late) if scores.isStreaming else scores
    yes = F.col("score") >= threshold
    out = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if((F.col("label") == 1) & yes).alias("tp"), F.count_if((F.col("label") == 0) & yes).alias("fp"), F.avg("score").alias("mean_score"),
    )
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count", "tp", "fp", "mean_score")


OUT = "user_id long, start timestamp, end timestamp, count long, tp long, fp long, mean_score double, gone boolean"
STATE = "start array<long>, last array<long>, count array<long>, tp array<long>, fp array<long>, total array<double>"


def merged(open_: list[list], events: list[tuple], gap: int) -> tuple[list[list], list[list], set[int]]:
    """Open sessions [start, last, count, tp, fp, total] after events (at, tp, fp, score): all of them
    by start, those that have changed, and starts that no session has any more."""
    before = {s[0] for s in open_}
    rows = sorted([(s, False) for s in open_] + [([at, at, 1, tp, fp, score], True) for at, tp, fp, score in events], key=lambda r: r[0][0])
    out: list[list] = []
    changed: list[bool] = []
    for s, new in rows:
        if out and s[0] - out[-1][1] < gap:
            held = out[-1]
            out[-1] = [held[0], max(held[1], s[1]), *[a + b for a, b in zip(held[2:], s[2:], strict=True)]]
            changed[-1] = True
        else:
            out.append(list(s))
            changed.append(new)
    return out, [s for s, c in zip(out, changed, strict=True) if c], before - {s[0] for s in out}


def _update(gap: int, threshold: float):
    def run(key, frames, state):
        import pandas as pd

        mark = state.getCurrentWatermarkMs() * 1000
        held = [list(s) for s in zip(*state.get, strict=True)] if state.exists else []
        changed, gone = [], set()
        if not state.hasTimedOut:
            events = []
            for f in frames:
                at = f["at"].astype("datetime64[us]").astype("int64")
                yes = f["score"] >= threshold
                events += [(int(t), int(y == 1 and z), int(y != 1 and z), float(s)) for t, y, z, s in zip(at, f["label"], yes, f["score"], strict=True) if t >= mark]
            held, changed, gone = merged(held, events, gap)
        held = [s for s in held if s[1] + gap > mark]
        if held:
            state.update(tuple([s[k] for s in held] for k in range(6)))
            state.setTimeoutTimestamp(max(min(s[1] for s in held) + gap, mark + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        when = lambda us: pd.Timestamp(us, unit="us")
        rows = [(key[0], when(s[0]), when(s[1] + gap), *s[2:5], s[5] / s[2], False) for s in changed]
        rows += [(key[0], when(s), None, 0, 0, 0, None, True) for s in sorted(gone)]
        yield pd.DataFrame(rows, columns=["user_id", "start", "end", "count", "tp", "fp", "mean_score", "gone"])

    return run


def live_sessions(scores: DataFrame, gap_seconds: int = 600, late: str = "10 minutes", threshold: float = 0.5) -> DataFrame:
    """The columns of ``sessions`` and ``gone``, for update mode. The session's time zone has to be UTC."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = scores.select(F.col("user_id").cast("long").alias("user_id"), "at", "label", "score").withWatermark("at", late)
    return rows.groupBy("user_id").applyInPandasWithState(
        _update(gap_seconds * 1_000_000, threshold), OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
