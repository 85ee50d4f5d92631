"""Streaming forms of monitoring in event order: causal prefix means, one alarm a response,
transitions between adjacent units.

Units of a response may arrive in any order and more than once. They wait in its state until
their place is certain: until the watermark has passed them, or the response is complete. So
the results are those of the sorted table, however rows are dealt to files and batches."""

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "user_id long, token_end long, event_id long, value double, mean double, before string, event_type string, alarm boolean"


def ordered_units(events: DataFrame, threshold: float = math.inf, delay: str = "1 hour", idle: str = "1 day", groups: int = 1024) -> DataFrame:
    """Each unit of ``events(user_id, event_id, ts, value, event_type, n_tokens)`` once, in the
    order of (ts, event_id) within its response: token_end (its place from 1), mean of all values
    up to it, the event type before, and alarm, true at the first value over ``threshold``.

    n_tokens is the number of units of the whole response, or null where it is not known: with
    it, the response is told as soon as all units are there, and its state shrinks to a mark
    that goes when the watermark passes its last unit (older rows never arrive). A unit whose
    (ts, event_id) is waiting or was told before is a repetition and is dropped, and so is one
    that comes after a later unit was told. State is the waiting units, bounded by the watermark's
    ``delay``, and a few numbers; a response that gets no units for ``idle`` of event time goes.

    Responses share ``groups`` states by a hash of their id, since Spark's exchange with Python
    costs more for a group than for its rows. A batch with units of a group writes its whole
    state anew, so many responses at once ask for more groups."""
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def told_of(s, rows, now: int, out: list, user):
        """The state of one response (None: it goes), and the event time in ms at which it is due."""
        if "done" in s:  # what still comes of a told response is a repetition
            return (s, s["done"]) if rows or now <= s["done"] else (None, None)
        wait = {(t, i): (v, k) for t, i, v, k in s["wait"]}
        latest = s.get("seen", 0)
        for t, i, v, k, n in rows:
            latest = max(latest, t)
            if s["mark"] is None or (t, i) > tuple(s["mark"]):
                wait.setdefault((t, i), (v, k))
            if not pd.isna(n):
                s["total"] = int(n)
        whole = s["total"] is not None and s["n"] + len(wait) >= s["total"]
        told = sorted(u for u in wait if whole or u[0] <= now * 1000)
        for u in told:
            v, k = wait.pop(u)
            s["n"], s["sum"] = s["n"] + 1, s["sum"] + v
            alarm = v > threshold and not s["told"]
            out.append((user, s["n"], u[1], v, s["sum"] / s["n"], s["last"], k, alarm))
            s["told"], s["last"], s["mark"] = s["told"] or alarm, k, u
        if whole:
            return {"done": latest // 1000 + 1}, latest // 1000 + 1
        if not rows and not wait and not told:
            return None, None
        s["wait"], s["seen"] = [[t, i, v, k] for (t, i), (v, k) in wait.items()], latest
        return s, min(wait)[0] // 1000 if wait else latest // 1000 + pause

    def step(key, pdfs, state: GroupState):
        held = dict(json.loads(state.get[0])) if state.exists else {}  # user: [state, due]
        came: dict = {}
        for f in pdfs:
            users = [None] * len(f) if pd.isna(key[0]) else f["user_id"].tolist()
            at = f["ts"].astype("datetime64[us]").astype("int64").tolist()
            for user, *unit in zip(users, at, f["event_id"].tolist(), f["value"].astype("float64").tolist(), f["event_type"].tolist(), f["n_tokens"].tolist()):
                came.setdefault(user, []).append(unit)
        now = state.getCurrentWatermarkMs()
        out: list = []
        for user in [*came, *(u for u, (_, due) in held.items() if u not in came and due < now)]:
            s = held[user][0] if user in held else {"n": 0, "sum": 0.0, "last": None, "told": False, "mark": None, "total": None, "wait": []}
            s, due = told_of(s, came.get(user, ()), now, out, user)
            if s is None:
                held.pop(user, None)
            else:
                held[user] = (s, max(now + 1, due))
        if held:
            state.update((json.dumps(list(held.items())),))
            state.setTimeoutTimestamp(max(now + 1, min(due for _, due in held.values())))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    group = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(groups)))
    units = events.withWatermark("ts", delay).select(group.alias("share"), "user_id", "event_id", "ts", "value", "event_type", "n_tokens")
    return units.groupBy("share").applyInPandasWithState(step, OUT, "packed string", "append", GroupStateTimeout.EventTimeTimeout)


def prefix_means(events: DataFrame, **kw) -> DataFrame:
    """Rows (user_id, token_end, mean): the mean of a response up to each of its units."""
    return ordered_units(events, **kw).select("user_id", "token_end", "mean")


def alarms(events: DataFrame, threshold: float, **kw) -> DataFrame:
    """One row (user_id, token_end, score) for each response at its first score over the
    threshold."""
    return ordered_units(events, threshold, **kw).where("alarm").select("user_id", "token_end", F.col("value").alias("score"))


def transition_pairs(events: DataFrame, **kw) -> DataFrame:
    """Adjacent states of each response (user_id, a, b), repeated units dropped. Counting them is
    a groupBy downstream."""
    return ordered_units(events, **kw).where("before is not null").select("user_id", F.col("before").alias("a"), F.col("event_type").alias("b"))
