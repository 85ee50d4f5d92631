"""Streams in event order: files in any order give the rows of the sorted table."""

import random
from datetime import datetime, timedelta

import pytest

from layerroutes.streaming import monitor

SCHEMA = "user_id long, event_id long, ts timestamp, value double, event_type string, n_tokens long"
START = datetime(2024, 1, 1)


def units(r, users, whole=True):
    rows = []
    for u in range(users):
        n = r.randint(1, 25)
        for i in range(n):
            rows.append((u, 1000 * u + i, START + timedelta(seconds=r.randrange(3600)), r.random(), r.choice("abc"), n if whole else None))
    return rows


def expected(rows, threshold):
    means, alarms, pairs = [], [], []
    for u in {x[0] for x in rows}:
        own = sorted({x for x in rows if x[0] == u}, key=lambda x: (x[2], x[1]))
        told = False
        for i, x in enumerate(own):
            means.append((u, i + 1, pytest.approx(sum(y[3] for y in own[: i + 1]) / (i + 1))))
            if x[3] > threshold and not told:
                alarms.append((u, i + 1, x[3]))
                told = True
            if i:
                pairs.append((u, own[i - 1][4], x[4]))
    return sorted(means, key=lambda m: m[:2]), sorted(alarms), sorted(pairs)


def run(spark, tmp_path, files, make):
    src = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = {}

    def keep(batch, i):
        out.setdefault("rows", []).extend(map(tuple, batch.collect()))

    q = make(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.get("rows", [])


@pytest.fixture
def shuffled():
    r = random.Random(4)
    rows = units(r, 12)
    again = rows + r.sample(rows, 30)  # repeated units, some after their response was told
    r.shuffle(again)
    return rows, [again[i::5] for i in range(5)]


def test_prefix_means_of_shuffled_files(spark, tmp_path, shuffled):
    rows, files = shuffled
    assert sorted(run(spark, tmp_path, files, lambda s: monitor.prefix_means(s, delay="2 hours"))) == expected(rows, 0.8)[0]


def test_alarms_of_shuffled_files(spark, tmp_path, shuffled):
    rows, files = shuffled
    assert sorted(run(spark, tmp_path, files, lambda s: monitor.alarms(s, 0.8, delay="2 hours"))) == expected(rows, 0.8)[1]


def test_transitions_of_shuffled_files(spark, tmp_path, shuffled):
    rows, files = shuffled
    assert sorted(run(spark, tmp_path, files, lambda s: monitor.transition_pairs(s, delay="2 hours"))) == expected(rows, 0.8)[2]


def test_units_of_unknown_number_wait_for_the_watermark(spark, tmp_path):
    rows = units(random.Random(6), 5, whole=False)
    rows.sort(key=lambda x: x[2])
    late = [(99, 1, START + timedelta(days=2), 0.5, "a", None)]  # moves the watermark past all others
    files = [rows[1::2], rows[::2], late, [(99, 2, START + timedelta(days=3), 0.5, "a", None)]]
    got = run(spark, tmp_path, files, lambda s: monitor.prefix_means(s, delay="6 hours"))
    assert sorted(x for x in got if x[0] != 99) == expected(rows, 1)[0]


def test_repetitions_of_a_told_response_stay_out(spark, tmp_path):
    rows = units(random.Random(8), 3)
    far = [[(90 + i, i, START + timedelta(days=2 + i), 0.5, "a", None)] for i in range(3)]
    got = run(spark, tmp_path, [rows, rows[:10], *far], lambda s: monitor.prefix_means(s, delay="2 hours"))
    assert sorted(x for x in got if x[0] < 90) == expected(rows, 1)[0]


@pytest.mark.parametrize("groups", [1, 3])
def test_responses_that_share_a_state(spark, tmp_path, shuffled, groups):
    rows, files = shuffled
    far = [[(90 + i, i, START + timedelta(days=2 + i), 0.5, "a", None)] for i in range(3)]
    files = [*files, rows[:10], *far, [(90, 9, START + timedelta(days=9), 0.5, "b", None)]]
    got = run(spark, tmp_path, files, lambda s: monitor.prefix_means(s, delay="2 hours", groups=groups))
    assert sorted(x for x in got if x[0] < 90) == expected(rows, 1)[0]
    assert sorted(x for x in got if x[0] >= 90) == [(90, 1, 0.5), (91, 1, 0.5), (92, 1, 0.5)]


def test_units_of_a_null_id_are_one_response(spark, tmp_path):
    rows = [(None if x[0] == 1 else x[0] + 2**60, *x[1:]) for x in units(random.Random(9), 4)]
    got = run(spark, tmp_path, [rows[::2], rows[1::2]], lambda s: monitor.prefix_means(s, delay="2 hours", groups=1))
    assert {(x[0], x[1]) for x in got} == {(u, i + 1) for u in {x[0] for x in rows} for i in range(sum(y[0] == u for y in rows))}
