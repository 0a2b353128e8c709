"""Stateful streams: a restart changes nothing, and single rules on literals."""

from siltline.plans import polling
from siltline.streaming.processors import interval
from siltline.streaming.tables import state_on_disk

POSTS = {  # channel 1, by poll: (id, second)
    1: [(7, 3700), (8, 3800)], 2: [(8, 7300), (9, 7400)], 3: [], 5: [(10, 18100)], 80: [(8, 288100)], 81: [(8, 288050)],
}


def test_the_poll_step_survives_a_restart(spark, tmp_path):
    schema = "channel long, poll long, posts array<struct<id:long,second:long>>"
    got = []
    for polls in ([1, 2], [3, 5], [80, 81]):
        spark.createDataFrame([(1, p, POSTS[p]) for p in reversed(polls)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with state_on_disk(spark, idle=False):
            rows = polling.poll_steps(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            keep = lambda batch, _: got.extend(batch.collect())
            run = rows.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).foreachBatch(keep).start()
            run.awaitTermination()
    rows = {r.poll: r for r in got}
    assert len(got) == 6
    # 8 was known at poll 2, is forgotten at poll 80, known again at 81
    assert {p: r.fresh for p, r in rows.items()} == {1: 2, 2: 1, 3: 0, 5: 1, 80: 1, 81: 0}
    # posts may be missed where even the oldest is newer than all seen; never at first or without posts
    assert {p for p, r in rows.items() if r.overflow} == {2, 5, 80}
    assert rows[81].seen == 288100 and rows[1].rate is None and rows[2].rate == 1.0 and abs(rows[3].rate - 0.7) < 1e-12


def test_files_of_a_step_come_in_any_order(spark):
    from siltline.streaming.tables import arriving, settled

    posts = [(1, p, [(p, 3600 * p)]) for p in range(40)]
    schema = "channel long, poll long, posts array<struct<id:long,second:long>>"
    df = spark.createDataFrame(posts[::-1], schema).repartition(8)  # a channel's polls lie in several files of a step
    with state_on_disk(spark, idle=False):
        rows, arrivals = arriving(df, "poll", 2)
        got = settled(polling.poll_steps(rows), ["channel", "poll"], arrivals=arrivals).collect()
    assert {r.poll: r.seen for r in got} == {p: 3600 * p for p in range(40)}
    assert all(r.fresh == 1 and (r.rate == 1.0 or r.poll == 0) for r in got)


def test_intervals():
    assert interval(None, 0, False) == interval(0.0, 3, False) == 86400
    assert interval(60.0, 0, False) == 3600 and interval(60.0, 0, True) == 1800 and interval(60.0, 2, False) == 7200
    assert interval(1000.0, 0, True) == 900 and interval(1000.0, 9, False) == 900


def test_first_failures_with_large_ids(spark):
    from siltline.plans.desk import first_failures

    rows = [(1, "failed", 5, 2_000_001), (1, "failed", 4, 3_000_007), (1, "failed", 4, 3_000_009), (2, "failed", 9, 1_000_000)]
    got = first_failures(spark.createDataFrame(rows, "run_id int, state string, second long, id long")).collect()
    assert sorted((r.run_id, r.id, r.repeats) for r in got) == [(1, 3_000_007, 2), (2, 1_000_000, 0)]


def test_a_bucket_of_channels_reads_and_writes_its_state_once():
    """Many channels in one bucket: each has its own cursor and posts, and state is called four times a batch."""
    import numpy as np
    import pandas as pd

    from siltline.streaming.processors import KEPT_MS, PollStep

    calls, clock = [], [0]

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

    class Handle:
        def getValueState(self, name, schema, ttlDurationMs=None):  # noqa: N802, N803
            return Value()

    class Timer:
        def getCurrentProcessingTimeInMs(self):  # noqa: N802
            return clock[0]

    step = PollStep()
    step.init(Handle())

    def batch(poll):
        rows = [(c, poll, np.array([7, 100 + c % 3 + poll]), False, 3600 * poll, 3600 * poll + c) for c in range(500)]
        frame = pd.DataFrame(rows[::-1], columns=["channel", "poll", "ids", "blank", "oldest", "newest"])
        calls.clear()
        got = pd.concat(step.handleInputRows((1,), iter([frame[:200], frame[200:]]), Timer()))
        assert sorted(calls) == ["get", "get", "update", "update"] and sorted(got["channel"]) == list(range(500))
        return got

    assert set(batch(1)["fresh"]) == {2} and set(batch(2)["fresh"]) == {1}  # post 7 is known
    assert set(batch(75)["fresh"]) == {2} and set(batch(147)["fresh"]) == {1}  # for 72 polls
    clock[0] = KEPT_MS + 1
    assert set(batch(148)["fresh"]) == {2}  # not after a month without a poll
    assert set(batch(149)["seen"] - batch(150)["seen"]) == {-3600}


def test_posts_and_channels_without_numbers(spark):
    from siltline.streaming.tables import arriving, settled

    far = 2**60 + 1
    rows = [(5, 1, [(None, 3600), (None, 3601), (far, 3602)]), (5, 2, [(None, 7200), (far + 1, 7201)]), (None, 1, [(far, 3600)]), (None, 2, [(far, 7200)]), (far, 2, [])]
    df = spark.createDataFrame(rows, "channel long, poll long, posts array<struct<id:long,second:long>>")
    with state_on_disk(spark, idle=False):
        stream, arrivals = arriving(df, "poll", 2)
        got = settled(polling.poll_steps(stream), ["channel", "poll"], arrivals=arrivals).collect()
    assert {(r.channel, r.poll): (r.fresh, r.seen) for r in got} == {(5, 1): (2, 3602), (5, 2): (1, 7201), (None, 1): (1, 3600), (None, 2): (0, 7200), (far, 2): (0, None)}
