"""Streams that stop and go on, states that are saved and merged, segments of steps."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import reduce as R
from fieldloom.sources import states as S
from fieldloom.streaming import tapes as T

SPEC = {"T": "A", "TSMX": "X", "TSMN": "M", "PS": "I"}
STREAMS = {"month": T.Stream(R.Cal("m")), "nine": T.Stream(R.Steps(9)), "days": T.Stream(R.Cal("d", 5), "noleap"), "year": T.Stream(R.Cal("y", 2))}
HISTORY = "member int, field string, ts timestamp_ntz, step long, cell long, value double"


def samples(spark, n=2000):
    at = F.expr("timestamp_ntz'2024-01-25' + make_dt_interval(0, cast(id * 5 as int))")
    return spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("member"), F.element_at(F.array(*map(F.lit, [*SPEC, "OTHER"])), (F.col("id") % 5 + 1).cast("int")).alias("field"),
        at.alias("ts"), (F.col("id") + 1).alias("step"), (F.col("id") % 3).alias("cell"), F.when(F.col("id") % 17 > 0, (F.col("id") * 37 % 1000) / 10).alias("value"),
    )


def bag(df):
    return sorted(map(str, df.collect()))


def batch_tapes(history, streams=STREAMS):
    parts = []
    for name, s in streams.items():
        tape = R.history_reduce(history, SPEC, s.freq, calendar=s.calendar, digits=2)
        step = isinstance(s.freq, R.Steps)
        win, number = (F.lit(None).cast("timestamp_ntz"), F.col("win")) if step else (F.col("win"), F.lit(None).cast("bigint"))
        parts.append(tape.select("field", F.lit(name).alias("stream"), "member", "cell", number.alias("win_number"), win.alias("win"), "flag", "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run(spark, tmp_path, delay=10**9):
    stream = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    T.follow(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), SPEC, STREAMS, delay, digits=2).awaitTermination()


def stored(spark, tmp_path, **more):
    out = T.stored_tapes(spark, str(tmp_path / "out"), SPEC, STREAMS, more.pop("delay", 10**9), digits=2, **more)
    return out.select("field", "stream", "member", "cell", "win_number", "win", "flag", "value", "n")


def test_stream_goes_on_after_a_stop_and_replays_change_nothing(spark, tmp_path):
    history = samples(spark)
    for number in range(3):
        history.filter(F.col("step") % 3 == number).coalesce(2).write.parquet(str(tmp_path / "in" / str(number)))
        run(spark, tmp_path)
    want = bag(batch_tapes(history))
    assert bag(stored(spark, tmp_path)) == want and len(want) > 300
    # the last batches lose their commits, so they run again under their numbers
    commits = sorted(glob.glob(str(tmp_path / "checkpoint" / "commits" / "[0-9]*")), key=lambda p: int(os.path.basename(p)))
    assert len(commits) == 6
    os.remove(commits[-1])
    os.remove(str(tmp_path / "checkpoint" / "commits" / f".{os.path.basename(commits[-1])}.crc"))
    run(spark, tmp_path)
    assert bag(stored(spark, tmp_path)) == want
    # a batch without its mark is not read; done again it is
    T.add_batch(history.limit(0), 99, str(tmp_path / "out"), SPEC, STREAMS, 10**9, digits=2)
    assert bag(stored(spark, tmp_path)) == want


def test_compaction(spark, tmp_path):
    path, history = str(tmp_path / "out"), samples(spark)
    parts = [history.filter(F.col("step") % 4 == k) for k in range(4)]
    for k in (0, 1):
        T.add_batch(parts[k], k, path, SPEC, STREAMS, 10**9, digits=2)
    T.compact(spark, path)
    T.compact(spark, path)
    for k in (2, 3):
        T.add_batch(parts[k], k, path, SPEC, STREAMS, 10**9, digits=2)
        T.add_batch(parts[k], k, path, SPEC, STREAMS, 10**9, digits=2)
    want = bag(batch_tapes(history))
    assert bag(stored(spark, tmp_path)) == want
    T.compact(spark, path)
    assert bag(stored(spark, tmp_path)) == want


def test_late_samples_and_closed_windows(spark, tmp_path):
    path, history = str(tmp_path / "out"), samples(spark)
    odd = spark.createDataFrame([(0, "T", None, None, 0, 1.0), (None, "T", None, 5, None, None)], HISTORY)
    stop = F.lit("2024-06-01").cast("timestamp_ntz")
    first, late = history.filter((F.col("ts") < stop) & (F.col("step") % 10 != 7)), history.filter((F.col("ts") < "2024-03-01") & (F.col("step") % 10 == 7))
    T.add_batch(first, 0, path, SPEC, STREAMS, 30 * 86_400, digits=2)
    T.add_batch(late.unionByName(odd), 1, path, SPEC, STREAMS, 30 * 86_400, digits=2)
    gone = T.late_samples(spark, path)
    assert bag(gone.select(*history.columns)) == bag(late) and late.count() > 10
    in_time = first.unionByName(odd)
    assert bag(stored(spark, tmp_path, delay=30 * 86_400)) == bag(batch_tapes(in_time))
    assert bag(stored(spark, tmp_path, delay=30 * 86_400, with_late=True)) == bag(batch_tapes(in_time.unionByName(late)))
    closed = {(r.stream, str(r.win)[:10]): r.closed for r in T.stored_tapes(spark, path, SPEC, STREAMS, 30 * 86_400, digits=2).collect()}
    assert closed["month", "2024-02-01"] is True and closed["month", "2024-05-01"] is False
    assert closed["nine", "None"] is None and closed["year", "2024-01-01"] is False


def test_nothing_there_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        T.stored_tapes(spark, str(tmp_path), SPEC, STREAMS, 0)
    T.compact(spark, str(tmp_path))
    T.add_batch(samples(spark, 0), 0, str(tmp_path), SPEC, STREAMS, 0)
    assert T.stored_tapes(spark, str(tmp_path), SPEC, STREAMS, 0).count() == T.late_samples(spark, str(tmp_path)).count() == 0


def test_saved_segments(spark, tmp_path):
    path, history = str(tmp_path), R.select_fields(samples(spark), SPEC)
    cuts = ["2024-01-25", "2024-05-03 04:00:00", "2024-08-01", "2025-12-31"]
    parts = {}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows = history.filter((F.col("ts") >= a) & (F.col("ts") < b))
        parts[f"s{k}"] = (R.partial_reduce(rows, R.Cal("m"), digits=2), a, b)
    assert S.ledger(spark, path).count() == 0
    assert S.save_states(parts["s0"][0], path, "s0", *parts["s0"][1:]) and S.save_states(parts["s2"][0], path, "s2", *parts["s2"][1:])
    hole = S.gaps(spark, path).collect()
    assert [(r.after, r.before, str(r.begin), str(r.end)) for r in hole] == [("s0", "s2", "2024-05-03 04:00:00", "2024-08-01 00:00:00")]
    assert S.save_states(parts["s1"][0], path, "s1", *parts["s1"][1:])
    assert not S.save_states(parts["s1"][0], path, "s1", *parts["s1"][1:])  # saved before
    for name, a, b in (("again", "2024-05-01", "2024-05-02"), ("s1", "2026-01-01", "2026-02-01"), ("back", "2027-02-01", "2027-01-01"), ("no/name", "2027-01-01", "2027-02-01")):
        with pytest.raises(ValueError):
            S.save_states(parts["s0"][0], path, name, a, b)
    assert S.gaps(spark, path).count() == 0
    # what a writer that failed left behind is not read
    parts["s0"][0].write.parquet(f"{path}/states/segment=broken/attempt=1")
    got = R.finalize(S.merged_states(spark, path), SPEC, digits=2)
    assert bag(got) == bag(R.history_reduce(history, SPEC, R.Cal("m"), digits=2))


def test_segments_of_several_runs(spark, tmp_path):
    states = R.partial_reduce(samples(spark, 50), R.Cal("m"), digits=2)
    for run_name in ("control", "warm"):
        assert S.save_states(states, str(tmp_path), f"{run_name}-1", "2024-01-01", "2025-01-01", run=run_name)
    assert S.load_states(spark, str(tmp_path), "warm").count() == states.count()
    assert S.load_states(spark, str(tmp_path)).count() == 2 * states.count()


def test_steps_count_from_the_start(spark):
    """Two steps from the fifth day on: of a run, of members that begin elsewhere, and of one without a number."""
    rows = [(m, "T", day, first + day, 0, 1.0) for m, first in ((0, 0), (1, 100), (None, 7)) for day in range(1, 8)]
    df = spark.createDataFrame([(m, f, s, c, v, d) for m, f, d, s, c, v in rows], "member int, field string, step long, cell long, value double, day int")
    history = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(day - 1)")).drop("day")
    got = R.run_window(history, "2024-01-05", "nsteps", 2)
    assert got.columns == history.columns
    assert sorted((str(r.member), r.step) for r in got.collect()) == [("0", 5), ("0", 6), ("1", 105), ("1", 106), ("None", 12), ("None", 13)]
    whole = R.run_window(history.filter("member = 1").drop("member"), "2024-01-05", "nsteps", 2)
    assert sorted(r.step for r in whole.collect()) == [105, 106]
    assert R.run_window(history, "2030-01-01", "nsteps", 5).count() == 0


def test_a_batch_of_one_file_is_dealt_to_all_tasks(spark, tmp_path):
    """Samples are shuffled before they are copied into the windows, so that one file is not one task's work."""
    samples(spark).coalesce(1).write.parquet(str(tmp_path / "one"))
    states = T.stream_states(spark.read.parquet(str(tmp_path / "one")), SPEC, STREAMS, digits=2)
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan[plan.index("Generate") :]
