"""Streams give what the same tables give in one batch."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fold
from quillgraph.plans import commits, views
from quillgraph.streaming import counters, replay
from quillgraph.streaming import events as stream


def run(query_df, spark, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture()
def folder(spark, sf_dir, tmp_path):
    e = views.table(spark, sf_dir, "events").orderBy("ts")
    path = str(tmp_path / "events")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def test_tumbling_stream_equals_batch(spark, sf_dir, folder):
    schema = spark.read.parquet(folder).schema
    got = run(stream.tumbling(stream.read_stream(spark, folder, schema)), spark, "tumbling", "complete")
    want = stream.tumbling(views.table(spark, sf_dir, "events"))
    norm = lambda df: {(r["start"], r["event_type"]): (r["n"], round(r["total"], 4)) for r in df.collect()}
    assert norm(got) == norm(want)


def counted(df):
    return {r["user_id"]: (r["access_count"], r["last_accessed"], r["helpful_count"], r["harmful_count"]) for r in df.collect()}


def test_access_counts_merge(spark, sf_dir, folder, tmp_path):
    out = str(tmp_path / "counts")
    q = stream.read_stream(spark, folder, spark.read.parquet(folder).schema).writeStream.foreachBatch(counters.counter(spark, out)).trigger(availableNow=True).start()
    q.awaitTermination()
    want = counted(stream.access_counts(views.table(spark, sf_dir, "events")))
    assert counted(counters.read_counts(spark, out)) == want
    some = next(iter(want))
    assert counted(counters.counts_of(spark, out, some)) == {some: want[some]}


def test_counter_runs_follow_the_batches(spark, sf_dir, tmp_path):
    out, e = str(tmp_path / "counts"), views.table(spark, sf_dir, "events").cache()
    write, parts = counters.counter(spark, out, fan=3), [e.where(F.col("event_id") % 10 == k) for k in range(10)]
    assert counters.read_counts(spark, out) is None and counters.counts_of(spark, out, 1) is None
    rows = []
    for k, p in enumerate(parts):
        write(p, k)
        runs = counters._state(spark, out)["runs"]
        rows.append(sum(spark.read.parquet(f"{out}/{r['name']}").count() for r in runs if r["hi"] == k))
        assert len(runs) <= 6
    assert [r["level"] for r in runs] == [2, 0] and runs[0]["lo"] == 0 and runs[0]["hi"] == 8
    assert rows[9] <= parts[9].select("user_id").distinct().count()  # a batch of its own size, after nine others
    want = counted(stream.access_counts(e))
    assert counted(counters.read_counts(spark, out)) == want
    write(parts[9], 9)  # run again after it was counted
    write(parts[3], 3)
    assert counted(counters.read_counts(spark, out)) == want
    write(e.limit(0), 10)
    assert counted(counters.read_counts(spark, out)) == want
    assert {p.name for p in (tmp_path / "counts").iterdir()} == {"log", "run-10", "run-9", "run-0-8-2"}


def test_a_stopped_batch_is_written_again(spark, sf_dir, tmp_path, monkeypatch):
    out, e = str(tmp_path / "counts"), views.table(spark, sf_dir, "events")
    write = counters.counter(spark, out)
    write(e.where("event_id % 2 = 0"), 0)
    real = commits.commit
    monkeypatch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        write(e.where("event_id % 2 = 1"), 1)
    monkeypatch.setattr(commits, "commit", real)
    write(e.where("event_id % 2 = 1"), 1)
    assert counted(counters.read_counts(spark, out)) == counted(stream.access_counts(e))


def points(rows):
    return sorted((r["session_id"], r["turn"], r["before"], r["after"], r["tokens_in"], r["tokens_out"]) for r in rows)


def test_replay_stream_equals_batch_after_a_restart(spark, sf_dir, tmp_path):
    few = [r[0] for r in views.messages(spark, sf_dir).select("session_id").distinct().orderBy("session_id").limit(12).collect()]
    m = views.messages(spark, sf_dir).where(F.col("session_id").isin(few)).cache()
    path, turns = str(tmp_path / "messages"), m.agg(F.max("idx")).first()[0] + 1
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for half in range(2):  # half of each session after the other; the query stops in between and goes on from its checkpoint
            m.where(F.floor(F.col("idx") * 2 / turns) == half).coalesce(1).write.mode("append").parquet(path)
            found = replay.replay_stream(stream.read_stream(spark, path, m.schema), 400, "s9-v3", keep_recent=1, carry=True)
            out = found.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint")
            out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    got = spark.read.schema(replay.OUT).parquet(f"{tmp_path}/rows")
    want = points(fold.replay(m, 400, "s9-v3", keep_recent=1, carry=True).collect())
    assert want and points(got.collect()) == want and got.where("late").isEmpty()


class Kept:
    """A state variable in memory."""

    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def clear(self):
        self.held = []


class KeptList(Kept):
    def get(self):
        return iter(list(self.held))

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows


class KeptValue(Kept):
    def get(self):
        return self.held[0]

    def update(self, row):
        self.held = [row]


class Session:
    """One session's state and clock, around the processor that a stream runs."""

    def __init__(self, **options):
        self.now, self.timers = 1000, set()
        self.processor = replay.Replay(200, "s5", "extractive", options.pop("wait_ms", 0), options.pop("idle_ms", None), 0, {"keep_recent": 1})
        self.getListState, self.getValueState = lambda *a: KeptList(), lambda *a: KeptValue()
        self.processor.init(self)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def arrive(self, *idx):
        import pandas as pd

        rows = pd.DataFrame([(i, "user" if i % 2 == 0 else "assistant", f"Message {i}. More.", 60) for i in idx], columns=["idx", "role", "content", "tokens"])
        return self.rows(self.processor.handleInputRows(("s",), iter([rows]), self))

    def passes(self, ms):
        self.now, out = self.now + ms, []
        for at in [t for t in self.timers if t <= self.now]:
            self.timers.remove(at)
            out += self.rows(self.processor.handleExpiredTimer(("s",), self, None))
        return out

    @staticmethod
    def rows(frames):
        return [r for f in frames for r in f.to_dict("records")]


def folded(*idx):
    rows = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"Message {i}. More.", "tokens": 60} for i in idx]
    return [("s", *p) for p in fold.replay_session(rows, 200, fold.STRATEGIES["s5"], fold.MODELS["extractive"], ([], 0), keep_recent=1)]


def test_late_messages_and_gaps():
    s = Session(wait_ms=500)
    got = s.arrive(1, 0) + s.arrive(3, 4, 5)  # the last three wait behind a gap
    assert got == [] and s.timers == {1500}
    got = s.arrive(2, 1)  # it is filled; the second message comes again
    assert [r["turn"] for r in got if r["late"]] == [1] and not s.timers
    assert points([r for r in got if not r["late"]]) == points_of(folded(*range(6)))
    assert s.arrive(8, 9, 10, 11) == [] and s.passes(499) == []
    got += s.passes(1)  # 6 and 7 don't come in time
    assert points([r for r in got if not r["late"]]) == points_of(folded(*range(6), 8, 9, 10, 11))
    assert [(r["turn"], r["late"]) for r in s.arrive(7)] == [(7, True)]


def points_of(rows):
    return sorted(rows)


def test_without_waiting_gaps_are_passed_over():
    s = Session()
    got = s.arrive(0, 2, 5) + s.arrive(1, 6, 7)
    assert [r["turn"] for r in got if r["late"]] == [1] and not s.timers
    assert points([r for r in got if not r["late"]]) == points_of(folded(0, 2, 5, 6, 7))


def test_the_buffer_is_appended_to_and_idle_sessions_are_forgotten():
    s = Session(idle_ms=100)
    s.arrive(0, 1)
    held = s.processor.buffer.held
    s.arrive(2)
    assert s.processor.buffer.held is held and len(held) == 3 and s.timers == {1100}
    assert s.passes(100) == [] and not s.processor.buffer.exists() and not s.processor.place.exists()
    assert points(s.arrive(0, 1, 2, 3)) == points_of(folded(0, 1, 2, 3))


def test_search_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 0.9, 1, False), (1, 6, 0.5, 2, True)], "query_id long, id long, score double, rank int, near_miss boolean")
    stream.log_searches(rows, str(tmp_path / "log"), "2024-01-01")
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row["top"][0]["id"] == 5 and row["near_misses"][0]["id"] == 6
