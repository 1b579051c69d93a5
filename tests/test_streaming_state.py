"""Rankings and signs of life of a stream equal those of all its rows, however they are split."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.operators import concepts as C
from siltstone.streaming import heartbeat
from siltstone.streaming.rankings import Rankings

SCHEMA = "paper string, concept string, relevance double"


def ranking_rows(n=300):
    r = random.Random(8)
    rows = [(r.choice(["p1", "p2", "p3", f"p{i}", None]), r.choice(["a", "a", "b", "c", f"c{i % 20}", None]), r.choice([None, 0.1, 0.2, 1e-9, -0.3, round(r.random(), 4)])) for i in range(n)]
    return rows + rows[:20]


def expected(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where("concept IS NOT NULL")
    papers = {r.concept: r.doc_frequency for r in C.paper_frequency(df).collect()}
    return [(r.concept, r.doc_frequency, pytest.approx(r.avg_relevance, abs=1e-9) if r.avg_relevance is not None else None, papers.get(r.concept, 0)) for r in C.rankings(df).collect()]


@pytest.mark.parametrize("cuts", [[], [100], [0, 1, 7, 7, 250]])
def test_any_split_gives_the_batch_ranking(spark, tmp_path, cuts):
    rows, kept = ranking_rows(), Rankings(str(tmp_path))
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        kept.update(spark.createDataFrame(rows[a:b], SCHEMA), i)
    want = {r[0]: r for r in expected(spark, rows)}
    got = [tuple(r) for r in kept.table(spark).collect()]
    assert {r[0]: r for r in got} == want and len(got) == len(want)
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)
    exact = {r[0]: r[2] for r in got}
    kept.update(spark.createDataFrame(rows[-5:], SCHEMA), len(cuts))  # the last batch again, with other rows: it is replaced
    again = {r.concept: r.doc_frequency for r in kept.table(spark).collect()}
    assert sum(again.values()) <= sum(r[1] for r in got) and exact


def test_a_stream_that_breaks_and_goes_on(spark, tmp_path):
    rows = ranking_rows()
    (tmp_path / "in").mkdir()
    put = lambda name, some: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("paper", "concept", "relevance"), r))) for r in some))
    for i in range(3):
        put(f"{i}.json", rows[i * 50 : i * 50 + 50])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    kept = Rankings(str(tmp_path / "kept"))

    class Breaking(Rankings):
        def update(self, df, batch):
            super().update(df, batch)
            if batch == 1:
                raise RuntimeError("after the work, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        Breaking(str(tmp_path / "kept")).follow(stream, str(tmp_path / "check")).start().awaitTermination()
    put("3.json", rows[150:])
    kept.follow(stream, str(tmp_path / "check")).start().awaitTermination()
    assert sorted((tuple(r) for r in kept.table(spark).collect()), key=lambda r: r[0]) == sorted(expected(spark, rows), key=lambda r: r[0])
    assert Rankings(str(tmp_path / "none")).table(spark).count() == 0


START = datetime(2026, 3, 4, tzinfo=timezone.utc)


def run_events(n=60):
    """Runs with ends and without, silences, equal times, events after an end; as (run, seconds, kind)."""
    r = random.Random(9)
    out = []
    for i in range(n):
        at = r.randrange(0, 2000)
        for _ in range(r.randrange(1, 9)):
            at += r.choice([0, 1, 5, 29, 30, 31, 100, 400, 700])
            out.append((f"run{i % 25}", at, r.choice(["progress", "progress", "start", "done", "error", None])))
    return out


def by_steps(events, every, silence):
    """Messages by walking through each run's events in order of time."""
    out = []
    runs = {}
    for run, at, kind in events:
        runs.setdefault(run, []).append((at, kind in heartbeat.ENDS))
    for run, rows in runs.items():
        start = last = None
        for at, end in [*sorted(rows), (10**9, True)]:
            if start is not None:
                stop = min(at, last + silence)
                out += [(run, start, t) for t in range(start + every, stop, every)]
                if last + silence <= at:
                    start = None
            if start is None:
                start = at
            last = at
            if end:
                start = None
    return sorted(set(out))


def shown(rows):
    s = lambda t: int((t.replace(tzinfo=t.tzinfo or timezone.utc) - START).total_seconds())
    got = sorted((r.run, s(r.start), s(r.at)) for r in rows)
    for r in rows:
        n = s(r.at) - s(r.start)
        assert r.message == "still running after " + (f"{n // 60}m {n % 60:02d}s" if n >= 60 else f"{n}s")
    return got


def frame(spark, events):
    base = int(START.timestamp())
    df = spark.createDataFrame([(r, base + at, k) for r, at, k in events], "run string, s long, kind string")
    return df.select("run", F.timestamp_seconds("s").alias("at"), "kind")


def test_messages_of_a_table(spark):
    events = run_events()
    got = shown(heartbeat.beats(frame(spark, events + [("x", 5, "start")]).unionByName(spark.sql("SELECT CAST(NULL AS STRING) run, CAST(NULL AS TIMESTAMP) at, 'start' kind")), 30, 600).collect())
    assert got == by_steps(events + [("x", 5, "start")], 30, 600) and len(got) > 100
    assert heartbeat.beats(frame(spark, []), 30).count() == 0


def test_advance_in_any_steps():
    """One run's messages do not depend on when the watermark moves, and nothing is left at the end."""
    r = random.Random(10)
    for _ in range(200):
        events = [("r", r.randrange(0, 900), r.choice(["done", "go", "go"])) for _ in range(r.randrange(1, 8))]
        state, out, now = (-1, -1, -1, [], []), [], 0
        left = sorted(events, key=lambda e: (e[1] + r.randrange(0, 60), e[1]))  # at most a minute late
        while left or state:
            state = state or (-1, -1, -1, [], [])
            some, left = left[:2], left[2:]
            state = (*state[:3], state[3] + [e[1] for e in some], state[4] + [e[2] == "done" for e in some])
            now = max(now, min([e[1] for e in left], default=10**6) - 1 if r.random() > 0.3 or not left else now)
            state, new, due = heartbeat.advance(state, now, 30, 200)
            out += new
            assert state is None or due > now
        assert sorted(("r", *m) for m in out) == by_steps(events, 30, 200)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_table_and_state_goes(spark, tmp_path, files):
    events = sorted(run_events(), key=lambda e: e[1])
    r = random.Random(files)
    events = sorted(events, key=lambda e: e[1] + r.randrange(0, 50))  # out of order by less than the watermark's minute
    src, step = tmp_path / "in", -(-len(events) // files)
    for i in range(0, len(events), step):
        frame(spark, events[i : i + step]).coalesce(1).write.mode("append").json(str(src))
    frame(spark, [("zzz", 100_000, "done")]).coalesce(1).write.mode("append").json(str(src))  # time goes on
    frame(spark, [("zzz", 200_000, "done")]).coalesce(1).write.mode("append").json(str(src))
    names = sorted((p for p in src.iterdir() if p.name.startswith("part")), key=lambda p: p.stat().st_mtime_ns)
    (tmp_path / "fed").mkdir()
    stream = spark.readStream.schema("run string, at timestamp, kind string").json(str(tmp_path / "fed"))
    query = None
    for i, p in enumerate(names):  # one file a run of the stream, which resumes from its checkpoint
        p.rename(tmp_path / "fed" / f"{i}.json")
        query = heartbeat.heartbeats(stream, 30, 600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = shown([x for x in spark.read.parquet(str(tmp_path / "out")).collect() if x.run != "zzz"])
    assert got == by_steps(events, 30, 600)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_fractions_of_milliseconds_as_in_sql(spark, tmp_path):
    """Events at the last microseconds of a second, or before 1970, begin runs in the second that the SQL names."""
    from siltstone import queries as Q

    base = [datetime(2024, 1, 3, 0, 58, 7, us) for us in (999_499, 999_500, 999_999, 0)] + [datetime(1969, 12, 31, 23, 59, 58, us) for us in (400, 500, 999_500, 999_600)]
    rows = [(i, t, i, "view") for i, t in enumerate(base)] + [(100 + i, t + timedelta(hours=13, microseconds=1), i, "purchase") for i, t in enumerate(base)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(c.execute(Q.oracle_sql()["run_heartbeats"]).fetchall())
    got = sorted(tuple(r) for r in Q.queries()["run_heartbeats"](spark, str(tmp_path)).collect())
    assert got == want and ("1", "2024-01-03 00:58:08", "still running after 360m 00s") in got
