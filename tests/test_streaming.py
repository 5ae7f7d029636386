"""Streams over several micro-batches equal their batch twins and survive a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressroom.operators.fetch import schedule_requests
from pressroom.operators.search import advance, next_runs
from pressroom.operators.skew import durable
from pressroom.streaming.batches import advance_stream, discovery_state, schedule_stream
from pressroom.streaming.common import KeyedTable, read_stream, run_available, with_rocksdb, write_available
from pressroom.streaming.counters import fenced_completions, item_outcomes, running_windows, unique_urls, upsert_stream, worker_beats
from pressroom.streaming.state import completed_jobs, expired_on_stream
from test_search import HITS, PAGES, one_run

T0 = dt.datetime(2024, 1, 10, 12, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def files(spark, tmp_path):
    """Writes one Parquet file per call, in order, and reads them as a stream of one file per micro-batch."""
    folder = str(tmp_path / "in")

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return read_stream(spark, folder, "*.parquet", files_per_batch=1)

    return add, stream


def test_beats_and_outcomes_close_with_the_watermark(spark, files):
    add, stream = files
    schema = "worker_id string, heartbeat_at timestamp"
    add([("w1", at(0)), ("w1", at(10)), ("w2", at(40))], schema)
    add([("w1", at(70)), ("w2", at(3000))], schema)
    add([("w1", at(5))], schema)  # far behind the watermark: dropped
    rows = run_available(spark, worker_beats(stream(), late="1 minute"), "beats").collect()
    assert sorted((r.worker_id, r.last_beat) for r in rows) == [("w1", at(10)), ("w1", at(70)), ("w2", at(40))]


def test_outcomes(spark, files):
    add, stream = files
    schema = "status string, error_code string, domain string, started_at timestamp, finished_at timestamp"
    add([("success", None, "a", at(0), at(2)), ("failed", "fetch_failed", "a", at(0), at(5))], schema)
    add([("success", None, "a", at(1), at(4)), ("success", None, "b", at(0), at(90000))], schema)
    rows = run_available(spark, item_outcomes(stream()), "outcomes").collect()
    assert sorted((r.status, r.items, r.latency_micros) for r in rows) == [("failed", 1, 5_000_000), ("success", 2, 5_000_000)]


def test_unique_urls_over_a_restart(spark, files, tmp_path):
    add, stream = files
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    add([("u1",), ("u2",), ("u1",)], "url string")
    write_available(unique_urls(stream()), out, checkpoint)
    add([("u2",), ("u3",)], "url string")
    write_available(unique_urls(stream()), out, checkpoint)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2", "u3"]


def test_unique_urls_within_a_watermark(spark, files):
    add, stream = files
    add([("u1", at(0)), ("u1", at(5))], "url string, seen timestamp")
    add([("u1", at(20)), ("u2", at(30))], "url string, seen timestamp")
    rows = run_available(spark, unique_urls(stream(), time="seen", within="1 minute"), "within").collect()
    assert sorted(r.url for r in rows) == ["u1", "u2"]


def test_jobs_complete_once(spark, files):
    with_rocksdb(spark)
    add, stream = files
    schema = "job_id bigint, position int, status string, total bigint"
    add([(1, 0, "success", 2), (2, 0, "failed", 1), (3, 0, "running", 1), (4, 0, "success", 3)], schema)
    add([(1, 1, "queued", 2), (3, 0, "queued", 1), (4, 0, "success", 3), (4, 0, "success", 3), (4, 1, "failed", 3)], schema)
    add([(1, 1, "failed", 2), (2, 0, "success", 1)], schema)
    add([(4, 1, "failed", 3), (4, 2, "success", 3), (1, 0, "success", 2)], schema)
    rows = run_available(spark, completed_jobs(stream()), "jobs").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 1, 1), (2, 1, 0, 1), (4, 3, 2, 1)]


def test_leases_expire(spark, files):
    with_rocksdb(spark)
    add, stream = files
    schema = "id bigint, kind string, attempts int, event_time timestamp, lease_until timestamp"
    add([(1, "beat", 1, at(0), at(60)), (2, "beat", 3, at(0), at(60)), (3, "beat", 1, at(0), at(60)), (4, "beat", 1, at(0), at(60))], schema)
    add([(3, "beat", 1, at(30), at(3000)), (4, "done", 1, at(40), None)], schema)
    add([(9, "beat", 1, at(1000), at(9000))], schema)
    rows = run_available(spark, expired_on_stream(stream()), "leases").collect()
    assert sorted((r.id, r.attempts, r.status) for r in rows) == [(1, 1, "queued"), (2, 3, "failed")]
    assert {r.expired_at for r in rows} == {at(60)}


def test_stale_late_and_repeated_completions(spark, files):
    add, stream = files
    schema = "id int, owner string, event_time timestamp"
    leases = spark.createDataFrame([(1, "w1"), (2, "w2"), (3, None)], "id int, lease_owner string")
    add([(1, "w1", at(0)), (2, "w1", at(1)), (3, "w1", at(2))], schema)
    add([(1, "w1", at(3)), (2, "w2", at(4))], schema)
    rows = run_available(spark, fenced_completions(stream(), leases), "fence").collect()
    assert sorted((r.id, r.owner) for r in rows) == [(1, "w1"), (2, "w2")]


def test_schedule_continues_over_batches(spark, files, tmp_path):
    rng = random.Random(1)
    add, stream = files
    schema = "id bigint, domain string, arrival bigint, delay bigint"
    rows, clock = [], 0
    for n in range(4):
        part = []
        for _ in range(60):
            clock += rng.randint(0, 9)
            part.append((len(rows) + len(part), rng.choice("aaab"), clock, rng.choice([5, 20])))
        rows += part
        add(part, schema)
    out = schedule_stream(spark, stream(), str(tmp_path / "work"), "domain", "arrival", ["id"], "delay")
    twin = schedule_requests(spark.createDataFrame(rows, schema), "domain", "arrival", ["id"], "delay")
    assert {tuple(r) for r in out.select(twin.columns).collect()} == {tuple(r) for r in twin.collect()}


def test_schedule_goes_on_after_a_restart(spark, files, tmp_path):
    add, stream = files
    schema = "id bigint, domain string, arrival bigint, delay bigint"
    work = str(tmp_path / "work")
    rows = [(i, "a" if i % 3 else "b", 10 * (i // 4), 25) for i in range(40)]
    add(rows[:20], schema)
    schedule_stream(spark, stream(), work, "domain", "arrival", ["id"], "delay")
    add(rows[20:], schema)
    out = schedule_stream(spark, stream(), work, "domain", "arrival", ["id"], "delay")
    twin = schedule_requests(spark.createDataFrame(rows, schema), "domain", "arrival", ["id"], "delay")
    assert {tuple(r) for r in out.select(twin.columns).collect()} == {tuple(r) for r in twin.collect()}
    # one number per domain is all that is carried
    state = spark.read.format("statestore").option("stateVarName", "free").load(f"{work}/checkpoint")
    limits = twin.groupBy("domain").agg(F.max("next_allowed").alias("n"))
    assert {tuple(r) for r in state.selectExpr("key.domain", "value.next_allowed").collect()} == {tuple(r) for r in limits.collect()}


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def run_batches(stream, tmp_path, name):
    """The state's rows after each micro-batch."""
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return state_rows(query)


def test_completed_jobs_are_forgotten(spark, files, tmp_path):
    """The state shrinks once jobs have been quiet for long enough; within that time the result is exact."""
    with_rocksdb(spark)
    add, stream = files
    schema = "job_id bigint, position int, status string, total bigint, at timestamp"
    add([(j, p, "success", 2, at(p)) for j in range(30) for p in range(2)] + [(50, 0, "success", 2, at(0))], schema)
    add([(j, 0, "success", 2, at(30)) for j in range(30)] + [(50, 1, "failed", 2, at(40))], schema)  # delivered again; a job goes on
    add([(100, 0, "failed", 1, at(90_000))], schema)
    rows = run_batches(completed_jobs(stream(), time="at", keep_seconds=60, late="1 second"), tmp_path, "jobs")
    assert max(rows) >= 31 and rows[-1] < 10
    got = spark.read.parquet(str(tmp_path / "jobs")).collect()
    assert sorted(tuple(r) for r in got) == [(j, 2, 2, 0) for j in range(30)] + [(50, 2, 1, 1), (100, 1, 0, 1)]


def outcomes_of_jobs(seed):
    """Micro-batches of outcomes, and the jobs that they complete. An item comes again with another outcome, but not in the same micro-batch, whose rows have no order."""
    rng = random.Random(seed)
    totals = {j: rng.randint(1, 5) for j in [None, *range(400)]}
    batches, known, done = [], {j: {} for j in totals}, {}
    for n in range(3):
        rows, said = [], {}
        for _ in range(1200):
            j = rng.choice([*totals, None])
            position = rng.choice([None, *range(totals[j])]) if totals[j] > 1 else None
            total = said.setdefault(j, None if rng.random() < 0.1 else totals[j] + (j == 7))
            ended = said.setdefault((j, position), rng.choice(["success", "success", "failed"]))
            rows.append((j, position, rng.choice([ended, ended, "queued", None]), total, at(n * 50 + rng.randint(0, 20))))
        batches.append(rows)
        last = {}
        for j, position, status, total, _ in rows:
            if status in ("success", "failed"):
                last[j] = total
                if j not in done:
                    known[j].setdefault(position, status)
        for j, total in last.items():
            if j not in done and total is not None and len(known[j]) >= total:
                failed = [*known[j].values()].count("failed")
                done[j] = (j, len(known[j]), len(known[j]) - failed, failed)
    return batches, done


@pytest.mark.parametrize("time", ["at", None])
def test_jobs_share_rows_of_state(spark, files, tmp_path, time):
    """However many jobs there are, a micro-batch costs as many rows of state as there are buckets (and one for items without a job)."""
    with_rocksdb(spark)
    add, stream = files
    batches, done = outcomes_of_jobs(3)
    for rows in batches:
        add(rows, "job_id bigint, position int, status string, total bigint, at timestamp")
    rows = run_batches(completed_jobs(stream(), time=time, keep_seconds=3600, buckets=8), tmp_path, "shared")
    assert max(rows) == 9
    run_batches(completed_jobs(stream(), time=time, keep_seconds=3600, buckets=None), tmp_path, "apart")
    shared, apart = ([tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()] for name in ("shared", "apart"))
    assert sorted(shared, key=str) == sorted(apart, key=str) == sorted(done.values(), key=str)
    assert len(done) > 100 and None in done


def test_most_jobs_cost_no_state_of_their_own(spark, files, tmp_path):
    with_rocksdb(spark)
    add, stream = files
    add([(j, p, "success", 2, at(p)) for j in range(6000) for p in range(2)], "job_id bigint, position int, status string, total bigint, at timestamp")
    rows = run_batches(completed_jobs(stream(), time="at", keep_seconds=3600), tmp_path, "jobs")
    assert max(rows) < 6000
    assert spark.read.parquet(str(tmp_path / "jobs")).count() == 6000


def test_jobs_with_far_times_and_without(spark, files):
    with_rocksdb(spark)
    add, stream = files
    far = dt.datetime(9999, 12, 31)
    rows = [(1, 0, "success", 2, far), (1, 1, "success", 2, at(0)), (2, 0, "failed", 1, None), (3, 0, "success", 2, far), (3, 1, "success", 2, None)]
    add(rows, "job_id bigint, position int, status string, total bigint, at timestamp")
    got = run_available(spark, completed_jobs(stream(), time="at", keep_seconds=60), "jobs").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 2, 0), (2, 1, 0, 1), (3, 2, 2, 0)]


def test_a_bucket_counts_in_parts_as_at_once(monkeypatch):
    """The rows of a micro-batch are counted some at a time; a job is complete by all of them."""
    import pandas as pd
    from pressroom.streaming import state

    class Kept:
        value, until, exists = None, None, False

        def getCurrentWatermarkMs(self):
            return 1000

        @property
        def getOption(self):
            return self.value

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutTimestamp(self, until):
            self.until = until

        def remove(self):
            self.value, self.exists = None, False

    names = ["job", "position", "blank", "failed", "total", "at_ms", "at"]
    rows = [(5, 0, False, False, 3, 1500, 0), (5, 1, False, True, 3, 1700, 0), (9, 0, False, False, 2, 990, 0), (5, 1, False, False, 3, 1600, 0)]
    rows += [(5, 0, True, False, 3, 1500, 0), (9, 0, False, True, 2, 1200, 0), (2, 4, False, False, 1, 1100, 0), (5, 7, False, False, 3, 1200, 0)]
    frame = pd.DataFrame(rows, columns=names).astype({"at": "datetime64[ns]"})

    def run(frames, kept):
        return [tuple(r) for out in state._job_buckets(100)((3,), iter(frames), kept) for r in out.itertuples(index=False)]

    found = []
    for held in (1, 2, 100):
        monkeypatch.setattr(state, "JOB_ROWS", held)
        kept = Kept()
        found.append((run([frame[n : n + 1] for n in range(len(frame))], kept), kept.until, kept.value))
    assert found[0] == found[1] == found[2]
    assert found[0][:2] == ([(2, 1, 1, 0), (5, 4, 3, 1)], 1200)
    # one more call brings what job 9 waits for; what was delivered before changes nothing
    assert run([frame, frame.assign(position=1)[5:6]], kept) == [(9, 2, 1, 1)]
    assert run([frame[:0]], kept) == [] and kept.exists
    kept.getCurrentWatermarkMs = lambda: 5000
    assert run([frame[:0]], kept) == [] and not kept.exists


def test_unique_urls_are_forgotten(spark, files, tmp_path):
    add, stream = files
    schema = "url string, seen timestamp"
    add([(f"u{i}", at(0)) for i in range(50)], schema)
    add([("late", at(1000))], schema)
    add([("late", at(1002))], schema)
    add([("u1", at(1003))], schema)
    rows = run_batches(unique_urls(stream(), time="seen", within="1 minute"), tmp_path, "urls")
    assert max(rows) >= 50 and rows[-1] <= 3
    got = sorted(r.url for r in spark.read.parquet(str(tmp_path / "urls")).collect())
    assert got == sorted([f"u{i}" for i in range(50)] + ["late", "u1"])  # u1 was forgotten and is new again


def test_open_windows_are_there_too(spark, files, tmp_path):
    add, stream = files
    schema = "worker_id string, heartbeat_at timestamp"
    add([("w1", at(0)), ("w2", at(40))], schema)
    add([("w1", at(20)), ("w1", at(70))], schema)
    work = str(tmp_path / "work")
    running_windows(spark, worker_beats(stream(), late="1 minute"), work, ["window", "worker_id"])
    add([("w1", at(80))], schema)
    rows = running_windows(spark, worker_beats(stream(), late="1 minute"), work, ["window", "worker_id"]).collect()
    assert sorted((r.worker_id, r.last_beat) for r in rows) == [("w1", at(20)), ("w1", at(80)), ("w2", at(40))]


def test_an_upsert_reads_only_the_buckets_it_touches(spark, tmp_path):
    schema = "k bigint, v bigint"
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, buckets=16)
    read = []

    def files_read(df):
        execution = df._jdf.queryExecution()
        execution.toRdd().count()
        scans = execution.executedPlan().collectLeaves()
        metrics = [scans.apply(i).metrics() for i in range(scans.size())]
        return sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))

    def fold(base, new):
        read.append(files_read(base))
        return new.unionByName(base.join(new, "k", "left_anti"))

    def rows(pairs):
        return spark.createDataFrame(pairs, schema)

    table.merge(0, rows([(k, 0) for k in range(200)]), fold)
    files = files_read(table.read())
    table.merge(1, rows([(7, 1)]), fold)
    table.merge(1, rows([(7, 1)]), fold)  # again after its mark: put in place again, nothing merged
    table.merge(2, rows([(7, 2), (900, 2)]), fold)
    assert files == 16 and read == [0, 1, read[2]] and 1 <= read[2] <= 2
    assert {r.k: r.v for r in table.read().collect()} == {k: 0 for k in range(200)} | {7: 2, 900: 2}


def test_upsert_keeps_the_latest(spark, files, tmp_path):
    add, stream = files
    schema = "worker_id string, heartbeat_at timestamp"
    work = str(tmp_path / "work")
    add([("w1", at(5)), ("w2", at(1))], schema)
    add([("w1", at(3))], schema)
    first = upsert_stream(spark, stream(), work, ["worker_id"], ["heartbeat_at"], schema)
    assert sorted((r.worker_id, r.heartbeat_at) for r in first.collect()) == [("w1", at(5)), ("w2", at(1))]
    add([("w2", at(9)), ("w3", at(2))], schema)
    after = upsert_stream(spark, stream(), work, ["worker_id"], ["heartbeat_at"], schema)
    assert sorted((r.worker_id, r.heartbeat_at) for r in after.collect()) == [("w1", at(5)), ("w2", at(9)), ("w3", at(2))]


def test_discovery_resumes_and_answers_twice_alike(spark, files, tmp_path):
    add, stream = files
    pages = spark.createDataFrame([("s", 0, 0, True, None, None), ("s", 0, 10, False, None, None), ("s", 1, 0, False, None, None)], PAGES)
    urls = [("s", 0, 0, n, f"u{n}") for n in range(3)] + [("s", 0, 10, 0, "u1"), ("s", 0, 10, 1, "u9"), ("s", 1, 0, 0, "u0"), ("s", 1, 0, 1, "u10")]
    hits = spark.createDataFrame(urls, HITS)
    runs = one_run(spark, max_articles=2, max_pages=1).drop("command_id")
    seen = spark.createDataFrame([], "search_id string, url string")
    for command in ("c1", "c1", "c2", "c3", "c4", "c5"):
        add([("s", command)], "search_id string, command_id string")
    out = advance_stream(spark, stream(), runs, pages, hits, seen, str(tmp_path / "work"))
    rows = sorted((r.command_id, r.position, r.url) for r in out.collect())
    assert rows == [("c1", 0, "u0"), ("c1", 1, "u1"), ("c2", 0, "u2"), ("c2", 1, "u9"), ("c3", 0, "u10")]
    assert out.select("job_id").distinct().count() == 3
    # the state that the stream carries is that of the batch operator, command by command
    state, known = runs, seen
    for command in ("c1", "c2", "c3", "c4"):
        moved = durable(advance(state.withColumn("command_id", F.lit(command)), pages, hits, known))
        new = moved.filter("error_code IS NULL AND NOT replayed").select("search_id", F.explode("new_seen").alias("url"))
        state, known = durable(next_runs(state, moved)), durable(known.unionByName(new))
    work = str(tmp_path / "work")
    twin = state.first()
    run = discovery_state(spark, work, "run").first()
    for name in ("month", "offset", "pages", "skipped", "requests_attempted", "status"):
        assert run[name] == twin[name], name
    assert sorted(r.url for r in discovery_state(spark, work, "seen").collect()) == sorted(r.url for r in known.collect())
    for name in ("job_ids", "warnings", "pending", "fingerprints"):
        assert [r.value for r in discovery_state(spark, work, name).collect()] == twin[name], name


def test_every_command_of_a_micro_batch_is_carried_out(spark, small, tmp_path):
    from pressroom.plans.search_queries import search_tables
    from pressroom.streaming.batches import advance_stream

    runs, pages, hits, seen = search_tables(spark, small)
    schema = "search_id string, command_id string"

    def run(batches, name):
        source = tmp_path / name
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = advance_stream(spark, stream, runs, pages, hits, seen, str(tmp_path / f"{name}-out"))
        return sorted((r.search_id, r.command_id, r.position, r.url) for r in out.collect())

    ids = [str(r.c_custkey) for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").limit(20).collect()]
    first, second = [(i, "a") for i in ids], [(i, "b") for i in ids]
    together, apart = run([first + second], "together"), run([first, second], "apart")
    assert together == apart
    assert {c for _, c, _, _ in together} == {"a", "b"}


def test_a_job_that_completes_at_once_stores_no_position():
    """Positions go to the state store only for a job that a call does not complete."""
    from pyspark.sql import Row
    from pressroom.streaming.state import _JobCompletion

    class Value:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

    class Map(dict):
        calls = 0

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    job = _JobCompletion(None)
    rows = [Row(position=p, status="success", total=3) for p in (0, 1, 1, 2)]
    job.counts, job.ended = Value(), Map()
    assert [r.completed for r in job.handleInputRows((1,), iter(rows), None)] == [3] and job.ended.calls == 0
    assert list(job.handleInputRows((1,), iter(rows), None)) == []
    job.HELD = 2
    job.counts, job.ended = Value(), Map()
    assert list(job.handleInputRows((2,), iter(rows[:3]), None)) == [] and set(job.ended) == {(0,), (1,)}
    assert [r.completed for r in job.handleInputRows((2,), iter(rows), None)] == [3] and not job.ended


def test_discovery_reads_and_writes_a_search_once():
    """A micro-batch costs a search one read and one write of the state store, however many URLs it finds; a search that was just begun is not read again."""
    import json

    from pyspark.sql import Row
    from pressroom.streaming.state import _Discovery

    class Map(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def containsKey(self, key):
            self.calls += 1
            return key in self

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    def page(month, offset, urls, has_next):
        return {"month": month, "offset": offset, "has_next": has_next, "hits": len(urls), "urls": urls}

    pages = [page(0, 0, [f"u{n}" for n in range(10)], True), page(0, 10, [f"u{n}" for n in range(5, 15)], False), page(1, 0, ["u1", "u3", "u20"], False)]
    state = {
        "month": 0, "offset": 0, "pages": 0, "skipped": 0, "requests_attempted": 0, "status": "ready", "answered": False, "windows": ["2024-04", "2024-05"],
        "max_articles": 12, "max_pages": 1, "pending": [], "fingerprints": [], "job_ids": [], "warnings": [], "seen": ["u1"], "more_seen": False,
    }
    begin = Row(searches=[{"search_id": "s", "state": json.dumps(state), "aside": []}, {"search_id": "t", "state": None, "aside": ["u1"]}])

    def run(held):
        search = _Discovery(held)
        search.searches, search.seen = Map(), Map()
        search.handleInitialState((3,), begin, None)
        found = []
        for command in ("c1", "c2", "c3", "c3", "c4"):
            before = search.searches.calls
            asked = [Row(search_id=s, command_id=command, book=json.dumps(pages)) for s in ("s", "t")]
            found += [(r.search_id, r.command_id, r.position, r.url) for r in search.handleInputRows((3,), iter(asked), None)]
            assert search.searches.calls - before <= 3
        return found, search

    found, search = run(1000)
    urls = [f"u{n}" for n in (0, *range(2, 15), 20)]
    assert [u for _, _, _, u in found] == urls and {s for s, _, _, _ in found} == {"s"}
    assert search.seen.calls == 1  # that of the search without a run
    kept = json.loads(search.searches[("s",)][0])
    assert sorted(kept["seen"]) == sorted(["u1", *urls]) and kept["status"] == "discovery_complete"
    # seen URLs that no longer fit the row of their search are known all the same
    again, moved = run(2)
    assert again == found
    assert {u for s, u in moved.seen if s == "s"} | set(json.loads(moved.searches[("s",)][0])["seen"]) == {"u1", *urls}
