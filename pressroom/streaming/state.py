"""Keyed state on streams: job completion, lease expiry, politeness and discovery.

Each processor keeps a few numbers per key, or what is known of some jobs or searches, and reads its rows one after the other or, for jobs and politeness, as arrays.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from ..operators.jobs import MAX_ATTEMPTS
from ..operators.search import PAGE_SIZE, REPEATED_PAGE, search_limits


# a job whose items have been quiet for a week is forgotten
JOB_SECONDS = 7 * 24 * 3600
# jobs share a key of the stream by the hash of their id; a checkpoint keeps the number that it began with
JOB_BUCKETS = 2048
# so many rows of a bucket are counted together, or a quarter of the positions known of it
JOB_ROWS = 200_000
# pandas has no later times; only a watermark that is past it is held back
LAST_TIME = dt.datetime(2262, 1, 1)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


COMPLETED = _struct(job_id=LongType(), completed=LongType(), succeeded=LongType(), failed=LongType())


class _JobCompletion(StatefulProcessor):
    """State: the counts of a job, and the positions that have ended until all have. A timer ends both when the job was quiet for long enough.

    Every call of the state store is a round trip, so the positions of a call are held until it is over, ``HELD`` at most, and those of a job that it
    completes are never stored.
    """

    HELD = 10_000

    def __init__(self, keep_ms: int | None) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", _struct(succeeded=LongType(), failed=LongType(), done=LongType(), ends_ms=LongType()))
        self.ended = handle.getMapState("ended", _struct(position=LongType()), _struct(one=LongType()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.counts.get()
        succeeded, failed, done, ends = known or (0, 0, 0, 0)
        before, total = ends, None
        stored = succeeded + failed > 0 and not done
        held: set[int] = set()
        for row in rows:
            total = row.total
            if self.keep:
                ends = max(ends, int(row.at.timestamp() * 1000) + self.keep)
            if done or row.position in held or (stored and self.ended.containsKey((row.position,))):
                continue  # delivered before
            held.add(row.position)
            if len(held) >= self.HELD:
                self._store(held)
                stored = True
            succeeded += row.status == "success"
            failed += row.status == "failed"
        finished = not done and total is not None and succeeded + failed >= total
        if known != (state := (succeeded, failed, int(bool(done) or finished), ends)):
            self.counts.update(state)
        if not finished:
            self._store(held)
        if ends != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ends)
        if finished:
            if stored:
                self.ended.clear()
            yield Row(job_id=key[0], completed=succeeded + failed, succeeded=succeeded, failed=failed)

    def _store(self, positions: set[int]) -> None:
        for position in positions:
            self.ended.updateValue((position,), (1,))
        positions.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done = (self.counts.get() or (0, 0, 0, 0))[2]
        self.counts.clear()
        if not done:
            self.ended.clear()
        return iter(())

    def close(self) -> None:
        pass


JOBS = _struct(jobs=BinaryType(), ended=BinaryType())
_JOB = np.dtype([("job", np.int64), ("succeeded", np.int64), ("failed", np.int64), ("ends", np.int64), ("total", np.int64), ("done", np.bool_)])
_ITEM = np.dtype([("job", np.int64), ("position", np.int64), ("blank", np.bool_)])
# the total of a job that no row of the call names: it can't complete
_UNKNOWN = 2**63 - 1


class _Jobs:
    """What is known of the jobs of a bucket: their counts, by job, and the positions that have ended of those that are not done. Two arrays, stored as their bytes."""

    def __init__(self, known: tuple[bytes, bytes] | None) -> None:
        jobs, ended = known or (b"", b"")
        self.jobs, self.ended = np.frombuffer(jobs, _JOB).copy(), np.frombuffer(ended, _ITEM)
        self.jobs["total"] = _UNKNOWN

    def stored(self) -> tuple[bytes, bytes]:
        return self.jobs.tobytes(), self.ended.tobytes()

    def add(self, rows: dict[str, np.ndarray], ends: np.ndarray | None) -> None:
        """Count rows in their order; ``ends`` is when each lets its job be forgotten."""
        ids, at = np.unique(rows["job"], return_inverse=True)
        new = np.zeros(len(ids), _JOB)
        new["job"] = ids
        jobs = np.concatenate([self.jobs, new[~np.isin(ids, self.jobs["job"], assume_unique=True)]])
        self.jobs = jobs = jobs[np.argsort(jobs["job"])]
        at = np.searchsorted(jobs["job"], ids)[at]
        jobs["total"][at] = rows["total"]  # of a job's rows the last one counts
        if ends is not None:
            np.maximum.at(jobs["ends"], at, ends)
        going = np.flatnonzero(~jobs["done"][at])
        items = np.empty(len(going), _ITEM)
        for name in _ITEM.names:
            items[name] = rows[name][going]
        # a stable sort: what is known comes first, then the rows as they came
        known, items = len(self.ended), np.concatenate([self.ended, items])
        order = np.lexsort((items["blank"], items["position"], items["job"]))
        items = items[order]
        first = np.ones(len(items), np.bool_)
        first[1:] = items[1:] != items[:-1]
        self.ended, order = items[first], order[first]
        fresh = going[order[order >= known] - known]
        failed = rows["failed"][fresh]
        np.add.at(jobs["failed"], at[fresh[failed]], 1)
        np.add.at(jobs["succeeded"], at[fresh[~failed]], 1)

    def finish(self) -> np.ndarray:
        """The jobs that are complete now. Of their positions nothing is kept."""
        now = ~self.jobs["done"] & (self.jobs["succeeded"] + self.jobs["failed"] >= self.jobs["total"])
        self.jobs["done"] |= now
        self.ended = self.ended[~self._of("done", self.ended["job"])]
        return self.jobs[now]

    def forget(self, watermark: int) -> None:
        kept = self.jobs["ends"] >= watermark
        if not kept.all():
            self.ended = self.ended[self._of("ends", self.ended["job"]) >= watermark]
            self.jobs = self.jobs[kept]

    def _of(self, name: str, jobs: np.ndarray) -> np.ndarray:
        return self.jobs[name][np.searchsorted(self.jobs["job"], jobs)]


def _job_buckets(keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """:class:`_JobCompletion` for all jobs of a bucket at once, their state in one row."""

    def complete(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = _Jobs(state.getOption)
        watermark = max(state.getCurrentWatermarkMs(), 0) if keep_ms else 0

        def add(frames: list[pd.DataFrame]) -> None:
            rows = {name: np.concatenate([frame[name].to_numpy() for frame in frames]) for name in frames[0].columns}
            # a row without a time counts as heard of now
            jobs.add(rows, np.where(np.isnat(rows["at"]), watermark, rows["at_ms"]) + keep_ms if keep_ms else None)

        waiting, n = [], 0
        for frame in frames:
            waiting.append(frame)
            n += len(frame)
            if n >= max(JOB_ROWS, len(jobs.ended) // 4):
                add(waiting)
                waiting, n = [], 0
        if n:
            add(waiting)
        finished = jobs.finish()
        if keep_ms:
            jobs.forget(watermark)
        if len(jobs.jobs):
            state.update(jobs.stored())
            if keep_ms:
                state.setTimeoutTimestamp(int(jobs.jobs["ends"].min()))
        elif state.exists:
            state.remove()
        if len(finished):
            ids = pd.Series(finished["job"] if key[0] >= 0 else [None] * len(finished), dtype="Int64")
            succeeded, failed = finished["succeeded"], finished["failed"]
            yield pd.DataFrame({"job_id": ids, "completed": succeeded + failed, "succeeded": succeeded, "failed": failed})

    return complete


def completed_jobs(
    outcomes: DataFrame, time: str | None = None, keep_seconds: int = JOB_SECONDS, late: str = "10 minutes", buckets: int | None = JOB_BUCKETS
) -> DataFrame:
    """Emit a job once, when as many of its items have ended as it has (columns job_id, position, status, total).

    Items that are queued again or still running do not count. An item that is delivered again does not count again; its
    first outcome stays. A job's positions are kept only until it completes. With the event time of an outcome in the column ``time``, what is known of a job is
    forgotten once the watermark (``late`` behind) is ``keep_seconds`` past its last outcome: the state holds the jobs of that time and not all there
    ever were, and the result is exact as long as outcomes of a job, redelivered ones too, follow each other within it. Without ``time`` everything is kept.

    Jobs share ``buckets`` rows of state, of which a micro-batch reads and writes those that it touches. With ``buckets=None`` a job has entries of its own, at several
    calls of the state store each: for micro-batches that touch few of very many jobs.
    """
    ended = outcomes.filter("status IN ('success', 'failed')")
    position = F.col("position").cast("long")
    if buckets is None:
        kept = ["job_id", position.alias("position"), "status", "total"]
        if time is None:
            return ended.select(*kept).groupBy("job_id").transformWithState(_JobCompletion(None), COMPLETED, "Append", "None")
        marked = ended.select(*kept, F.col(time).alias("at")).withWatermark("at", late)
        return marked.groupBy("job_id").transformWithState(_JobCompletion(keep_seconds * 1000), COMPLETED, "Append", "EventTime")
    # the arrays have no nulls: rows without a job have a bucket of their own, a position that is missing is one more of its job
    job, total, zero = F.col("job_id").cast("long"), F.col("total").cast("long"), F.lit(0).cast("long")
    bucket = F.when(job.isNull(), -1).otherwise(F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int"))
    kept = [
        bucket.alias("bucket"), F.coalesce(job, zero).alias("job"), F.coalesce(position, zero).alias("position"), position.isNull().alias("blank"),
        (F.col("status") == "failed").alias("failed"), F.coalesce(total, F.lit(_UNKNOWN)).alias("total"),
    ]
    if time is None:
        return ended.select(*kept).groupBy("bucket").applyInPandasWithState(_job_buckets(0), COMPLETED, JOBS, "append", GroupStateTimeout.NoTimeout)
    at, last = F.col(time), F.lit(LAST_TIME)
    near = F.when(at > last, last).otherwise(at).alias("at")
    marked = ended.select(*kept, F.coalesce(F.unix_millis(at), zero).alias("at_ms"), near).withWatermark("at", late)
    complete = _job_buckets(int(keep_seconds * 1000))
    return marked.groupBy("bucket").applyInPandasWithState(complete, COMPLETED, JOBS, "append", GroupStateTimeout.EventTimeTimeout)


LEASE_EVENT = _struct(id=LongType(), attempts=IntegerType(), status=StringType(), expired_at=TimestampType())


class _LeaseExpiry(StatefulProcessor):
    """State: attempts and lease end of the item in hand. A timer at the lease end decides what happens to it."""

    def __init__(self, max_attempts: int) -> None:
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", _struct(attempts=IntegerType(), until_ms=LongType(), seen_ms=LongType()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        current = self.lease.get() if self.lease.exists() else None
        before = current[1] if current else None
        for row in rows:
            at = int(row.event_time.timestamp() * 1000)
            if current is not None and at < current[2]:
                continue  # older than what is known
            if row.kind == "done":
                current = (row.attempts, 0, at)
            else:
                current = (row.attempts, int(row.lease_until.timestamp() * 1000), at)
        if current is None:
            return iter(())
        if before:
            self.handle.deleteTimer(before)
        if current[1]:
            self.handle.registerTimer(current[1])
        self.lease.update(current)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.lease.exists():
            attempts, until, _ = self.lease.get()
            if until == end:
                self.lease.clear()
                status = "queued" if attempts < self.max_attempts else "failed"
                yield Row(id=key[0], attempts=attempts, status=status, expired_at=dt.datetime.fromtimestamp(end / 1000))

    def close(self) -> None:
        pass


def expired_on_stream(events: DataFrame, late: str = "1 minute", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Leases that end without a further heartbeat: the item is queued again, or fails when its attempts are used up.

    ``events`` is (id, kind, attempts, event_time, lease_until): ``beat`` extends the lease, ``done`` ends it. A lease is
    decided once the watermark passes its end.
    """
    marked = events.withWatermark("event_time", late)
    return marked.groupBy("id").transformWithState(_LeaseExpiry(max_attempts), LEASE_EVENT, "Append", "EventTime")


class _Politeness(StatefulProcessor):
    """State: when the domain is free again."""

    def __init__(self, arrival: str, tie: Sequence[str], delay: str, columns: Sequence[str]) -> None:
        self.order, self.arrival, self.delay, self.columns = [arrival, *tie], arrival, delay, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", _struct(next_allowed=LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        arrival, delay = (batch[c].to_numpy(np.int64) for c in (self.arrival, self.delay))
        busy = np.cumsum(delay) - delay
        start = np.maximum.accumulate(arrival - busy)
        if self.free.exists():
            start = np.maximum(start, self.free.get()[0])
        start = start + busy
        # a request starts no earlier than the one before ends, so the last one ends last
        self.free.update((int(start[-1] + delay[-1]),))
        yield batch[self.columns].assign(start_at=start, next_allowed=start + delay)

    def close(self) -> None:
        pass


def scheduled_on_stream(requests: DataFrame, domain: str, arrival: str, tie: Sequence[str], delay: str) -> DataFrame:
    """Politeness on a live URL stream: adds ``start_at`` and ``next_allowed``, microseconds as in the batch twin.

    The rows of a micro-batch are taken in order of (arrival, tie), and each continues where its domain's last one ended. The state is one number per domain. A domain's rows of one
    micro-batch meet in one task, as one running sum and maximum; ``maxFilesPerTrigger`` bounds them.
    """
    added = [StructField(c, LongType()) for c in ("start_at", "next_allowed")]
    schema = StructType([*requests.schema.fields, *added])
    return requests.groupBy(domain).transformWithStateInPandas(_Politeness(arrival, tie, delay, requests.columns), schema, "Append", "None")


ITEMS = "search_id string, command_id string, job_id string, position int, url string"
RUN_STATE = "month int, offset int, pages int, skipped int, requests_attempted int, status string, last_command_id string, answered boolean"
LISTS_STATE = "pending array<string>, fingerprints array<string>, job_ids array<string>, warnings array<string>"
SEARCH_STATE = f"{RUN_STATE}, windows array<string>, max_articles int, max_pages int, {LISTS_STATE}, seen array<string>, more_seen boolean"

# searches share a key of the stream by the hash of their id, and a row of the start state holds some of them; a checkpoint keeps the number that it began with
SEARCH_BUCKETS = 4096
SEARCH_SLICE = 100
# so many seen URLs are kept in the row of a search
HELD = 1_000


class _Discovery(StatefulProcessor):
    """State of a search, one row: its place and counters, the URLs that wait, the URLs it has seen, the prints of the month's pages, its jobs and warnings.

    Every call of the state store is a round trip, every key of the stream an Arrow batch of its own, and every field of a stored row is parsed again with its type. So
    searches share keys, a search is one text (JSON, :data:`SEARCH_STATE`), and its commands of a micro-batch cost one read and one write of it. The URLs seen stay
    in it up to ``HELD``; beyond that they move to entries of their own, where only those of a page are looked up. A bucket's commands of one micro-batch are
    held with their pages, since they are carried out in order of command_id per search.
    """

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.begun: tuple = (None, {})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.searches = handle.getMapState("searches", "search_id string", "state string")
        self.seen = handle.getMapState("seen", "search_id string, url string", "one int")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if self.begun[0] != key:
            self.begun = (key, {})
        for search in initialState.searches:
            for url in search["aside"]:
                self.seen.updateValue((search["search_id"], url), (1,))
            if search["state"] is not None:
                self.searches.updateValue((search["search_id"],), (search["state"],))
                self.begun[1][search["search_id"]] = search["state"]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # what was stored for this key a moment ago need not be read again
        begun = self.begun[1] if self.begun[0] == key else {}
        self.begun = (None, {})
        asked: dict[str, dict[str, str]] = {}
        for row in rows:
            asked.setdefault(row.search_id, {})[row.command_id] = row.book
        for search, commands in asked.items():
            known = begun.get(search) or (self.searches.getValue((search,)) or (None,))[0]
            if known is None:
                continue
            state, moved = json.loads(known), False
            for command in sorted(commands):
                book = {(p.get("month"), p.get("offset")): p for p in json.loads(commands[command] or "[]")}
                batch = self._carry_out(search, command, book, state)
                if batch is None:
                    continue
                moved = True
                for position, url in enumerate(batch):
                    yield Row(search_id=search, command_id=command, job_id=state["job_ids"][-1], position=position, url=url)
            if moved:
                self._store(search, state)

    def _store(self, search: str, state: dict) -> None:
        if len(state["seen"]) > self.held:
            for url in state["seen"]:
                self.seen.updateValue((search, url), (1,))
            state.update(seen=[], more_seen=True)
        self.searches.updateValue((search,), (json.dumps(state, ensure_ascii=False),))

    def _carry_out(self, search: str, command: str, book: dict, state: dict) -> list[str] | None:
        """The URLs of the job that a command emits, ``state`` moved on; None where the command leaves the search as it is."""
        month, offset, windows, max_articles = (state[name] for name in ("month", "offset", "windows", "max_articles"))
        if state["status"] in ("discovery_complete", "failed") or (state["answered"] and state.get("last_command_id") == command):
            return None
        waiting, prints, seen = state["pending"], state["fingerprints"], set(state["seen"])
        kept: dict[str, None] = {}
        unused: dict[str, None] = {}

        def fresh(url: str) -> bool:
            known = url in seen or url in kept or url in unused
            return not known and not (state["more_seen"] and self.seen.containsKey((search, url)))

        repeats, read, hits = [], 0, 0
        while month < len(windows) and read < state["max_pages"] and len(waiting) + len(kept) < max_articles:
            page = book.get((month, offset))
            if page is None or page.get("error_code") is not None:
                return None  # not captured, or failed: the search stays where it was
            found = dict.fromkeys(u for u in page["urls"] if fresh(u))
            mark = hashlib.sha256("\n".join(found).encode()).hexdigest()
            again = mark in prints
            (unused if again else kept).update(found)
            if again:
                repeats.append(f"{windows[month]}: {REPEATED_PAGE}")
            read, hits = read + 1, hits + page["hits"]
            if again or not page["has_next"]:
                month, offset, prints = month + 1, 0, []
            else:
                offset, prints = offset + PAGE_SIZE, [*prints, mark]
        urls = [*waiting, *kept]
        batch, rest = urls[:max_articles], urls[max_articles:]
        complete = month >= len(windows) and not rest
        job = [hashlib.md5(f"{search}|{command}".encode()).hexdigest()] if batch else []
        state.update(
            month=month, offset=offset, pages=state["pages"] + read, skipped=state["skipped"] + hits - len(kept) - len(unused),
            requests_attempted=state["requests_attempted"] + read, status="discovery_complete" if complete else "ready", last_command_id=command,
            answered=True, pending=rest, fingerprints=prints, job_ids=[*state["job_ids"], *job], warnings=[*state["warnings"], *repeats],
            seen=[*state["seen"], *kept, *unused],
        )
        return batch

    def close(self) -> None:
        pass


def discovered_on_stream(
    commands: DataFrame, runs: DataFrame, books: DataFrame, seen: DataFrame, buckets: int = SEARCH_BUCKETS, held: int = HELD
) -> DataFrame:
    """Resumable discovery on a stream of commands (search_id, command_id): the URLs of each job that a command emits.

    ``runs`` and ``seen`` are the state to start from; afterwards the state lives in the stream's state store, one entry per search, and no
    table is rewritten. ``books`` (see :func:`pressroom.operators.search.search_books`) holds the captured pages per search. Commands of one search in one micro-batch are carried out in order of
    command_id. A command that comes again right after it was answered, or after its search has ended, emits nothing. A row of the start state holds what its search has seen, as a
    book holds what was captured for it.
    """
    hashed = F.xxhash64("search_id")
    bucket = F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket")
    known = seen.select("search_id", F.col("url").alias("_url")).filter("_url IS NOT NULL")
    limits = search_limits(runs).withColumn("answered", F.col("last_result").isNotNull())
    run = F.struct(*[name for name in StructType.fromDDL(SEARCH_STATE).names if name not in ("seen", "more_seen")])
    start = limits.select("search_id", F.when(F.col("status").isNotNull(), run).alias("_run")).unionByName(known, allowMissingColumns=True)
    start = start.groupBy("search_id").agg(F.first("_run", ignorenulls=True).alias("_run"), F.collect_set("_url").alias("_seen"))
    # URLs that the row of a search can't hold, or that belong to none, get entries of their own
    many = F.col("_run").isNull() | (F.size("_seen") > held)
    none = F.expr("CAST(array() AS array<string>)")
    state = F.struct("_run.*", F.when(many, none).otherwise(F.col("_seen")).alias("seen"), many.alias("more_seen"))
    search = F.struct("search_id", F.when(F.col("_run").isNotNull(), F.to_json(state)).alias("state"), F.when(many, F.col("_seen")).otherwise(none).alias("aside"))
    # rows of the start state hold about SEARCH_SLICE searches, however many there are: the rows of a bucket are cut by their order
    cut = F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("_hash")) - 1) / SEARCH_SLICE).alias("_slice")
    rows = start.select(bucket, hashed.alias("_hash"), search.alias("_search")).select("bucket", cut, "_search")
    initial = rows.groupBy("bucket", "_slice").agg(F.collect_list("_search").alias("searches")).drop("_slice").groupBy("bucket")
    asked = commands.select("search_id", "command_id").join(books, "search_id", "left")
    asked = asked.select(bucket, "search_id", "command_id", F.to_json("book").alias("book"))
    return asked.groupBy("bucket").transformWithState(_Discovery(held), StructType.fromDDL(ITEMS), "Append", "None", initial)
