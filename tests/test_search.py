"""Provider pages, page cutoffs, budgets and the resumable advance against plain-Python models."""

import hashlib
import itertools
import json
import random

from pyspark.sql import functions as F

from pressroom.operators.search import (
    advance,
    cut_repeats,
    discover_once,
    emitted_jobs,
    next_runs,
    page_fingerprint,
    query_text,
    request_plan,
    search_position,
    take_first,
    usable_hits,
    valid_search_requests,
)
from pressroom.schemas import RESULT_PAGES, SEEN
from pressroom.sources.intake import explode_batches, read_result_pages


def captured(spark, bodies):
    return spark.createDataFrame([(str(i), 0, 0, status, body) for i, (status, body) in enumerate(bodies)], RESULT_PAGES)


def test_hits_of_captured_pages(spark):
    first = {"organic_results": [{"link": "https://daily.site/a?x=1#top"}, {"link": "http://daily.site/b"}, {"title": "no link"}], "serpapi_pagination": {"next": "2"}}
    second = {"organic_results": [{"link": "https://daily.site/"}, {"link": "https://eve.daily.site/c"}, {"link": "https://daily.site/a?x=1"}]}
    pages = read_result_pages(spark.createDataFrame([("s", 0, 0, 200, json.dumps(first)), ("s", 0, 10, 200, json.dumps(second))], RESULT_PAGES))
    hits = usable_hits(pages, allowed_domains=["daily.site"]).withColumn("page", (F.col("offset") / 10).cast("int"))
    assert [r.url for r in hits.orderBy("page", "rank").collect()] == [
        "https://daily.site/a?x=1", None, None, None, "https://eve.daily.site/c", "https://daily.site/a?x=1",
    ]
    urls, totals = discover_once(pages.select("search_id", (F.col("offset") / 10).cast("int").alias("page"), "has_next"), hits.select("search_id", "page", "rank", "url"))
    assert [(r.position, r.url) for r in urls.orderBy("position").collect()] == [(0, "https://daily.site/a?x=1"), (1, "https://eve.daily.site/c")]
    assert tuple(totals.first()) == ("s", 2, 2, 4)


def test_a_failed_page_fails_an_undated_search_that_reaches_it(spark):
    pages = [("a", 0, True, None), ("a", 1, False, "fetch_failed"), ("b", 0, False, None), ("b", 1, False, "fetch_failed"), ("c", 0, True, None), ("c", 1, True, "rate_limited")]
    hits = [(s, 0, r, f"u{r}") for s in "abc" for r in range(3 if s != "c" else 60)]
    urls, totals = discover_once(
        spark.createDataFrame(pages, "search_id string, page int, has_next boolean, error_code string"),
        spark.createDataFrame(hits, "search_id string, page int, rank int, url string"),
    )
    assert {r.search_id: (r.total, r.error_code) for r in totals.collect()} == {"a": (0, "fetch_failed"), "b": (3, None), "c": (50, None)}
    assert {r.search_id for r in urls.collect()} == {"b", "c"}


def test_provider_errors(spark):
    bodies = [
        (200, '{"organic_results":[{"link":""},{"link":5},{},[],7,{"link":"https://a.example/x"}],"serpapi_pagination":{"next":"n"}}'),
        (200, '{"organic_results":{"link":"x"}}'), (200, "{"), (200, "[]"), (None, None), (500, "{}"), (429, "{}"), (200, '{"error":"x"}'),
        (200, '{"error":null,"organic_results":[],"serpapi_pagination":{"next":"n"}}'), (200, '{"organic_results":["' + "x" * 2 * 1024 * 1024 + '"]}'),
        (200, '{"organic_results":[1],"serpapi_pagination":{"next":null}}'),
    ]
    rows = read_result_pages(captured(spark, bodies)).orderBy(F.col("search_id").cast("int")).collect()
    assert rows[0].links == [None] * 5 + ["https://a.example/x"] and rows[0].has_next
    assert rows[1].links == [] and rows[1].has_next is False
    assert [(r.error_code, r.retryable) for r in rows[2:]] == [
        ("fetch_failed", True), ("fetch_failed", True), ("fetch_failed", True), ("fetch_failed", True), ("fetch_failed", False), ("fetch_failed", False),
        (None, None), ("fetch_failed", True), (None, None),
    ]
    assert rows[8].has_next is False and rows[10].has_next is False


def test_fingerprint_minds_the_order(spark):
    row = spark.range(1).select(*[page_fingerprint(F.array(*[F.lit(x) for x in t])).alias(t) for t in ("ab", "ba")]).first()
    assert row.ab == hashlib.sha256(b"a\nb").hexdigest() != row.ba


def test_plan_and_requests(spark):
    df = spark.createDataFrame([("s", " q ", "2024-04-11", "2024-06-02")], "search_id string, query string, a string, b string")
    df = df.select("search_id", "query", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"))
    rows = request_plan(df, ["a.example", "b.example"], pages=2).orderBy("month_index", "offset").collect()
    assert [(r.month_index, r.offset) for r in rows] == [(m, o) for m in range(3) for o in (0, 10)]
    assert rows[0].tbs == "cdr:1,cd_min:04/10/2024,cd_max:05/01/2024" and rows[0].q.endswith(" (site:a.example OR site:b.example)")
    assert spark.range(1).select(query_text(F.lit("x"), ["A.example."])).first()[0] == "x (site:a.example)"
    cases = [("  x ", 1, 1, None), ("xy", 51, 1, None), ("xy", None, 6, None), ("xy", None, None, "Mars"), ("é" * 300, 50, 5, "UTC"), ("x" * 301, 1, 1, None), (None, 1, 1, None)]
    checked = valid_search_requests(spark.createDataFrame(cases, "query string, max_articles int, max_pages int, timezone string"), ["a"]).collect()
    assert [r.reject_reason for r in checked] == ["query_length", "max_articles", "max_pages", "unknown_timezone", None, "query_length", "query_length"]
    assert valid_search_requests(spark.createDataFrame([("xy", 1, 1, "UTC")], "query string, max_articles int, max_pages int, timezone string"), [" "]).first().reject_reason == "no_allowed_domains"


def test_cut_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(g, p, rng.randint(0, 9), rng.random() < 0.9) for g in range(60) for p in range(rng.randint(1, 12))]
    expected = set()
    for g in {r[0] for r in rows}:
        seen = set()
        for _, p, f, more in sorted(r for r in rows if r[0] == g):
            expected.add((g, p, f in seen))
            if f in seen or not more:
                break
            seen.add(f)
    df = spark.createDataFrame(rows, "g int, page int, fingerprint int, has_next boolean")
    assert {(r.g, r.page, r.repeated) for r in cut_repeats(df, ["g"]).collect()} == expected


def test_take_first_keeps_the_rest(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    taken, rest = take_first(df, ["k"], ["id"], 5)
    assert sorted(r.id for r in taken.collect()) == list(range(15)) and rest.count() == 85


def test_batches(spark):
    rows = [("a", [" x ", "", "y"]), ("b", ["x"] * 101), ("c", [" ", "\xa0"]), ("d", []), ("e", ["x"] * 100), ("f", None)]
    items, rejects = explode_batches(spark.createDataFrame(rows, "batch_id string, urls array<string>"))
    assert [tuple(r) for r in items.filter("batch_id = 'a'").orderBy("position").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    assert items.filter("batch_id = 'e'").count() == 100
    assert {r.batch_id: r.reject_reason for r in rejects.collect()} == {"b": "too_many", "c": "all_blank", "d": "empty", "f": "empty"}


def story(months, pages):
    """Every page of a search in the order in which it would be read without limits: (its new URLs, results skipped)."""
    met = set()
    for month in range(months):
        shown = set()
        for offset in itertools.count(0, 10):
            urls, more = pages[month, offset]
            new = tuple(u for u in dict.fromkeys(urls) if u is not None and u not in met)
            met.update(new)
            again = new in shown
            shown.add(new)
            yield () if again else new, len(urls) - len(new)
            if again or not more:
                break


class Reader:
    """Limits on a story: each call reads on until its batch is full, its pages are used up or the story ends."""

    def __init__(self, told, limit, max_pages):
        self.told, self.limit, self.max_pages = told, limit, max_pages
        self.read, self.waiting = 0, []

    def call(self):
        stop = min(self.read + self.max_pages, len(self.told))
        while self.read < stop and len(self.waiting) < self.limit:
            self.waiting += self.told[self.read][0]
            self.read += 1
        batch, self.waiting = self.waiting[: self.limit], self.waiting[self.limit :]
        return batch

    @property
    def over(self):
        return self.read == len(self.told) and not self.waiting


def test_advance_against_a_model(spark):
    rng = random.Random(9)
    models, page_rows, hit_rows, run_rows = {}, [], [], []
    for n in range(25):
        key, pages = f"s{n}", {}
        for month in range(3):
            depth = rng.randint(1, 5)
            for step in range(depth + 3):
                urls = [None if rng.random() < 0.15 else f"https://n.example/{rng.randint(0, 25)}" for _ in range(rng.choice([0, 1, 4, 8]))]
                pages[(month, step * 10)] = (urls, step < depth)
        limits = rng.randint(1, 8), rng.randint(1, 4)
        models[key] = Reader(list(story(3, pages)), *limits)
        run_rows.append((key, "q", "ready", "2024-04-11", "2024-06-02", "UTC", *limits))
        for (month, offset), (urls, more) in pages.items():
            page_rows.append((key, month, offset, more, None, None))
            hit_rows += [(key, month, offset, rank, url) for rank, url in enumerate(urls)]
    none = F.array().cast("array<string>")
    runs = spark.createDataFrame(run_rows, "search_id string, query string, status string, a string, b string, timezone string, max_articles int, max_pages int")
    runs = runs.select(
        "search_id", "query", "status", F.col("a").cast("date").alias("start_date"), F.col("b").cast("date").alias("end_date"), "timezone", "max_articles", "max_pages",
        F.lit(0).alias("month"), F.lit(0).alias("offset"), none.alias("pending"), none.alias("fingerprints"), F.lit(0).alias("pages"), F.lit(0).alias("skipped"),
        none.alias("job_ids"), none.alias("warnings"), F.lit(None).cast("string").alias("last_command_id"),
        F.lit(None).cast("struct<status:string,job_id:string,total:int,pages_fetched:int,skipped:int,urls:array<string>>").alias("last_result"),
        F.lit(0).alias("requests_attempted"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    pages = spark.createDataFrame(page_rows, "search_id string, month int, offset int, has_next boolean, error_code string, retryable boolean").cache()
    hits = spark.createDataFrame(hit_rows, "search_id string, month int, offset int, rank int, url string").cache()
    seen_rows = []
    for call in range(7):
        seen = spark.createDataFrame(seen_rows, SEEN)
        moved = advance(runs.withColumn("command_id", F.concat(F.lit(f"{call}-"), "search_id")), pages, hits, seen).cache()
        rows = {r.search_id: r for r in moved.collect()}
        for key, model in models.items():
            assert list(rows[key].urls) == ([] if model.over else model.call()), (call, key)
            assert list(rows[key].pending) == model.waiting
            assert (rows[key].pages, rows[key].skipped) == (model.read, sum(skipped for _, skipped in model.told[: model.read]))
            assert rows[key].status == ("discovery_complete" if model.over else "ready")
            seen_rows += [(key, url) for url in rows[key].new_seen]
        assert {(k, u) for k, m in models.items() for new, _ in m.told[: m.read] for u in new} == set(seen_rows)
        state = next_runs(runs, moved).collect()
        runs = spark.createDataFrame(state, runs.schema)
    assert any(m.over for m in models.values())


def one_run(spark, **changes):
    base = {
        "search_id": "s", "status": "ready", "start_date": "2024-01-01", "end_date": "2024-02-10", "max_articles": 0, "max_pages": 0, "month": 0, "offset": 0,
        "pending": [], "fingerprints": [], "pages": 0, "skipped": 0, "job_ids": [], "warnings": [], "last_command_id": None, "last_result": None,
        "requests_attempted": 0, "command_id": "c1",
    }
    schema = (
        "search_id string, status string, start_date string, end_date string, max_articles int, max_pages int, month int, offset int, pending array<string>, "
        "fingerprints array<string>, pages int, skipped int, job_ids array<string>, warnings array<string>, last_command_id string, "
        "last_result struct<status:string,job_id:string,total:int,pages_fetched:int,skipped:int,urls:array<string>>, requests_attempted int, command_id string"
    )
    df = spark.createDataFrame([{**base, **changes}], schema)
    return df.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})


PAGES = "search_id string, month int, offset int, has_next boolean, error_code string, retryable boolean"
HITS = "search_id string, month int, offset int, rank int, url string"


def test_errors_leave_the_state(spark):
    seen = spark.createDataFrame([], SEEN)
    hits = spark.createDataFrame([("s", 0, 0, 0, "u")], HITS)
    for rows, code, again in (([], "fetch_failed", True), ([("s", 0, 0, False, "fetch_failed", False)], "fetch_failed", False)):
        row = advance(one_run(spark), spark.createDataFrame(rows, PAGES), hits, seen).first()
        assert (row.error_code, row.retryable, row.month, row.offset, row.pages, row.status) == (code, again, 0, 0, 0, "ready")
        assert next_runs(one_run(spark), advance(one_run(spark), spark.createDataFrame(rows, PAGES), hits, seen)).first().last_command_id is None


def test_second_empty_page_ends_a_month(spark):
    rows = [("s", 0, 0, True, None, None), ("s", 0, 10, True, None, None), ("s", 1, 0, False, None, None)]
    row = advance(one_run(spark), spark.createDataFrame(rows, PAGES), spark.createDataFrame([], HITS), spark.createDataFrame([], SEEN)).first()
    assert (row.month, row.status, row.result_status, row.pages) == (2, "discovery_complete", "discovery_complete", 3)
    assert list(row.warnings) == ["2024-01: provider mengulang halaman; dihentikan"]


def test_stored_result_and_terminal_states(spark):
    pages, hits, seen = spark.createDataFrame([], PAGES), spark.createDataFrame([], HITS), spark.createDataFrame([], SEEN)
    stored = {"status": "queued", "job_id": "j", "total": 1, "pages_fetched": 2, "skipped": 3, "urls": ["u"]}
    again = advance(one_run(spark, last_command_id="c1", last_result=stored), pages, hits, seen)
    row = again.first()
    assert (row.job_id, list(row.urls), row.total, row.skipped_now, row.replayed) == ("j", ["u"], 1, 3, True)
    assert emitted_jobs(again)[0].count() == 0
    complete = advance(one_run(spark, status="discovery_complete"), pages, hits, seen).first()
    assert (complete.result_status, complete.error_code, list(complete.urls)) == ("discovery_complete", None, [])
    assert advance(one_run(spark, status="failed"), pages, hits, seen).first().error_code == "internal_error"


def test_position(spark):
    cases = [(0, 0, [], "ready"), (1, 0, ["x"], "ready"), (1, 10, ["x"], "ready"), (2, 0, ["x"], "ready"), (9, 0, [], "ready"), (2, 0, [], "failed")]
    got = []
    for month, offset, pending, status in cases:
        row = search_position(one_run(spark, month=month, offset=offset, pending=pending, status=status)).first()
        got.append((row.months_total, row.months_completed, str(row.current_start_date), str(row.current_end_date)))
    assert got == [
        (2, 0, "2024-01-01", "2024-01-31"), (2, 0, "2024-01-01", "2024-01-31"), (2, 1, "2024-02-01", "2024-02-10"),
        (2, 1, "2024-02-01", "2024-02-10"), (2, 2, "2024-02-01", "2024-02-10"), (2, 2, "None", "None"),
    ]


def test_searches_are_never_broadcast(spark):
    """A file's size says little of the rows that are made of it, so tables of searches meet by a sort."""
    pages = spark.createDataFrame([("s", 0, 0, False, None, None)], PAGES)
    hits = spark.createDataFrame([("s", 0, 0, 0, "u0")], HITS)
    seen = spark.createDataFrame([], "search_id string, url string")
    runs = one_run(spark, max_pages=1)
    moved = advance(runs, pages, hits, seen)
    for df in (moved, next_runs(runs, moved)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.urls for r in moved.collect()] == [["u0"]]


def test_replay_plan_does_not_repeat_the_walk(spark, small):
    from pressroom.plans.catalog import QUERIES

    plan = QUERIES["advance_replay"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") < 10


def test_progress_by_month_sizes_its_tasks_by_rows(spark, small):
    """Every shuffle has as many tasks as the lines ask for, and no task counts the months of a whole file before one."""
    from pressroom.operators.search import progress_by_month
    from pressroom.operators.skew import tasks_for
    from pressroom.plans import QUERIES

    runs = spark.createDataFrame([("a", [1, 2]), ("b", [2, 3, None]), ("c", [])], "search_id string, job_ids array<int>")
    months = spark.createDataFrame([(1, "2024-01", 2), (2, "2024-01", 3), (2, None, 1), (4, "2024-02", 5), (None, "2024-01", 9)], "job_id int, month string, n long")
    out = progress_by_month(runs, months, 7)
    expected = [("a", "2024-01", 5), ("a", None, 1), ("b", "2024-01", 3), ("b", None, 1)]
    assert out.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, progress_by_month(runs, months).collect()), key=str) == sorted(expected, key=str)
    assert tasks_for(spark.range(1000), rows=100) == 10 and tasks_for(spark.range(10), rows=100) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = QUERIES["search_progress_by_month"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
