"""Keyed state in streams, locations on shredded documents, tables published together."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import locate, shred
from tidemark.sources import fetch_log, published
from tidemark.plans import streams
from tidemark.streaming import caches, deltas, gates, jobs


def ran(spark, df, path, at):
    """One run of a stream to files, on a checkpoint of its own."""
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(f"{path}/rows").collect()]


def brute_deltas(polls):
    """polls: [(source, poll, {id: status})] in order."""
    last, out = {}, []
    for source, poll, rows in polls:
        before = last.get(source)
        added = {i: s for i, s in rows.items() if before is None or before.get(i) != s}
        gone = 0 if before is None else sum(i not in rows for i in before)
        if before is not None:
            out += [(source, poll, "added", i, s, None, None) for i, s in added.items()]
        out.append((source, poll, "baseline" if before is None else "changed" if added or gone else "unchanged", None, None, len(added), gone))
        last[source] = rows
    return out


def test_deltas_carry_added_rows_alone_and_go_on_after_a_restart(spark, tmp_path):
    rng = random.Random(5)
    polls, sets = [], {s: {f"i{k}": "live" for k in range(6)} for s in "abc"}
    for n in range(6):
        for s in "abc":
            if n and rng.random() < 0.7:
                sets[s] = {i: rng.choice(["live", "live", "dead"]) for i in rng.sample([f"i{k}" for k in range(9)], 6)}
            polls.append((s, n, dict(sets[s])))
    schema = "source string, poll long, rows long, id string, status string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n in range(6):
        rows = [(s, p, len(r), i, v) for s, p, r in polls if p == n for i, v in r.items()]
        half = len(rows) // 2  # a poll in two files, so in two batches
        for part in (rows[:half], rows[half:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (2, 5):
            got = ran(spark, deltas.set_deltas(stream), tmp_path, n)
    assert sorted(got, key=repr) == sorted(brute_deltas(polls), key=repr)


@pytest.mark.parametrize(("events", "ends"), [
    (["submit 0", "lease 10 w", "finish 20 w"], ("done", 20)), (["submit 0", "lease 10 w", "lease 11 x", "finish 20 x"], ("interrupted", 100)), (["submit 0", "lease 10 w", "finish 101 w"], ("interrupted", 100)),
    (["submit 0", "lease 10 w", "finish 100 w"], ("interrupted", 100)), (["submit 0", "lease 10 w", "heartbeat 90 w", "finish 150 w"], ("done", 150)), (["submit 0", "cancel 5", "lease 10 w"], ("cancelled", 5)),
    (["submit 0", "lease 10 w", "cancel 20", "finish 30 w"], ("cancelled", 20)), (["lease 10 w", "finish 20 w"], None), (["submit 0", "submit 3", "lease 10 w", "fail 20 w"], ("failed", 20)),
    (["submit 0", "lease 10 w", "submit 200", "lease 210 x", "finish 220 x"], ("done", 220)), (["submit 0", "lease 10 w", "finish 20 w", "submit 30"], ("done", 20)),
])
def test_a_job_by_its_events(events, ends):
    """The state machine alone, with its lease of 90 minutes."""
    state, at_end = (None, None, 0), None
    for e in [*events, "close 10000"]:
        kind, at, worker = [*e.split(), None][:3]
        at = int(at)
        if state[0] == "running" and state[2] <= at:
            at_end, state = state[2], ("interrupted", state[1], 0)
        if kind != "close":
            new = jobs.after(state, kind, worker, at, 90)
            at_end = at if new[0] != state[0] else at_end
            state = new
    assert (None if state[0] is None else (state[0], at_end)) == ends


def test_jobs_out_of_order_and_after_a_restart(spark, tmp_path):
    schema = "job long, kind string, at timestamp, worker string"
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    files = [[(1, "finish", 170, "w"), (1, "lease", 60, "w")], [(1, "heartbeat", 120, "w"), (1, "submit", 0, None), (2, "submit", 5, None)], [(2, "lease", 6, "w")], [(-1, "close", 60 * 23, None)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(j, k, minute(m), w) for j, k, m, w in rows], "job long, kind string, at string, worker string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 3):
            got = ran(spark, jobs.job_changes(stream, "12 hours"), tmp_path, n)
    told = sorted((j, at.strftime("%H:%M"), s) for j, s, at, _ in got)
    assert told == [(1, "00:00", "queued"), (1, "01:00", "running"), (1, "02:50", "done"), (2, "00:05", "queued"), (2, "00:06", "running"), (2, "01:36", "interrupted")]


def replayed(events):
    """Changes of one job: events (at, kind, worker) in order of at, then of rank; leases of 90 minutes, in microseconds."""
    lease, state, out = 90 * 60 * 10**6, (None, None, 0), []
    for at, rank, worker in [*sorted({(at, jobs.RANK.index(kind), worker or "") for at, kind, worker in events}), (10**17, -1, "")]:
        if state[0] == "running" and state[2] <= at:
            out.append(("interrupted", state[2], state[1]))
            state = ("interrupted", state[1], 0)
        if rank >= 0:
            before, state = state, jobs.after(state, jobs.RANK[rank], worker or None, at, lease)
            if state[0] != before[0]:
                out.append((state[0], at, state[1]))
    return out


def test_many_jobs_in_many_batches_are_a_replay(spark, tmp_path, monkeypatch):
    """Jobs that share a key, over days and a restart, to the microsecond; rows of other kinds, of no job or time, and of far-off times."""
    monkeypatch.setattr(jobs, "SHELVES", 3)
    rng = random.Random(11)
    schema, hour, start = "job long, kind string, micros long, worker string", 3600 * 10**6, 1_700_000_000 * 10**6
    events = []
    for job in [*range(60), 2**53 + 1, -7, None]:
        days = [rng.randrange(4 * 24) * hour for _ in range(2)]
        for _ in range(rng.randint(1, 20)):
            at = start + rng.choice(days) + rng.choice([0, 1, 2, 999, rng.randrange(hour), rng.randrange(2 * hour)])
            events.append((job, rng.choice([*jobs.RANK, "submit", "lease", "lease", "odd"]), at, rng.choice(["a", "a", "a", "b", None])))
        if job == -7:  # in the year 3000, beyond what a data frame's nanoseconds hold
            events += [(job, "submit", 32_503_680_000 * 10**6 + n, "a") for n in range(2)] + [(job, "lease", 32_503_680_001 * 10**6, "a")]
        if job is not None and job % 3 == 0:  # two in one millisecond, in the order that their ranks have not
            events += [(job, "submit", start, None), (job, "finish", start + 100, "w"), (job, "lease", start + 200, "w")]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("job long, kind string, at timestamp, worker string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    files = [[] for _ in range(6)]
    for e in events:
        files[min(4, (e[2] - start + rng.randrange(12) * hour) // (24 * hour))].append(e)
    files[0].append((1, "cancel", None, None))
    files[5].append((None, "close", 250_000_000_000 * 10**6, None))
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).select("job", "kind", F.timestamp_micros("micros").alias("at"), "worker").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (2, 5):
            got = ran(spark, jobs.job_changes(stream, "2 days").selectExpr("job", "status", "unix_micros(at) AS at", "worker"), tmp_path, n)
    own = {}
    for job, kind, at, worker in events:
        own.setdefault(job, []).extend([(at, kind, worker)] if kind in jobs.RANK else [])
    want = [(job, *c) for job, rows in own.items() for c in replayed(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {s for _, s, *_ in want} == {"queued", "running", *jobs.ENDED}


def test_review_gate_as_a_table(spark):
    found = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h"), (4, "i")], "thread long, finding string").withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    told = spark.createDataFrame([(1, "ok", "2024-01-03"), (2, "late", "2024-01-06"), (3, "early", "2024-01-01")], "thread long, verdict string, d string").select("thread", "verdict", F.col("d").cast("timestamp").alias("decided_at"))
    assert {r["thread"]: r["state"] for r in gates.review_gate(found, told).collect()} == {1: "ok", 2: "unreviewed", 3: "unreviewed", 4: "unreviewed"}


DOC = {"topics": [{"units": [{"unit_name": "U", "contents": [{"content": "x"}, {"title": "Summarizer", "object_type": "OBJECTIVE_QUESTIONS", "content": "line\n" * 100 + "Use Gemini-2.0-flash, not gemini.\n" + "tail " * 200, "n": 1.50, "flag": True, "a b": None}]}]}]}


def located(spark, paths, terms, urls=(), name="demo.json"):
    docs = shred.exports(spark.createDataFrame([("demo.json", "Demo", json.dumps([DOC]))], "source_file string, course string, body string"))
    cells = spark.createDataFrame([("B.xlsx", "Course Outline", 1, 4, " Outline "), ("B.xlsx", "Course Outline", 2, 4, "- Gamma AI makes slides")], "book string, sheet string, row int, col int, value string")
    rows = spark.createDataFrame([(name, p, list(terms), list(urls)) for p in paths], "source_file string, field_path string, terms array<string>, urls array<string>")
    return {r["field_path"]: r for r in locate.located(rows, locate.nodes(docs), cells).collect()}


def test_spans_count_from_the_excerpt_and_the_question_is_named(spark):
    path = "$.topics[0].units[0].contents[1].content"
    r = located(spark, [path], ["gemini", "gemini-2.0-flash"])[path]
    (a, b) = r["spans"]
    assert r["excerpt"][a["start"] : a["start"] + a["length"]] == "Gemini-2.0-flash" and r["excerpt"][b["start"] :][: b["length"]] == "gemini"
    assert (r["title"], r["object_type"]) == ("Summarizer", "OBJECTIVE_QUESTIONS") and r["truncated"] and r["offset"] == 500 and r["matched_by"] == "name"
    assert located(spark, [path], ["absent"], ["tail"])[path]["matched_by"] == "referenced_url"
    lost = located(spark, [path], ["absent"])[path]
    assert lost["resolved"] and lost["reason"] == "term_not_in_field" and len(lost["excerpt"]) == locate.NO_MATCH_HEAD


def test_every_failure_says_why(spark):
    unit = "$.topics[0].units[0]"
    want = {
        "B.xlsx::Tools": "sheet_declaration", "B.xlsx::Course Outline::Outline::row9": "workbook_cell_missing", "Gone.xlsx::Course Outline::Outline::row2": "workbook_cell_missing", "$.topics[9].x": "path_not_found",
        unit: "not_a_text_field", f"{unit}.contents[1]['a b']": "unparsable_path", "": "unparsable_path", "B.xlsx::Course Outline::OUTLINE::row2": "", f"{unit}.contents[1].n": "term_not_in_field", f"{unit}.contents[1].flag": "term_not_in_field",
    }
    got = located(spark, [*want, None], ["Gamma AI"])
    assert {k: r["reason"] for k, r in got.items()} == {**want, None: "unparsable_path"}
    assert got["B.xlsx::Course Outline::OUTLINE::row2"]["object_type"] == "SESSION_PPT" and got[f"{unit}.contents[1].n"]["excerpt"] == "1.5"
    assert located(spark, ["$.topics[0]"], ["x"], name="none.json")["$.topics[0]"]["reason"] == "course_export_missing"


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def seen(store, table, version=None):
    return sorted(r["v"] for r in store.read(table, version).collect())


def test_two_writers_one_winner_and_nothing_of_the_other(spark, tmp_path):
    store = published.Tables(spark, f"file://{tmp_path}/t")
    one = store.commit({"a": rows(spark, 1), "b": rows(spark, 2)})
    assert store.commit({"a": rows(spark, 3)}, one) == 2
    with pytest.raises(published.Conflict):
        store.commit({"a": rows(spark, 4), "b": rows(spark, 4)}, one)
    assert store.commit({"c": rows(spark, 5)}, one) == 3  # touches nothing that changed
    assert (seen(store, "a"), seen(store, "b"), seen(store, "c"), seen(store, "a", 1)) == ([3], [2], [5], [1])
    with pytest.raises(published.Refused):
        store.commit({"c": rows(spark, 6)}, validate=lambda staged: ["too few"] if staged["c"].count() < 2 else [])
    assert store.commit({"b": None}) == 4 and set(store.tables()) == {"a", "c"}
    assert len(list((tmp_path / "t/data").iterdir())) == 3


def test_a_writer_that_dies_between_the_steps(spark, tmp_path, monkeypatch):
    store = published.Tables(spark, f"file://{tmp_path}/t")
    store.commit({"a": rows(spark, 1)})
    monkeypatch.setattr(published.Tables, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    monkeypatch.setattr(store, "fs", type("Dead", (), {"delete": lambda *a: None, "__getattr__": lambda self, n, fs=store.fs: getattr(fs, n)})())
    with pytest.raises(KeyboardInterrupt):
        store.commit({"a": rows(spark, 2)})
    monkeypatch.undo()
    again = published.Tables(spark, f"file://{tmp_path}/t")
    assert seen(again, "a") == [1] and again.current() == 1
    assert again.vacuum(older_than=3600) == [] and len(again.vacuum(older_than=-5)) == 1 and seen(again, "a") == [1]


def test_a_number_is_taken_once(spark, tmp_path):
    store = published.Tables(spark, f"file://{tmp_path}/t")
    store.commit({"a": rows(spark, 1)})
    assert not store.publish(1, {"a": "x"}, ["a"]) and store.publish(2, {"a": "data/y/a"}, ["a"]) and store.versions() == [1, 2]
    assert sorted(p.name for p in (tmp_path / "t/versions").iterdir() if not p.name.startswith(".")) == ["0000000001", "0000000002"]


def test_caches_are_a_replay(spark):
    folder = "/root/testdata/sf0.001"
    rows = streams.body_requests(spark, folder).filter("url IS NOT NULL").selectExpr("cache", "request", "url", "unix_millis(at) AS at").collect()
    want, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["request"])):
        bodies = held.setdefault(r["cache"], {})  # url: (fetched, used)
        there = bodies.get(r["url"])
        fresh = there is not None and r["at"] - there[0] < caches.TTL
        bodies[r["url"]] = (there[0] if fresh else r["at"], r["at"])
        out = None
        if len(bodies) > streams.BODIES:
            out = min(((used, u) for u, (_, used) in bodies.items() if u != r["url"]))[1]
            del bodies[out]
        want[r["cache"], r["request"]] = (r["url"], "hit" if fresh else "miss" if there is None else "expired", out)
    got = {(r["cache"], r["request"]): (r["url"], r["outcome"], r["evicted"]) for r in streams.cached_bodies(spark, folder).collect()}
    assert got == want and {o for _, o, _ in want.values()} == {"hit", "miss", "expired"} and any(e for *_, e in want.values())


def test_an_entry_of_the_log_counts_when_it_is_whole(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    fetch = lambda *urls: spark.createDataFrame([(u.split("/")[2], u, 200, u, None, "line\nline é", "now") for u in urls], fetch_log.FETCHES)
    assert fetch_log.entries(root) == 0
    fetch_log.appended(fetch("https://a.test/1", "https://b.test/1"), root, 0)
    fetch_log.appended(fetch("https://a.test/2"), root, 1)
    fetch_log.appended(fetch("https://c.test/3"), root, 2)
    (tmp_path / "log/1/_SUCCESS").unlink()  # its writer died: neither it nor what came after counts
    spark.dataSource.register(fetch_log.FetchLog)
    read = lambda: sorted((r["host"], r["url"], r["body"]) for r in spark.read.format("fetches").load(root).collect())
    assert fetch_log.entries(root) == 1 and read() == [("a.test", "https://a.test/1", "line\nline é"), ("b.test", "https://b.test/1", "line\nline é")]
    fetch_log.appended(fetch("https://a.test/2"), root, 1)
    assert fetch_log.entries(root) == 3 and len(read()) == 4
