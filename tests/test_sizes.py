"""What shows at size alone, or by chance: means between two thousandths, plans that hold beyond the smallest tables."""

from pyspark.sql import functions as F

from tidemark.functions import ladders as L


def test_a_mean_between_two_thousandths_is_rounded_up(spark):
    """In doubles each of these came out just below the half."""
    names = ("does_taught_job", "free_student_path", "signup_friction", "maturity", "coverage_of_steps")
    cases = [((0.43, 0.53, 0.24, 0.33, 0.13), 0.387), ((0.39, 0.38, 0.95, 0.2, 0.53), 0.467), ((0.37, 0.64, 0.63, 0.02, 0.41), 0.446), ((0.11, 0.96, 0.57, 0.11, 0.83), 0.464)]
    rows = spark.createDataFrame([(*v, want) for v, want in cases], [*names, "want"])
    got = rows.select("want", L.fit_score({n: F.col(n) for n in names}).alias("fit")).collect()
    assert [r.fit for r in got] == [r.want for r in got]


def broadcasts(df):
    """What stands below each broadcast in a plan, before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*(0123456789)")) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def test_exploded_texts_are_never_broadcast(spark, tmp_path):
    """Their file is smaller than the words' one, and what they explode into is not."""
    from tidemark.operators import dictionary

    spark.range(20).select(F.lit("we like tool one and tool two").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    words = spark.range(3000).select(F.concat(F.lit("tool "), F.sha2(F.col("id").cast("string"), 256)).alias("w"))
    texts = spark.read.parquet(f"{tmp_path}/t")
    words = words.unionByName(spark.createDataFrame([("tool one",)], "w string"))
    for few in (1 << 16, 10):
        before, dictionary._FEW_WORDS = dictionary._FEW_WORDS, few
        try:
            found = dictionary.matched(texts, "t", words, "w")
            held = dictionary.containing(texts, "t", words, "w")
        finally:
            dictionary._FEW_WORDS = before
        for df in (found, held):
            assert not any("Generate" in plan for plan in broadcasts(df))
        assert [r.found for r in found.collect()] == [["tool one"]] * 20
        assert held.count() == 20


def test_a_row_beyond_every_sheet_is_a_missing_cell(spark):
    from tidemark.operators import locate
    from tidemark.functions.text import strings

    cells = spark.createDataFrame([("b.xlsx", "S", 1, 1, "Name"), ("b.xlsx", "S", 2, 1, "an x")], "book string, sheet string, row int, col int, value string")
    nodes = spark.createDataFrame([], "source_file string, path string, kind string, value string")
    rows = spark.createDataFrame([("b.json", "b.xlsx::S::Name::row2"), ("b.json", "b.xlsx::S::Name::row9000020000")], "source_file string, field_path string")
    out = locate.located(rows.withColumns({"terms": strings(("an",)), "urls": strings(("in",))}), nodes, cells)
    assert {r.field_path[-4:]: (r.resolved, r.reason) for r in out.collect()} == {"row2": (True, ""), "0000": (False, "workbook_cell_missing")}


class Held:
    """State variables of one key, in memory, with the number of round trips that they would cost; timers likewise."""

    def __init__(self):
        self.trips, self.timers, self.vars = 0, set(), {}

    def _var(self, name, *_):
        held, values = self, self.vars.setdefault(name, {})

        class Variable:
            def __getattr__(self, call):
                def run(*a):
                    held.trips += 1
                    return {
                        "get": lambda: values.get(()), "exists": lambda: () in values, "update": lambda v: values.__setitem__((), v), "clear": lambda: values.clear(), "getValue": lambda k: values.get(k), "containsKey": lambda k: k in values,
                        "updateValue": lambda k, v: values.__setitem__(k, v), "removeKey": lambda k: values.pop(k), "keys": lambda: iter(list(values)), "iterator": lambda: iter(list(values.items())),
                    }[call](*a)

                return run

        return Variable()

    getValueState = getMapState = _var  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.trips += 1
        self.timers.add(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs  # noqa: N815


def through(processor, key, rows, at):
    """What a key's rows come to once the watermark has passed a time, and the round trips."""
    held = Held()
    processor.init(held)
    list(processor.handleInputRows((key,), iter(rows), Now(0)))
    out = []
    while held.timers and min(held.timers) <= at:
        due = min(held.timers)
        held.timers.discard(due)
        now = Now(at)
        out += list(processor.handleExpiredTimer((key,), now, now))
    return out, held.trips


def test_a_job_costs_few_accesses_to_state():
    from pyspark.sql import Row

    from tidemark.streaming import jobs

    minute = 60_000
    events = [Row(kind=k, millis=m * minute, worker=w) for k, m, w in (("finish", 120, "w"), ("heartbeat", 80, "w"), ("lease", 10, "w"), ("lease", 20, "x"), ("submit", 0, None))]
    out, trips = through(jobs.JobStates(), 7, events, 10**9)
    assert [r.status for r in out] == ["queued", "running", "done"]
    assert trips <= 6


def test_requests_cost_few_accesses_to_state():
    from pyspark.sql import Row

    from tidemark.streaming import caches

    rows = [Row(url=f"u{i % 7}", request=i, millis=(i * 7919) % 1000 * 5000) for i in range(1000)]  # within two hours
    out, trips = through(caches.BodyCache(5, 3 * 3600 * 1000), "c", rows, 10**9)
    bodies, want = {}, []
    for r in sorted(rows, key=lambda r: (r.millis, r.request)):
        want.append((r.request, *caches.asked(bodies, r.url, r.millis, 5, 3 * 3600 * 1000)))
    assert [(r.request, r.outcome, r.evicted) for r in out] == want
    assert trips < 50


def test_heavy_rows_of_one_file_are_dealt_out(spark):
    """One row group is one task, however much each of its rows costs."""
    from tidemark.plans import agents, derived

    folder, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    for df in (derived.model_pages(spark, folder), *agents.sites(spark, folder)):
        assert df.rdd.getNumPartitions() >= cores


def test_the_gate_is_passed_once_for_both_results(spark):
    """Claims and notes, found and refused: neither reads the pages or asks the tiers anew."""
    from tidemark.plans import agents

    folder = "/root/testdata/sf0.001"
    for query in (agents.declared_changes, agents.table_evidence):
        assert not [f for f in query(spark, folder).inputFiles() if f.endswith("part.parquet")]


def test_a_poll_costs_few_accesses_to_state():
    from pyspark.sql import Row

    from tidemark.streaming import deltas

    held, processor = Held(), deltas.SetDelta()
    processor.init(held)
    poll = lambda n, ids: [Row(poll=n, rows=len(ids), id=i, status="live") for i in ids]
    told = [r for rows in (poll(0, "abcd"), poll(1, "abcd"), poll(2, "abe")) for r in processor.handleInputRows(("s",), iter(rows), Now(0))]
    assert [(r.poll, r.kind, r.n_added, r.n_removed) for r in told] == [(0, "baseline", 4, 0), (1, "unchanged", 0, 0), (2, "added", None, None), (2, "changed", 1, 2)]
    assert held.trips <= 3 * 2 + 11 * 2 + 1 + 2


def test_texts_of_the_corpus_are_never_broadcast(spark):
    """Prose is as small as its file to the planner; the names that are looked for in it are what is sent."""
    from tidemark.operators import inventory
    from tidemark.plans import derived
    from tidemark.sources.stages import staged

    records = staged(derived._records(spark, "/root/testdata/sf0.001"))
    entries = staged(inventory.entries_of(staged(inventory.structured(records))))
    sent = broadcasts(inventory.prose_mentions(records, entries))
    assert sent and not any("body_text" in plan for plan in sent)


def test_a_search_keeps_the_pages_of_a_word_in_their_block(spark):
    """Five pages a question and block are shuffled, however many pages share a word; equal questions are asked once."""
    from tidemark.operators import search

    pages = spark.createDataFrame([(i, "d.test", "the word" if i % 3 else f"the rare{i % 2}") for i in range(200)], "page_id long, domain string, text string")
    blocks, places = search.postings(pages, 16)
    queries = spark.createDataFrame([(i, t, ["d.test"]) for i, t in enumerate(["the word"] * 30 + ["word the", "rare1", "the the"])], "query_id long, text string, domains array<string>")
    before, search.ASKED = search.ASKED, 1
    try:
        found = search.searched(queries, blocks, places)
    finally:
        search.ASKED = before
    assert "arrays_zip" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.page_id))
    ranked = lambda ids: list(enumerate(ids, 1))
    assert got == {i: ranked([1, 2, 4, 5, 7]) for i in range(31)} | {31: ranked([3, 9, 15, 21, 27]), 32: ranked([0, 1, 2, 3, 4])}


def test_courses_of_runs_are_found_once(spark):
    """No row for each course of each dependency of each run, and no second pass for the runs that none concerns."""
    from tidemark.operators import resolve

    jobs = spark.createDataFrame([(1, ["Course A", ""], ["p"]), (2, None, ["p", "q"]), (3, [""], ["gone"]), (4, None, None), (5, [], ["q", "gone", "q"])], "run_id long, courses array<string>, dep_ids array<string>")
    taught = spark.createDataFrame([("p", "B"), ("p", "b"), ("p", ""), ("q", "C D"), ("q", "B"), ("q", None)], "dep_id string, course string")
    out = resolve.courses_of(jobs, taught)
    assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "course_a"), (2, "b"), (2, "c_d"), (3, "*"), (4, "*"), (5, "b"), (5, "c_d")]


def test_exports_are_dealt_out_and_never_broadcast(spark):
    """A few megabytes of documents shred for minutes: parts are asked for, not left to the bytes; what they shred into isn't sent to all."""
    from tidemark.operators import locate, shred
    from tidemark.plans import derived
    from tidemark.sources import stages

    docs = derived._exports(spark, "/root/testdata/sf0.001")
    assert docs.select("course").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    docs = stages.staged(docs)
    assert shred.units(docs).select("unit_id").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert not any("MapInArrow" in plan for plan in broadcasts(shred.dereferenced(shred.records(docs), docs)))
    assert {r["kind"] for r in locate.nodes(docs, ("text",)).select("kind").distinct().collect()} == {"text"}


def test_a_job_is_no_key_of_its_own(spark, tmp_path):
    """Each visit to a key costs more than its job: keys stay as many, however many the jobs."""
    from tidemark.streaming import jobs

    spark.range(6000).selectExpr("id AS job", "'submit' AS kind", "timestamp'2024-01-01' AS at", "CAST(NULL AS string) AS worker").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(-1, "close", None)], "job long, kind string, worker string").selectExpr("job", "kind", "timestamp'2024-02-01' AS at", "worker").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job long, kind string, at timestamp, worker string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.job_changes(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start(f"{tmp_path}/rows")
    query.awaitTermination()
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 6000 / 4
    assert spark.read.parquet(f"{tmp_path}/rows").selectExpr("count(DISTINCT job)", "min(status)", "max(status)").first()[:] == (6000, "queued", "queued")


def test_a_part_in_many_files_comes_in_one_batch(spark, monkeypatch):
    """Not each part is written and read by one task; a small part is one file, and so are all others then."""
    from tidemark.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    for sizes, files in (([900, 450, 700, 1], 4), ([900, 250, 700, 1], 2), ([900, 40, 700, 700], 1), ([900, 0, 700, 1], 1)):
        df = spark.createDataFrame([(n * 10_000 + i, n) for n, size in enumerate(sizes) for i in range(size)], "v long, part int")
        path, each = streams._filed(df, "part", 4)
        assert each == files
        query = streams._stream(spark, path, each).writeStream.format("noop").trigger(availableNow=True).start()
        query.awaitTermination()
        assert [p.numInputRows for p in query.recentProgress if p.numInputRows or 0 in sizes] == sizes
