"""Operators on small cases: invariants, ties, nulls, and what must not happen."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import ladders as L
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import history, resolve, score, trust
from tidemark.sources import snapshots, stages, workbook
from tidemark.streaming import gates


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_blast_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("a", "question_tag")] * 5 + [("b", "question_tag")] * 7, "k string, e string")
    got = {r["k"]: r["b"] for r in rows.groupBy("k").agg(score.blast(F.col("e"), F.lit(True)).alias("b")).collect()}
    assert got == {"a": 2, "b": 4}  # 2.5 and 3.5


def test_passing_mentions_are_not_doubled(spark):
    rows = spark.createDataFrame([("prose_name",), ("link:img",)], "e string").select(score.tenths(F.col("e"), F.lit(True)).alias("t"))
    assert [r["t"] for r in rows.collect()] == [2, 20]


def test_first_sight_is_a_baseline_and_ids_repeat(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate("aabab")], "source string, at int, value string")
    out = history.watermark_signals(rows).orderBy("at").collect()
    assert [r["kind"] for r in out] == ["baseline", "unchanged", "changed", "changed", "changed"]
    assert history.ledger(history.watermark_signals(rows)).count() == 2
    assert out[2]["signal_id"] == out[4]["signal_id"] == gates.signal_id("s", "b")


def test_absence_outside_the_examined_scope_is_no_resolution(spark):
    open_ = spark.createDataFrame([("f1", "d1"), ("f2", "d2"), ("f3", "d1")], "finding_id string, dep_id string")
    seen = spark.createDataFrame([("f3",)], "finding_id string")
    got = history.resolve_absent(open_, seen, spark.createDataFrame([("d1",)], "dep_id string"))
    assert [r["finding_id"] for r in got.collect()] == ["f1"]


def test_merge_drops_an_examined_key_without_new_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "dep_id string, v int")
    new = spark.createDataFrame([("a", 9)], "dep_id string, v int")
    got = history.merged_slice(old, new, spark.createDataFrame([("a",), ("b",)], "dep_id string"))
    assert sorted((r["dep_id"], r["v"]) for r in got.collect()) == [("a", 9), ("c", 3)]


def test_reopened_is_new_and_order_of_severity(spark):
    state = spark.createDataFrame([("a", "resolved", "high", "p"), ("b", "open", "high", "p"), ("c", "open", "high", "p"), ("d", "open", "high", "p")], "finding_id string, state string, severity string, fingerprint string")
    found = spark.createDataFrame([("a", "low", "p"), ("b", "critical", "p"), ("c", "low", "q"), ("d", "high", "q"), ("e", "low", "p")], "finding_id string, severity string, fingerprint string")
    got = {r["finding_id"]: r["diff_class"] for r in history.classified(found, state).collect()}
    assert got == {"a": "new", "b": "worsened", "c": "improved", "d": "changed", "e": "new"}


def test_upsert_keeps_first_seen_and_null_new_values_win(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, first_seen int, v string")
    new = spark.createDataFrame([("a", 5, None), ("c", 5, "z")], "k string, first_seen int, v string")
    got = {r["k"]: (r["first_seen"], r["v"]) for r in history.upserted(old, new, "k").collect()}
    assert got == {"a": (1, None), "b": (1, "y"), "c": (5, "z")}


def test_precision_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "id long, finding_id string, verdict string")
    assert history.precision(empty).first()["precision"] is None


def test_majority_ties_go_to_the_first_seen(spark):
    rows = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4)], "k string, v string, ord int")
    assert resolve.majority(rows, ["k"], "v", "ord").first()["v"] == "b"


def test_projection_adds_up_in_tenths(spark):
    rows = spark.createDataFrame([("d", c, e, "CODING_QUESTIONS", "q", "package") for c in "AABBC" for e in ("prose_name", "question_tag", "title")], "dep_id string, course string, evidence_source string, object_type string, content_id string, kind string")
    whole = score.reach(rows, "dep_id").first()["tenths"]
    assert whole == sum(r["tenths"] for r in score.reach(rows, "dep_id", "course").collect())


def test_partitioning_and_order_do_not_matter(spark):
    rows = [("d%d" % (i % 5), "solution_import" if i % 3 else "prose_name", "CODING_QUESTIONS", str(i), "package") for i in range(60)]
    schema = "dep_id string, evidence_source string, object_type string, content_id string, kind string"
    a = score.reach(spark.createDataFrame(rows, schema).repartition(1), "dep_id")
    b = score.reach(spark.createDataFrame(rows[::-1], schema).repartition(8), "dep_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_row_set_hash_ignores_order(spark):
    rows = [("g", i, str(i)) for i in range(9)]
    h = lambda r: spark.createDataFrame(r, "g string, a int, b string").groupBy("g").agg(H.row_set_hash("a", "b").alias("h")).first()["h"]
    assert h(rows) == h(rows[::-1]) != h(rows[1:])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(1, 40), min_size=1, max_size=12))
def test_session_specs_read_back(spark, numbers):
    df = spark.createDataFrame([(sorted(numbers),)], "n array<int>").select(L.session_numbers(L.compacted(F.col("n"))).alias("n"))
    assert df.first()["n"] == sorted(numbers)


def test_suffixes_and_longest_domain(spark):
    rows = spark.createDataFrame([("a.b.example.org",), ("example.org",), ("notexample.org",), (None,)], "host string")
    domains = spark.createDataFrame([("example.org", 1), ("b.example.org", 2)], "domain string, v int")
    got = {r["host"]: r["v"] for r in trust.host_suffix_join(rows, domains).collect()}
    assert got == {"a.b.example.org": 2, "example.org": 1, "notexample.org": None, None: None}


@pytest.mark.parametrize(("url", "want"), [("HTTPS://a.io/x#y", "HTTPS://a.io/x"), (" http://a.io/), ", "http://a.io/"), ("ftp://a.io", ""), (None, ""), ("", "")])
def test_normalised_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(U.normalised(F.col("u")).alias("x")).first()["x"] == want


def test_simhash_moves_little_with_furniture_and_far_with_a_rewrite(spark):
    text = " ".join(f"sentence number{chr(97 + i % 26)} tells about thing{chr(97 + i % 25)}" for i in range(60))
    near, far = H.simhash_of(text + " new banner text"), H.simhash_of(text[::-1])
    rows = spark.createDataFrame([(H.simhash_of(text), near, far)], "a string, b string, c string").select(H.distance(F.col("a"), F.col("b")).alias("near"), H.distance(F.col("a"), F.col("c")).alias("far")).first()
    assert rows["near"] <= 8 < rows["far"]
    assert H.simhash_of("two words") == ""


def test_main_text_drops_chrome(spark):
    page = "<html><head><script>var a='</p>';</script></head><body><nav>Menu</nav><p>One &amp; two</p><div>Three<br/>four</div></body>"
    assert one(spark, T.main_text(F.lit(page))) == "One & two\nThree\nfour"


def test_hits_near(spark):
    text = "acme is deprecated. " + "x" * 400 + " is retired"
    got = one(spark, T.hits_near(F.lit(text), ("is deprecated", "is retired"), F.array(F.lit("Acme"), F.lit(""))))
    assert got == ["is deprecated"]


def xlsx(sheets):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Tools</t></si><si><r><t>n8n</t></r><r><t>@2</t></r></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row>{"".join(r)}</row>' for r in rows) + "</sheetData></worksheet>")
    return buffer.getvalue()


def test_workbook_source(spark, tmp_path):
    cell = '<c r="{}" t="s"><v>{}</v></c>'
    (tmp_path / "b.xlsx").write_bytes(xlsx({"T": [[cell.format("B1", 0)], [cell.format("B2", 1), '<c r="AA2"><v>3.5</v></c>', '<c r="C2" t="inlineStr"><is><t>x</t></is></c>']]}))
    spark.dataSource.register(workbook.WorkbookSource)
    want = [("b.xlsx", "T", 1, 2, "Tools"), ("b.xlsx", "T", 2, 2, "n8n@2"), ("b.xlsx", "T", 2, 3, "x"), ("b.xlsx", "T", 2, 27, "3.5")]
    assert sorted(map(tuple, spark.read.format("workbook").load(str(tmp_path)).collect())) == want
    assert sorted(map(tuple, workbook.from_binary(spark.read.format("binaryFile").load(str(tmp_path))).collect())) == want


def test_artifacts_merge_into_today_or_the_newest_earlier_one(spark, tmp_path):
    path = str(tmp_path / "a")
    stages.write_artifact(spark.createDataFrame([("a", 1), ("b", 1)], "dep_id string, v int"), path, "2025-01-01")
    stages.merged_artifact(spark, path, "2025-01-02", spark.createDataFrame([("b", 2)], "dep_id string, v int"), spark.createDataFrame([("b",)], "dep_id string"))
    assert sorted(map(tuple, stages.latest_artifact(spark, path).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, stages.latest_artifact(spark, path, upto="2025-01-01").collect())) == [("a", 1), ("b", 1)]


def test_registry_round_trip_and_merge(spark, tmp_path):
    path = str(tmp_path / "r.json")
    (tmp_path / "r.json").write_text('{"tools": [{"kind": "tool", "canonical_name": "B", "aliases": ["x"]}, {"kind": "service", "canonical_name": "A", "vendor": "V"}]}')
    entries = snapshots.registry(spark, path)
    snapshots.save_registry(entries, path)
    again = snapshots.registry(spark, path)
    assert [r["canonical_name"] for r in again.orderBy("ord").collect()] == ["A", "B"]
    more = again.filter("kind = 'service'").withColumn("vendor", F.lit("W")).withColumn("aliases", F.array(F.lit("y")))
    got = {r["canonical_name"]: (r["vendor"], r["aliases"]) for r in snapshots.merged_entries(again, more).collect()}
    assert got == {"A": ("V", ["y"]), "B": (None, ["x"])}


def test_scope_ids_win_and_round_trip(spark):
    deps = spark.createDataFrame([("a", "tool", "critical"), ("b", "model", "standard"), ("c", "tool", "standard")], "dep_id string, kind string, watch_tier string")
    places = spark.createDataFrame([("a", "A", 1), ("b", "A", 2), ("c", "B", 1)], "dep_id string, course string, session_no int")
    pick = lambda **k: sorted(r["dep_id"] for r in resolve.Scope(**k).select(deps, places).collect())
    assert pick(dep_ids={"b"}, kinds={"tool"}) == ["b"]
    assert pick(courses={"A"}, sessions={1}) == ["a"]
    assert pick(kinds={"tool"}) == ["a", "c"]
    scope = resolve.Scope(courses={"A"}, sessions={1, 2}, limit=3)
    assert resolve.Scope.from_dict(scope.to_dict()) == scope
