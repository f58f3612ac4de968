"""Three-way merge against plain Python, on odd tables and on versions of our own."""

import hashlib
import zlib

import pytest

from tidemark.llm import _text, branch_merge

SCHEMA = "doc_id long, text string, lang string, source string, row string, lines string"


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 7


def value(c, v):
    return "" if c == 0 else v + "!" if c == 1 else v + "?" if c == 2 else v


def merge_value(b, x, y):
    if x == b or y in (b, x):
        return (y if x == b else x), (0 if (x, y) == (b, b) else 1), 0
    return y, 0, 1


def row_of(doc_id, text, lang, source):
    """The merged row, then the added one if there is one, by the rules of the query, unit by unit."""
    text, lang, source = (v or "" for v in (text, lang, source))
    lines = text.split("\n")
    side = {}
    for b in "LR":
        c = [code(b, doc_id, i) for i in range(len(lines))]
        units = [(None if k == 0 else value(k, t)) if k < 3 else t for k, t in zip(c, lines)]
        gaps = [{3: "!", 4: "?"}.get(k) for k in c]
        side[b] = (units, gaps, value(code(b, doc_id, "lang"), lang), value(code(b, doc_id, "source"), source), code(b, doc_id, "row"))
    joined = lambda units, gaps: "\n".join(x for pair in zip(units, gaps) for x in pair if x is not None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    left, right = side["L"], side["R"]
    changed = {b: s[0] != lines or any(s[1]) or (s[2], s[3]) != (lang, source) for b, s in side.items()}
    out = []
    if left[4] == 0 or right[4] == 0:
        torn = (left[4] == 0 and right[4] != 0 and changed["R"]) or (right[4] == 0 and left[4] != 0 and changed["L"])
        state = (right[2], right[3], sha(joined(right[0], right[1]))) if torn and right[4] != 0 else (None, None, None)
        out.append((doc_id, *state, int(not torn), 0, int(torn), 0))
    else:
        n, values, units, gaps = [0, 0, 0, 0], [], [], []
        for k, b in ((2, lang), (3, source)):
            v, clean, clash = merge_value(b, left[k], right[k])
            values.append(v)
            n[0] += clean
            n[1] += clash
        for b, x, y, gx, gy in zip(lines, left[0], right[0], left[1], right[1]):
            v, clean, clash = merge_value(b, x, y)
            units.append(v)
            n[0] += clean
            n[2 if x is None or y is None else 1] += clash
            g, clean, clash = merge_value(None, gx, gy)
            gaps.append(g)
            n[0] += clean
            n[3] += clash
        out.append((doc_id, *values, sha(joined(units, gaps)), *n))
    marks = [{3: "!", 4: "?"}.get(s[4]) for s in (left, right)]
    if any(marks):
        equal = None in marks or marks[0] == marks[1]
        out.append((None if doc_id is None else -1 - doc_id, lang, source, sha(marks[1] or marks[0]), int(equal), 0, 0, int(not equal)))
    return out


LONG = "\n".join(f"line {i % 7}" for i in range(400))
ROWS = {
    "plain": [(i, f"a{i}\nb\n\n{i}", "en", "s") for i in range(150)],
    "nulls": [(i, None if i % 3 == 0 else "x\n\ny", None if i % 2 else "", None) for i in range(40)],
    "long": [(i, LONG, "en", "s") for i in (3, 5, 8)],
    "repeated": [(1, "a\nb", "en", "s"), (1, "a\nb", "en", "s"), (1, "a\nc", "en", "s"), (-2, "old", "de", "t"), (None, "x", "en", None), (None, "x", "en", None), (None, None, None, None)],
    "empty": [],
}


@pytest.mark.parametrize("case", ROWS)
def test_query_against_brute_force(spark, tmp_path, case):
    rows = ROWS[case]
    spark.createDataFrame([(*r, "own", "own") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in branch_merge.op13_branch_merge(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((x for r in rows for x in row_of(*r)), key=repr)


def version(spark, rows):
    """rows: {key: (lang, source, {at: [lines]})}"""
    data = [(k, a, b, [(at, t) for at in sorted(units) for t in units[at]]) for k, (a, b, units) in rows.items()]
    return spark.createDataFrame(data, "row string, lang string, source string, lines array<struct<at: long, text: string>>")


def test_versions_of_our_own(spark, monkeypatch):
    """Equal buckets and blocks are passed over; gaps of several lines; lines that the base hasn't; rows that one or both branches add."""
    monkeypatch.setattr(branch_merge, "BUCKET", 2)
    monkeypatch.setattr(branch_merge, "BLOCK", 4)
    base = {f"r{i}": ("en", "s", {2 * j: [f"{i}-{j}"] for j in range(20)}) for i in range(60)}
    left, right = dict(base), dict(base)
    change = lambda row, **units: (row[0], row[1], {**row[2], **{int(k[1:]): v for k, v in units.items()}})
    left["r1"] = change(base["r1"], _4=["L"], _7=["p", "q"], _30=[])
    right["r1"] = change(base["r1"], _4=["R"], _7=["p"], _31=["R"])
    left["r2"] = right["r2"] = change(base["r2"], _0=["same"])
    left["r3"] = ("de", "s", base["r3"][2])
    del left["r4"], right["r5"], left["r6"], right["r6"]
    right["r4"] = change(base["r4"], _0=["kept"])
    left["new"], right["new"] = ("en", "s", {0: ["l"]}), ("en", "s", {0: ["r"]})
    right["more"] = (None, "s", {0: [""], 90: ["far"]})
    scratch = _text.Scratch()
    got = {r["row"]: r for r in branch_merge.merged(version(spark, base), version(spark, left), version(spark, right), scratch, []).collect()}
    scratch.clear()
    sha = lambda row: hashlib.sha256("\n".join(t for at in sorted(row[2]) for t in row[2][at]).encode()).digest()
    assert len(got) == 62
    counts = lambda k: tuple(got[k][c] for c in branch_merge.COUNTS)
    assert counts("r1") == (2, 1, 0, 1) and bytes(got["r1"]["text_sha256"]) == sha(change(base["r1"], _4=["R"], _7=["p"], _30=[], _31=["R"]))
    assert counts("r2") == (1, 0, 0, 0) and bytes(got["r2"]["text_sha256"]) == sha(left["r2"])
    assert counts("r3") == (1, 0, 0, 0) and got["r3"]["lang"] == "de"
    assert counts("r4") == (0, 0, 1, 0) and bytes(got["r4"]["text_sha256"]) == sha(right["r4"])
    assert counts("r5") == counts("r6") == (1, 0, 0, 0) and got["r5"]["text_sha256"] is None and got["r6"]["lang"] is None
    assert counts("new") == (0, 0, 0, 1) and bytes(got["new"]["text_sha256"]) == sha(right["new"])
    assert counts("more") == (1, 0, 0, 0) and bytes(got["more"]["text_sha256"]) == sha(right["more"])
    assert all(counts(f"r{i}") == (0, 0, 0, 0) and bytes(got[f"r{i}"]["text_sha256"]) == sha(base[f"r{i}"]) for i in range(7, 60))


def test_only_differing_buckets_are_opened(spark):
    base = {f"r{i}": ("en", "s", {0: [str(i)]}) for i in range(40)}
    other = {**base, "r7": ("en", "s", {0: ["new"]})}
    tree = None
    for v, rows in enumerate((base, base, other)):
        t = branch_merge.trees(version(spark, rows), []).selectExpr("*", f"{v} AS version")
        tree = t if tree is None else tree.unionByName(t)
    assert branch_merge.differing_buckets(tree, 16).count() == 1


def test_blocks_without_lines_are_zeros():
    assert branch_merge.block_digests([], b"") == b""
    ats = [0, 2 * branch_merge.BLOCK * 3]
    blocks = branch_merge.block_digests(ats, bytes(16))
    assert len(blocks) == 64 and blocks[16:48] == bytes(32) and blocks[:16] != bytes(16)
