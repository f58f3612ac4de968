"""Three-way merge of dataset branches by Merkle descent.

A version is a table of rows with a stable key ``row``, columns, and ``lines``: an array of (at, text), ascending. Line n of the base has
at = 2n; lines that a branch puts in after it have at = 2n + 1, the gap. ``trees`` hashes each version bottom up: lines, blocks of BLOCK
lines, text, row, in narrow rows that hold digests alone. ``merged`` then descends from the top:

1. rows are hashed into buckets of about 256, and the buckets' digests of the three versions compared: rows of equal buckets are done;
2. in the others the rows' digests meet (one shuffle of narrow rows); equal rows are done, rows that a branch added or dropped are
   decided here, by digest;
3. of rows that both branches keep, columns are compared by value and texts by block digest; equal blocks are passed over;
4. in blocks that differ, lines and gaps are merged by their stable ``at``: a change on one side, or the same on both, is taken and counted
   as clean; two different ones are a conflict, counted by kind, and take the right branch's state.

Texts move only for rows that both branches gave another text: their left and right lines are shuffled once and put together by the places
that the merge picked, in built-in functions. The base's texts never move, and nothing but counts of rows goes to the driver.

Keys are distinct within a version. Digests of lines are 64 bits and are compared only at equal places of one row, so two different
lines are taken for equal with a chance of 2**-64 a comparison; all other digests have 128 bits.

Defined cases of the query: nulls become empty first; an empty text is one empty line; a text that lost all lines is empty; a null doc_id
is named as an empty one, and the row it adds has a null id; rows that share a doc_id are merged each on its own (their added rows too,
also where such an id is in the table), and rows equal in all columns give equal rows; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _text

#: Lines of a block, the last level above lines.
BLOCK = 32
#: Rows of a bucket, about.
BUCKET = 256
COLUMNS = ("lang", "source")
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
VERSIONS = ("base", "left", "right")


def _digest(*parts: bytes) -> bytes:
    out = hashlib.blake2b(digest_size=16)
    for p in parts:
        out.update(len(p).to_bytes(8, "little"))
        out.update(p)
    return out.digest()


def block_digests(ats: list[int], leaves: bytes) -> bytes:
    """Digests of 16 bytes of blocks 0, 1, ... of a row's lines; zeros for a block without lines."""
    out, i = bytearray(), 0
    while i < len(ats):
        number = ats[i] // (2 * BLOCK)
        j = bisect_left(ats, (number + 1) * 2 * BLOCK, i)
        out += bytes(16 * number - len(out)) + _digest(repr(ats[i:j]).encode(), leaves[8 * i : 8 * j])
        i = j
    return bytes(out)


def trees(version: DataFrame, carry: list[str], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The tree of each row: text_sha256, ats, leaves (8 bytes a line), blocks (16 bytes a block), text digest and row digest."""
    line = F.transform("lines", lambda x: x["text"])
    leaf = F.array_join(F.transform("lines", lambda x: F.substring(F.sha2(x["text"].cast("binary"), 256), 1, 16)), "")
    rows = version.select("row", *carry, *columns, F.unhex(F.sha2(F.array_join(line, "\n").cast("binary"), 256)).alias("text_sha256"), F.transform("lines", lambda x: x["at"]).alias("ats"), F.unhex(leaf).alias("leaves"))
    kept, k = len(carry) + 1, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(kept + i).to_pylist() for i in range(k)]
            blocks, texts, whole = [], [], []
            for i, (ats, leaves) in enumerate(zip(batch.column(kept + k + 1).to_pylist(), batch.column(kept + k + 2).to_pylist(), strict=True)):
                blocks.append(block_digests(ats, leaves))
                texts.append(_digest(blocks[-1]))
                whole.append(_digest(*[(v[i] or "").encode() for v in values], texts[-1]))
            made = [pa.array(x, pa.binary()) for x in (blocks, texts, whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "blocks", "text_digest", "digest"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, blocks binary, text_digest binary, digest binary")


def differing_buckets(tree: DataFrame, n_buckets: int) -> DataFrame:
    """The buckets whose rows aren't the same in all versions. Digests of a bucket are sums without order, so they are combined before the shuffle."""
    bucket = F.pmod(F.xxhash64("row"), F.lit(n_buckets)).alias("bucket")
    sums = [F.bit_xor(F.when(F.col("version") == v, F.xxhash64(*cols))).alias(f"x{v}{i}") for v in range(3) for i, cols in enumerate((("row", "digest"), ("digest", "row")))]
    counts = [F.count(F.when(F.col("version") == v, F.lit(1))).alias(f"n{v}") for v in range(3)]
    same = F.lit(True)
    for name in ("n{}", "x{}0", "x{}1"):
        for v in (1, 2):
            same = same & F.col(name.format(0)).eqNullSafe(F.col(name.format(v)))
    return tree.groupBy(bucket).agg(*sums, *counts).filter(~same).select("bucket")


def merge_units(trio: list[tuple[list[int], bytes, bytes]], counts: list[int]) -> list[int]:
    """The lines of the merged text as 2 * place + (1 if right's, 0 if left's). trio: (ats, leaves, blocks) of base, left and right."""
    picks: list[int] = []
    n_blocks = max(len(t[2]) for t in trio) // 16
    right = trio[2][0]
    for number in range(n_blocks):
        lo, hi = number * 2 * BLOCK, (number + 1) * 2 * BLOCK
        b, x, y = (t[2][16 * number : 16 * number + 16] or bytes(16) for t in trio)
        if b == x == y:
            picks += [2 * i + 1 for i in range(bisect_left(right, lo), bisect_left(right, hi))]
            continue
        units: list[dict[int, tuple[int, int]]] = []
        for ats, _, _ in trio:
            own: dict[int, tuple[int, int]] = {}
            for i in range(bisect_left(ats, lo), bisect_left(ats, hi)):
                own[ats[i]] = (own[ats[i]][0] if ats[i] in own else i, i + 1)
            units.append(own)
        for at in sorted(units[0].keys() | units[1].keys() | units[2].keys()):
            places = [u.get(at, (0, 0)) for u in units]
            b, x, y = (t[1][8 * p[0] : 8 * p[1]] for t, p in zip(trio, places, strict=True))
            side = 2
            if x != b:
                if y == b:
                    side = 1
                kind = 0 if y in (b, x) else 3 if not b else 2 if not x or not y else 1
                counts[kind] += 1
            elif y != b:
                counts[0] += 1
            picks += [2 * i + side - 1 for i in range(*places[side])]
    return picks


def decide(row: list[dict | None], columns: tuple[str, ...] = COLUMNS) -> tuple[list | None, bytes | None, list[int] | None, list[int]]:
    """A row's merged columns, text_sha256 (None if it must be put together), picks of its lines, and counts. row: its trees by version."""
    base, left, right = row
    whole = lambda t: ([t[c] for c in columns], t["text_sha256"], None)
    absent = (None, None, None)
    if base is None:
        equal = left is None or right is None or left["digest"] == right["digest"]
        return *whole(right or left), [1, 0, 0, 0] if equal else [0, 0, 0, 1]
    if left is None or right is None:
        stays = left or right
        clean = stays is None or stays["digest"] == base["digest"]
        return *(absent if clean or right is None else whole(right)), [1, 0, 0, 0] if clean else [0, 0, 1, 0]
    counts, values = [0, 0, 0, 0], []
    for c in columns:
        b, x, y = base[c], left[c], right[c]
        values.append(x if y == b else y)
        if x != b or y != b:
            counts[0 if x == b or y in (b, x) else 1] += 1
    digests = [t["text_digest"] for t in row]
    if digests[0] == digests[1] == digests[2]:
        return values, right["text_sha256"], None, counts
    picks = merge_units([(t["ats"], t["leaves"], t["blocks"]) for t in row], counts)
    if digests[1] in (digests[0], digests[2]):
        return values, right["text_sha256"], None, counts
    if digests[2] == digests[0]:
        return values, left["text_sha256"], None, counts
    return values, None, picks, counts


def merged(base: DataFrame, left: DataFrame, right: DataFrame, scratch: _text.Scratch, carry: list[str], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """row, the carried columns, the merged columns, text_sha256 (binary) and counts of every row that any version has. Absent rows have nulls."""
    own = {"base": base, "left": left, "right": right}
    tree = None
    for v, name in enumerate(VERSIONS):
        t = trees(own[name], carry, columns).withColumn("version", F.lit(v))
        tree = t if tree is None else tree.unionByName(t)
    tree = scratch.write(tree, narrow=False)
    n_buckets = 1
    while n_buckets * BUCKET * 3 < tree.count():  # a number of rows
        n_buckets *= 2
    differ = scratch.write(differing_buckets(tree, n_buckets))
    kept = ["row", *carry, *columns]
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    settled, open_rows = None, tree
    if differ.count() < n_buckets:
        bucketed = tree.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)))
        settled = bucketed.filter("version = 0").join(differ, "bucket", "left_anti").select(*kept, "text_sha256", *zero)
        open_rows = bucketed.join(differ, "bucket", "left_semi")
    each = F.struct(*columns, "text_sha256", "ats", "leaves", "blocks", "text_digest", "digest")
    met = open_rows.groupBy("row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in carry], *[F.first(F.when(F.col("version") == v, each), ignorenulls=True).alias(name) for v, name in enumerate(VERSIONS)])
    k = 1 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: list[list] = [[] for _ in columns]
            shas, picks = [], []
            counts: list[list[int]] = [[] for _ in COUNTS]
            for row in zip(*(batch.column(k + v).to_pylist() for v in range(3)), strict=True):
                state, sha, picked, found = decide(list(row), columns)
                for i, out in enumerate(values):
                    out.append(state[i] if state is not None else None)
                shas.append(sha)
                picks.append(picked)
                for i, out in enumerate(counts):
                    out.append(found[i])
            arrays = [*(pa.array(v, pa.string()) for v in values), pa.array(shas, pa.binary()), pa.array(picks, pa.list_(pa.int32())), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *arrays], [*kept, "text_sha256", "picks", *COUNTS])

    kinds = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in ("row", *carry))
    schema = f"{kinds}, {', '.join(f'`{c}` string' for c in columns)}, text_sha256 binary, picks array<int>, {', '.join(f'{c} long' for c in COUNTS)}"
    decided = scratch.write(met.mapInArrow(run, schema), narrow=False)
    texts = lambda df, name: df.select("row", F.transform("lines", lambda x: x["text"]).alias(name))
    both = decided.filter("picks IS NOT NULL").drop("text_sha256").join(texts(left, "left_lines"), "row").join(texts(right, "right_lines"), "row")
    line = F.expr("transform(picks, p -> IF(p % 2 = 1, right_lines[p div 2], left_lines[p div 2]))")
    made = both.withColumn("text_sha256", F.unhex(F.sha2(F.array_join(line, "\n").cast("binary"), 256)))
    names = [*kept, "text_sha256", *COUNTS]
    out = decided.filter("picks IS NULL").select(*names).unionByName(made.select(*names))
    return out if settled is None else out.unionByName(settled.select(*names))


def code(branch: str, doc_id: Column, name: Column) -> Column:
    """What a branch does to a named part of a document."""
    return (F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), name).cast("binary")) % 7).cast("int")


def base_version(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("b"), "key").alias("row"), "doc_id", "times", *COLUMNS, F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i * 2).cast("long").alias("at"), x.alias("text"))).alias("lines"))


def branch_version(docs: DataFrame, branch: str) -> DataFrame:
    """The version of a branch: edits, drops and insertions by code."""
    own = F.col("doc_id")
    coded = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i * 2).cast("long").alias("at"), x.alias("text"), code(branch, own, i.cast("string")).alias("code")))

    def edited(x: Column) -> Column:
        """A line as an array of the lines it becomes."""
        line = lambda text, at=x["at"]: F.struct(at.alias("at"), text.alias("text"))
        none = F.array().cast("array<struct<at:bigint,text:string>>")
        changed = F.when(x["code"] == 0, none).when(x["code"] == 1, F.array(line(F.concat(x["text"], F.lit("!"))))).when(x["code"] == 2, F.array(line(F.concat(x["text"], F.lit("?")))))
        more = lambda mark: F.array(line(x["text"]), line(F.lit(mark), x["at"] + 1))
        return changed.when(x["code"] == 3, more("!")).when(x["code"] == 4, more("?")).otherwise(F.array(line(x["text"])))

    rows = docs.withColumns({"row_code": code(branch, own, F.lit("row")), "coded": coded, **{f"{c}_code": code(branch, own, F.lit(c)) for c in COLUMNS}})
    values = [F.when(F.col(f"{c}_code") == 0, F.lit("")).when(F.col(f"{c}_code") == 1, F.concat(c, F.lit("!"))).when(F.col(f"{c}_code") == 2, F.concat(c, F.lit("?"))).otherwise(F.col(c)).alias(c) for c in COLUMNS]
    kept = F.struct(F.concat(F.lit("b"), "key").alias("row"), own.alias("doc_id"), F.col("times"), *values, F.flatten(F.transform("coded", edited)).alias("lines"))
    mark = F.when(F.col("row_code") == 3, F.lit("!")).otherwise(F.lit("?"))
    added = F.struct(F.concat(F.lit("a"), "key").alias("row"), (F.lit(-1) - own).alias("doc_id"), F.col("times"), *[F.col(c) for c in COLUMNS], F.array(F.struct(F.lit(0).cast("long").alias("at"), mark.alias("text"))).alias("lines"))
    both = F.array(F.when(F.col("row_code") != 0, kept), F.when(F.col("row_code").isin(3, 4), added))
    return rows.select(F.inline(F.filter(both, lambda x: x.isNotNull())))


def keyed(docs: DataFrame, scratch: _text.Scratch) -> tuple[DataFrame, bool]:
    """doc_id, text, lang, source without nulls, a key of each row, and times: rows that are equal in all are one. And whether any id repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *COLUMNS)])
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.withColumns({"key": name, "times": F.lit(1)}), False
    content = F.sha2(F.concat_ws("|", *[F.sha2(F.col(c).cast("binary"), 256) for c in ("text", *COLUMNS)]), 256)
    one = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("times"))
    return scratch.write(one.withColumn("key", F.concat(name, F.lit(":"), content)), narrow=False), True


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, changed in two branches and merged."""
    scratch = _text.Scratch()
    docs, repeated = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
    out = merged(base_version(docs), branch_version(docs, "L"), branch_version(docs, "R"), scratch, ["doc_id", "times"])
    if repeated:
        out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("doc_id", *COLUMNS, F.lower(F.hex("text_sha256")).alias("text_sha256"), *COUNTS)


QUERIES = {"op13_branch_merge": op13_branch_merge}

_CODE = lambda branch, name: _text.crc32_sql(f"('{branch}:' || doc_id || ':' || {name})") + " % 7"
_EDIT = lambda code, value, drop: f"CASE {code} WHEN 0 THEN {drop} WHEN 1 THEN {value} || '!' WHEN 2 THEN {value} || '?' ELSE {value} END"
_UNIT = lambda b, x, y: f"CASE WHEN {x} IS NOT DISTINCT FROM {b} THEN {y} WHEN {y} IS NOT DISTINCT FROM {b} THEN {x} ELSE {y} END"
_CLEAN = lambda b, x, y: f"(({x} IS DISTINCT FROM {b} OR {y} IS DISTINCT FROM {b}) AND ({x} IS NOT DISTINCT FROM {b} OR {y} IS NOT DISTINCT FROM {b} OR {x} IS NOT DISTINCT FROM {y}))"
_CLASH = lambda b, x, y: f"({x} IS DISTINCT FROM {b} AND {y} IS DISTINCT FROM {b} AND {x} IS DISTINCT FROM {y})"

ORACLE_SQL = {
    "op13_branch_merge": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT *, {_CODE("L", "'row'")} AS lr, {_CODE("R", "'row'")} AS rr, {_EDIT(_CODE("L", "'lang'"), "lang", "''")} AS l_lang, {_EDIT(_CODE("R", "'lang'"), "lang", "''")} AS r_lang,
             {_EDIT(_CODE("L", "'source'"), "source", "''")} AS l_source, {_EDIT(_CODE("R", "'source'"), "source", "''")} AS r_source FROM d),
u AS (SELECT doc_id, unnest(lines) AS t, unnest(range(len(lines))) AS i FROM d),
v AS (SELECT doc_id, i, t, {_CODE("L", "i")} AS lc, {_CODE("R", "i")} AS rc FROM u),
w AS (SELECT doc_id, i, t, {_EDIT("lc", "t", "NULL")} AS l, {_EDIT("rc", "t", "NULL")} AS r, CASE lc WHEN 3 THEN '!' WHEN 4 THEN '?' END AS lg, CASE rc WHEN 3 THEN '!' WHEN 4 THEN '?' END AS rg FROM v),
p AS (SELECT *, CASE WHEN m IS NOT NULL OR coalesce(rg, lg) IS NOT NULL THEN concat_ws(chr(10), m, coalesce(rg, lg)) END AS piece,
             CASE WHEN r IS NOT NULL OR rg IS NOT NULL THEN concat_ws(chr(10), r, rg) END AS r_piece FROM (SELECT *, {_UNIT("t", "l", "r")} AS m FROM w)),
x AS (SELECT doc_id, sha256(coalesce(string_agg(piece, chr(10) ORDER BY i), '')) AS sha, sha256(coalesce(string_agg(r_piece, chr(10) ORDER BY i), '')) AS r_sha,
             count(*) FILTER ({_CLEAN("t", "l", "r")}) + count(*) FILTER (coalesce(lg, rg) IS NOT NULL AND (lg IS NULL OR rg IS NULL OR lg = rg)) AS clean,
             count(*) FILTER ({_CLASH("t", "l", "r")} AND l IS NOT NULL AND r IS NOT NULL) AS edit_edit, count(*) FILTER ({_CLASH("t", "l", "r")} AND (l IS NULL OR r IS NULL)) AS edit_delete,
             count(*) FILTER (lg <> rg) AS insert_insert, bool_or(l IS DISTINCT FROM t OR lg IS NOT NULL) AS l_text, bool_or(r IS DISTINCT FROM t OR rg IS NOT NULL) AS r_text FROM p GROUP BY doc_id),
y AS (SELECT *, l_text OR l_lang <> lang OR l_source <> source AS l_any, r_text OR r_lang <> lang OR r_source <> source AS r_any FROM c JOIN x USING (doc_id)),
z AS (SELECT *, CASE WHEN lr <> 0 AND rr <> 0 THEN 'merge' WHEN lr = 0 AND rr <> 0 AND r_any THEN 'right' ELSE 'none' END AS state, (lr = 0 OR rr = 0) AS dropped,
             (lr = 0 AND rr <> 0 AND r_any OR rr = 0 AND lr <> 0 AND l_any) AS torn FROM y)
SELECT doc_id, CASE state WHEN 'merge' THEN {_UNIT("lang", "l_lang", "r_lang")} WHEN 'right' THEN r_lang END AS lang,
       CASE state WHEN 'merge' THEN {_UNIT("source", "l_source", "r_source")} WHEN 'right' THEN r_source END AS source, CASE state WHEN 'merge' THEN sha WHEN 'right' THEN r_sha END AS text_sha256,
       CAST(CASE WHEN torn THEN 0 WHEN dropped THEN 1 ELSE clean + CAST({_CLEAN("lang", "l_lang", "r_lang")} AS INT) + CAST({_CLEAN("source", "l_source", "r_source")} AS INT) END AS BIGINT) AS n_clean,
       CAST(CASE WHEN dropped THEN 0 ELSE edit_edit + CAST({_CLASH("lang", "l_lang", "r_lang")} AS INT) + CAST({_CLASH("source", "l_source", "r_source")} AS INT) END AS BIGINT) AS n_edit_edit,
       CAST(CASE WHEN torn THEN 1 WHEN dropped THEN 0 ELSE edit_delete END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN dropped THEN 0 ELSE insert_insert END AS BIGINT) AS n_insert_insert
FROM z
UNION ALL
SELECT -1 - doc_id, lang, source, sha256(CASE CASE WHEN rr IN (3, 4) THEN rr ELSE lr END WHEN 3 THEN '!' ELSE '?' END),
       CAST(CASE WHEN lr IN (3, 4) AND rr IN (3, 4) AND lr <> rr THEN 0 ELSE 1 END AS BIGINT), 0, 0, CAST(CASE WHEN lr IN (3, 4) AND rr IN (3, 4) AND lr <> rr THEN 1 ELSE 0 END AS BIGINT)
FROM c WHERE lr IN (3, 4) OR rr IN (3, 4)
"""
}
