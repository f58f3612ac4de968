"""Vectorised text work on the UTF-8 bytes of Arrow columns, and the shared working folder.

White space is the six ASCII characters of ``[\\x20\\x09-\\x0D]``; a word is a run of anything else.
All functions take whole texts. They work on blocks of bounded size, so memory doesn't follow the batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

BLOCK_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, however long the rows are: batches by row count alone grow with the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees; where that is unset, it is set once for a local session."""
    bound_batches(spark)
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/tidemark-checkpoints"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Bytes of a table below which a part of it isn't worth a task, a Python worker's start and a file of its own.
PART_BYTES = 64 << 20


def compacted(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """df in no more parts than one for every PART_BYTES of ``like`` (of itself, if not given) or six a core, whichever is more. No shuffle."""
    size = int(str((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(6 * max(2, df.sparkSession.sparkContext.defaultParallelism), -(-size // PART_BYTES)), 1 << 24))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; one that is scanned in fewer parts than there are cores (one row group, say) is dealt out, for work that is heavy a row."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame) -> DataFrame:
    """Rows of a few numbers, which need no more parts than two a core, however many they come in. No shuffle."""
    return df.coalesce(2 * max(4, df.sparkSession.sparkContext.defaultParallelism))


def materialise(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and lost executors lose nothing. narrow: as ``few``."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (few(df) if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    spark = spark or df.sparkSession  # type: ignore[union-attr]
    jvm = spark.sparkContext._jvm
    paths = [df] if isinstance(df, str) else sorted({p.rsplit("/", 1)[0] for p in df.inputFiles()})
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written on the way to a result, deleted together once that is written."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame, narrow: bool = True) -> DataFrame:
        self.held.append(materialise(df, narrow))
        return self.held[-1]

    def clear(self) -> None:
        while self.held:
            remove(self.held.pop())

    def result(self, df: DataFrame) -> DataFrame:
        """A narrow result, written; then all that it was made from is deleted. For tables that hold texts or ids once more."""
        df = materialise(df, narrow=True)
        self.clear()
        return df


#: A key is hot when it has more than this part of all rows; so fewer than this many keys are.
HOT = 1024


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], many: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row a key and in ``many`` how many of the rows have it (the column is dropped).

    A key with more than a 1024th of all rows would land in one task. There are fewer than 1024 of these at any input size, so they are
    collected and joined by broadcast, wherever their rows are; the other keys are shuffled. keyed is read three times: write it first.
    """
    hot = (F.col(many) * HOT > keyed.agg(F.sum(many)).scalar()) & (F.col(many) > 1)
    few = keyed.filter(hot).drop(many).collect()  # fewer than HOT rows
    keyed = keyed.drop(many)
    if not few:
        return rows.join(keyed, on, how)
    named = F.broadcast(rows.sparkSession.createDataFrame(few, keyed.schema))
    names = named.select(*on)
    return rows.join(named, on).unionByName(rows.join(names, on, "left_anti").join(keyed.join(names, on, "left_anti"), on, how))


def maybe_in(keys: DataFrame, most_bits: int = 1 << 26) -> Callable[[Column], Column]:
    """A test whether a long may be among keys (one long column): never false for one that is, seldom true for one that isn't.

    It is a bitmap of at most ``most_bits`` (8 MB) whatever the number of keys, so it may be sent to all tasks; with more keys it only
    says yes more often. Callers join what it lets through exactly; it spares the others' texts a shuffle. The bitmap is a scalar
    subquery and the test is built-in functions, so rows with long texts never wait for a Python worker.
    """
    spark = keys.sparkSession
    bits = 1 << 16
    while bits < min(most_bits, 12 * keys.count()):
        bits *= 2
    places = lambda key: [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)).cast("int") for i in range(4)]
    one = F.lit(1).cast("long")
    marked = keys.select(F.explode(F.array(*places(F.col(keys.columns[0])))).alias("place"))
    words = marked.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("place") % 64)).alias("bits"))
    table = words.toPandas()  # at most most_bits / 64 rows
    bitmap = np.zeros(bits >> 6, dtype=np.int64)
    bitmap[table["word"].to_numpy()] = table["bits"].to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, len(bitmap)], pa.int32()), pa.array(bitmap))
    held = spark.createDataFrame(pa.table({"bitmap": row})).scalar()

    def test(key: Column) -> Column:
        out = F.lit(True)
        for place in places(key):
            word = F.element_at(held, (F.shiftright(place, 6) + 1).cast("int"))
            out = out & (F.call_function("shiftright", word, place % 64).bitwiseAND(one) == 1)
        return out

    return test


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its offsets; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(raw: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, last row + 1, bytes, offsets). A longer text makes a run of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def words(raw: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of the first word at or after its start (one more entry than texts).

    cuts: places where a word ends and the next begins without white space between.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[raw]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    if cuts is not None:
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Bytes from which a word gets a cryptographic hash: sums modulo 2**64 of long words can be made equal for any base (Thue-Morse words).
LONG_WORD = 64


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Short ones: differences of a polynomial prefix sum, moved to a common origin, mixed with the length.

    Long ones, of which a text has at most one in LONG_WORD bytes: BLAKE2b of their bytes.
    """
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(ends - starts >= LONG_WORD)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        h[long] = [int.from_bytes(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8).digest(), "little") for i in long]
    return h


def spread(counts: np.ndarray) -> np.ndarray:
    """Row numbers repeated by their counts: [2, 0, 1] gives [0, 0, 2]."""
    return np.repeat(np.arange(len(counts)), counts)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string, for oracles: bit by bit, since DuckDB has no such function."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda nth: CAST(ascii(substr({text}, CAST(nth AS INTEGER), 1)) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), CAST(4294967295 AS BIGINT))"
