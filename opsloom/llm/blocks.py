"""Document blocks and the "ask" exchange that the whole-corpus text operators share.

A *block* is one row that holds a few megabytes of whole texts, compressed. Operators work a block at a
time with numpy. What they need to know about the rest of the corpus they *ask*: each block emits, for each
hash shard, one packed row of sorted distinct hashes (so a passage that a third of all documents share
costs one entry a block), a shard merges what all blocks sent, and answers each block in the order it
sent. The number of packed rows never exceeds the number of entries; shards, and the tasks that merge them,
are counted from the corpus.

Blocks are a bucketed table: all blocks that one task writes have numbers of one bucket, so writing them takes
no shuffle and one file a task (buckets are bounded, tasks are dealt to them in turn), and replies are brought to the blocks (by a bucketed join), never blocks to the
replies.

Every intermediate that later steps read is written under ``spark.checkpoint.dir`` by a ``Scratch``, so block
numbers stay fixed when executors are lost and the lineage is cut there. A lost executor while it is written
repeats its tasks only: numbers depend on the task's number and its rows' order alone. Written files do not
depend on any executor, so a later loss reads them again. Each result has a ``Scratch`` of its own.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 16_384
BLOCK_SCHEMA = "block long, n_bytes long, ids array<bigint>, lens binary, payload binary"
ASK_SCHEMA = "shard int, block long, data binary"
REPLY_SCHEMA = "block long, shard int, reply binary, hot long"
#: Buckets of a table at most; Spark refuses more than 100,000. Beyond so many tasks a bucket has several files.
MAX_BUCKETS = 65_536
#: Shards that one task merges, one after the other.
SHARDS_A_TASK = 16
#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset a new local one serves a local master (as in
    tests); on a cluster that is an error, as executors do not share a machine's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """The intermediates of one result, in one folder of the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/opsloom-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame, name: str, compression: str = "zstd", bucket: tuple[int, str] | None = None, by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back, if asked for as a table of so many buckets by a column, or in a folder for
        each value of a column. Its shuffle files go when it is written."""
        spark, name = self.spark, f"{name}_{uuid.uuid4().hex[:12]}"
        path, before = f"{self.folder}/{name}", spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", compression)
            if bucket is None:
                (writer.partitionBy(by) if by else writer).parquet(path)
                return spark.read.schema(df.schema).parquet(path)
            writer.format("parquet").bucketBy(*bucket).option("path", path).saveAsTable(f"opsloom_{name}")
            self.tables.append(f"opsloom_{name}")
            return spark.table(f"opsloom_{name}")
        finally:
            spark.conf.set(CLEANUP, before)

    def clear(self) -> None:
        """Delete everything. Only for when the result has been written out; else its files stay in the shared
        folder."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = []


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and each row's length (-1: null)."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    lens = np.diff(off)
    if column.null_count:
        lens = np.where(np.asarray(column.is_null()), -1, lens)
    return data, lens


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark's tables put these 64-bit numbers in (its ``hash`` function, remainder ``buckets``)."""

    def turn(x, n):
        return (x << np.uint32(n)) | (x >> np.uint32(32 - n))

    x = np.asarray(numbers, np.int64).view(np.uint64)
    h = np.full(len(x), 42, np.uint32)
    for half in ((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)):
        h = turn(h ^ turn(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return np.mod((h ^ (h >> np.uint32(16))).view(np.int32), buckets)


def block_numbers(task: int, buckets: int):
    """Numbers that no other task has, all of one bucket."""
    for a in range(0, 1 << 32, step := 8 * buckets + 64):
        some = (task << 32) + np.arange(a, a + step)
        yield from some[bucket_of(some, buckets) == task % buckets].tolist()


@dataclass(frozen=True)
class Blocks:
    """A corpus as a bucketed table of blocks."""

    rows: DataFrame
    buckets: int
    n_bytes: int
    scratch: Scratch

    def shards(self, bytes_a_shard: int = 8 << 20, least: int = 64) -> int:
        """Shards in proportion to the corpus; at least enough for every task slot of a small one."""
        return max(least, -(-self.n_bytes // bytes_a_shard))


def tasks_for(spark: SparkSession, shards: int) -> int:
    """Tasks that merge so many shards: by the corpus, at least the session's number, at most ``MAX_BUCKETS``."""
    return min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_TASK)))


def to_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> Blocks:
    """Pack whole texts into blocks; a text longer than a block is a block of its own. Nulls stay nulls."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    buckets = min(MAX_BUCKETS, max(1, rows.rdd.getNumPartitions()))

    def pack(batches):
        from pyspark import TaskContext

        numbers = block_numbers(TaskContext.get().partitionId(), buckets)
        for batch in batches:
            data, lens = flat(batch.column(1))
            ends = np.concatenate(([0], np.cumsum(np.maximum(lens, 0))))
            at = 0
            while at < len(lens):
                to = int(np.searchsorted(ends, ends[at] + block_bytes, "right")) - 1
                to = min(max(to, at + 1), at + BLOCK_ROWS, len(lens))
                raw = data[ends[at] : ends[to]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([next(numbers)], pa.int64()),
                        pa.array([len(raw)], pa.int64()),
                        pa.array([batch.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64())),
                        pa.array([lens[at:to].astype(np.int32).tobytes()], pa.binary()),
                        pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary()),
                    ],
                    ["block", "n_bytes", "ids", "lens", "payload"],
                )
                at = to

    scratch = scratch or Scratch(docs.sparkSession)
    table = scratch.write(rows.mapInArrow(pack, BLOCK_SCHEMA), "blocks", "none", (buckets, "block"))
    return Blocks(table, buckets, table.agg(F.sum("n_bytes")).first()[0] or 0, scratch)


class Block:
    """One block: ``buf`` is all texts with a newline after each, ``start``/``lens`` locate them in it."""

    def __init__(self, ids, lens: bytes, payload: bytes, n_bytes: int):
        self.ids, self.raw_lens = ids, np.frombuffer(lens, np.int32).astype(np.int64)
        self.lens = np.maximum(self.raw_lens, 0)
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload, max(1, n_bytes)), np.uint8)
        n = len(self.lens)
        self.start = np.concatenate(([0], np.cumsum(self.lens + 1)))[:n]
        self.buf = np.full(len(data) + n, 10, np.uint8)
        keep = np.ones(len(self.buf), bool)
        keep[self.start + self.lens] = False
        self.buf[keep] = data

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.start[i] + self.lens[i]].tobytes()


def ask(blocks: Blocks, emit, answer, name: str, shards: int, **asked: DataFrame) -> DataFrame:
    """``emit(block_no, Block, replies)`` yields (shard, bytes); ``answer(list of bytes)`` returns a list of
    reply bytes in the same order and a number that is added up as ``hot``. Returns written replies."""

    def emitted(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row["ids"], row["lens"], row["payload"], row["n_bytes"])
                out = list(emit(row["block"], b, replies_of(row)))
                if out:
                    yield pd.DataFrame({"shard": [s for s, _ in out], "block": row["block"], "data": [d for _, d in out]})

    def answered(frame):
        frame = frame.sort_values("block")
        replies, hot = answer(list(frame["data"]))
        return pd.DataFrame({"block": frame["block"].to_numpy(), "shard": frame["shard"].to_numpy(), "reply": replies, "hot": [hot] + [0] * (len(frame) - 1)})

    sent = with_replies(blocks, **asked).mapInPandas(emitted, ASK_SCHEMA)
    sent = sent.repartition(tasks_for(sent.sparkSession, shards), "shard")
    return blocks.scratch.write(sent.groupBy("shard").applyInPandas(answered, REPLY_SCHEMA), name)


def with_replies(blocks: Blocks, **asked: DataFrame) -> DataFrame:
    """Bring each block its replies; what one block gets is bounded by what it sent. The blocks stay in their
    buckets."""
    rows = None
    for tag, r in asked.items():
        r = r.select("block", F.struct(F.lit(tag).alias("tag"), "shard", "reply").alias("r"))
        rows = r if rows is None else rows.unionByName(r)
    if rows is None:
        return blocks.rows
    rows = rows.repartition(blocks.buckets, "block").groupBy("block").agg(F.collect_list("r").alias("replies"))
    return blocks.rows.join(rows, "block", "left")


def replies_of(row) -> dict[str, dict[int, bytes]]:
    out: dict[str, dict[int, bytes]] = {}
    got = row.get("replies")
    if got is not None and not isinstance(got, float):
        for r in got:
            out.setdefault(r["tag"], {})[int(r["shard"])] = r["reply"]
    return out


def map_blocks(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f(block_no, Block, replies)`` returns a pandas frame of ``schema``."""

    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                out = f(row["block"], Block(row["ids"], row["lens"], row["payload"], row["n_bytes"]), replies_of(row))
                if out is not None and len(out):
                    yield out

    return rows.mapInPandas(run, schema)


# hashes ---------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240131)
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
        if n <= 1 << 24:
            _POWERS[base] = have
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit numbers, from prefix sums. A linear form modulo 2**64: stretches of
    some patterns collide, so only for choosing and grouping what is compared afterwards."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """One for each start whose window ends within the sequence."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, np.uint64)


def find_words(buf: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``is_gap`` (a table of 256) is false."""
    gap = is_gap[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(buf)]))
    return edge[::2], edge[1::2]


#: Longest word that is hashed eight bytes at a time; longer ones are few, and hashed one by one.
LONG_WORD = 256


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, chained by ``mix`` over eight bytes at a time: no linear form of its letters, so
    that no pattern of letters makes words collide. Different seeds give independent hashes."""
    size = ends - starts
    out = mix(np.full(len(starts), BASES[seed % 3] ^ seed, np.uint64) + size.astype(np.uint64) * np.uint64(BASES[0]))
    if not len(starts):
        return out
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, more = starts[left], size[left]
    while len(left):
        part = eights[at]
        short = more < 8
        part[short] &= (np.uint64(1) << (more[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[left] = mix(out[left] ^ (part * np.uint64(BASES[1])))
        go = more > 8
        left, at, more = left[go], at[go] + 8, more[go] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest()
        out[i] = int.from_bytes(h, "little")
    return out


def hash_runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, from the words' hashes: runs of one, two, four... words are mixed pairwise,
    and two that overlap make up the rest, so this is no linear form either."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = 1
    while 2 * size <= n:
        h = mix(h[: len(h) - size] * np.uint64(BASES[0]) + h[size:])
        size *= 2
    if size < n:
        gap = n - size
        h = mix(h[: len(h) - gap] * np.uint64(BASES[2]) + h[gap:])
    return h


def table(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Bytes that part words: space and \x09-\x0D.
BLANK = table([(32, 32), (9, 13)])
#: Bytes of which no word of the second kind is made: all below \x80 but digits and lower-case letters.
NOT_ALNUM = table([(0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pack_sorted(values: np.ndarray, flags: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2**31 with a flag each, as differences of two bytes where they fit."""
    d = np.diff(values.astype(np.int64), prepend=0) * 2 + flags
    return (b"\x02" + d.astype(np.uint16).tobytes()) if len(d) == 0 or d.max() < 65536 else (b"\x04" + d.astype(np.uint32).tobytes())


def unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    d = np.frombuffer(data, np.uint16 if data[:1] == b"\x02" else np.uint32, offset=1).astype(np.int64)
    return np.cumsum(d >> 1), d & 1


def by_shard(shard: np.ndarray):
    """(shard, slice) for a sorted array of shard numbers."""
    if len(shard):
        cut = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(shard[a]), slice(int(a), int(b))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """The shard of each hash, from its upper 31 bits."""
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
