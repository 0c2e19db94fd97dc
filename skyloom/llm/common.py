"""Helpers shared by the training-data operators: lineage cuts and byte-level text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space, tab, line feed, vertical tab, form feed, return).
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy code handles at a time, so that its work arrays stay in the CPU's caches.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. One is made only in a
    local session that has none (tests); on a cluster a folder of one machine would lose data."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="skyloom-ckpt-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def parts(df: DataFrame, per_part: int = 1) -> int:
    """Shuffle partitions for ``df``'s session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // per_part)


def plain_names(docs: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """``docs`` with the columns ``needed`` under these names and every other one, by its place, as
    ``__c0``, ``__c1``...; so no further column can clash with a working one, whatever its name or
    type. ``out.toDF(*docs.columns)`` names them back."""
    own = {next((k for k, c in enumerate(docs.columns) if c == n), None): n for n in needed}
    missing = [n for n in needed if n not in docs.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return docs.toDF(*[own.get(k, f"__c{k}") for k in range(len(docs.columns))])


def skew_join(rows: DataFrame, sizes: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``sizes``, one row a key with the number ``n`` of its rows (dropped here).
    Keys with more than a 25,000th of the ``total`` rows (and 512) are fewer than 25,000, so they can
    be broadcast: their rows stay where they are, and no task of the shuffle gets all rows of a key.
    ``sizes`` is read more than once and should be materialised."""
    most = max(512, total // 25_000)
    hot, cold = sizes.filter(F.col("n") > most).drop("n"), sizes.filter(F.col("n") <= most).drop("n")
    if total <= most or hot.isEmpty():
        return rows.join(sizes.drop("n"), key, how)
    names = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(names, key, "left_anti").join(cold, key, how))


def _inverse_hash(h: np.ndarray) -> np.ndarray:
    """The int column value whose Spark hash (Murmur3 of 32 bits, seed 42) is ``h``."""
    full = np.uint64(0xFFFFFFFF)
    times = lambda x, c: x * np.uint64(pow(c, -1, 1 << 32)) & full
    turn = lambda x, k: (x >> np.uint64(k) | x << np.uint64(32 - k)) & full
    h = h.astype(np.uint64)
    h = h ^ h >> np.uint64(16)
    h = times(h, 0xC2B2AE35)
    h = h ^ h >> np.uint64(13) ^ h >> np.uint64(26)
    h = times(h, 0x85EBCA6B)
    h = h ^ h >> np.uint64(16) ^ np.uint64(4)
    h = turn(times(h - np.uint64(0xE6546B64) & full, 5), 13) ^ np.uint64(42)
    return times(turn(times(h, 0x1B873593), 15), 0xCC9E2D51).astype(np.uint32).view(np.int32)


def labels(n: int) -> np.ndarray:
    """n ints that hash partitioning into n partitions sends to 0, 1, ... n - 1."""
    return _inverse_hash(np.arange(n))


#: Bytes of text that a chunk should hold.
CHUNK_BYTES = 24 << 20


def pack(rows: pa.Table | pa.RecordBatch) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between stages, and what their
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


#: Rows that are packed at a time.
PACK_ROWS = 4096


def _pack_chunks(n: int):
    names = labels(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, PACK_ROWS) for b in batches for k in range(0, b.num_rows, PACK_ROWS)):
            chunk = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(chunk, kind="stable")
            rows = batch.select(range(1, batch.num_columns)).take(pa.array(order))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk[order]) != 0])) if len(chunk) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(chunk))
            blobs = [pack(rows.slice(a, b - a)) for a, b in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names[chunk[order][cuts]], pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "rows"])
            del rows, blobs
        release()

    return run


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` dealt to chunks by a hash of id and text, and the number of chunks: one for every
    CHUNK_BYTES of text, counted, and no fewer than the session's shuffle partitions. A row of the
    result is (chunk, packed rows); all who read it share its one shuffle."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(docs), -(-size // CHUNK_BYTES))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(place.alias("__chunk"), *docs.columns).mapInArrow(_pack_chunks(n), "chunk int, rows binary").repartition(n, "chunk"), n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``limit`` bytes in column ``name`` (one row at
    least), with those bytes and the offsets of the rows."""
    data, at = utf8(batch.column(batch.schema.get_field_index(name)))
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span ``data[start:end]``; equal spans have equal hashes."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross the row offsets ``at``: their starts, ends
    and the number of runs of each row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        before |= edge[:n]
    start = np.flatnonzero(inside & before)
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
        after |= edge[1:]
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.diff(np.searchsorted(start, at))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts per row of the words in a slice."""
    return spans(~SPACE[data], at)
