"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Documents with equal shingle sets form a class; only classes are joined. Signatures of
``BANDS`` x ``ROWS`` minima are shuffled on band hashes. A pair of similarity s meets in some band
with probability 1 - (1 - s**ROWS)**BANDS: 99.7 % at 0.8, over 99.99 % at 0.87. Classes that
share a band (directly or over others) form a candidate component; a component is cut into blocks
of about ``BLOCK`` classes and every pair of its blocks is one group of rows. Full n-gram sets
are intersected tile by tile. A group gives each of its classes one row: the number of documents it
is similar to and its root in a spanning forest of the similar pairs, so nothing grows with the
number of pairs, and no bucket is capped. Hot bands, classes, components and hubs are joined by
broadcast of the few keys that are hot (``common.skew_join``).

Defined cases: words are compared as they are; a text of one to four words has one shingle of all
its words; texts without words (null, empty) have equal, empty sets and form one class; repeated
rows are copies; null ids are kept, in class_id only where a whole class has none; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import cut, mix, plain_names, skew_join, slices, span_hashes, table, words
from skyloom.llm.components import components

SHINGLE = 5
#: similar where intersection / union >= 4 / 5
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 8
BLOCK, TILE = 8192, 512

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of a slice and where each row's begin (n rows + 1)."""
    start, end, counts = words(data, at)
    h = span_hashes(data, start, end)
    first = np.concatenate([[0], np.cumsum(counts)])
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(counts)), size)
    place = first[row] + np.arange(begin[-1]) - begin[row]
    last = first[row + 1]
    total = np.zeros(len(row), np.uint64)
    for k in range(n):
        inside = place + k < last
        total = mix(total * np.uint64(5) + np.where(inside, h[np.minimum(place + k, max(0, len(h) - 1))], np.uint64(k)) if len(h) else total)
    return total, begin


def _distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(begin) - 1))])


def _keys(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """A 128-bit value of each row's set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(c)))]) for c in (0x1234567, 0x7654321FEDCBA)]
    size = np.diff(begin).astype(np.uint64)
    halves = [mix(s[begin[1:]] - s[begin[:-1]] + size * np.uint64(k + 1)) for k, s in enumerate(sums)]
    return [bytes(x) for x in np.stack(halves, 1).astype(">u8").view(np.uint8).reshape(len(begin) - 1, 16)]


def band_hashes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows x BANDS hashes of the minima; all zero for rows without shingles."""
    n = len(begin) - 1
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((n, BANDS), np.uint64)
    if len(full):
        low = (h >> np.uint64(32)).astype(np.uint32)
        minima = np.stack([np.minimum.reduceat(low * a + b, begin[:-1][full]) for a, b in zip(_A, _B, strict=True)], 1).astype(np.uint64)
        total = np.tile(np.arange(BANDS, dtype=np.uint64), (len(full), 1))
        for r in range(ROWS):
            total = mix(total * np.uint64(31) + minima[:, r::ROWS])
        out[full] = total
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in slices(batch, "text"):
            h, begin = _distinct(*shingles(data, at))
            bands = band_hashes(h, begin).view(np.int64)
            empty = np.diff(begin) == 0
            offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[~empty].ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(_keys(h, begin), pa.binary()), lists], names=["doc_id", "text_hash", "k", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in slices(batch, "text"):
            h, begin = _distinct(*shingles(data, at))
            right = np.array([a == b for a, b in zip(_keys(h, begin), part.column("k").to_pylist(), strict=True)], bool)
            blobs = pa.array([h[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("groups"), part.column("k"), part.column("copies"), blobs], names=["groups", "k", "copies", "shingles"]).filter(pa.array(right))


def similar_tiles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, matrix of similar pairs) for all pairs of ``left`` x ``right`` (indices sorted by
    set size; where they are the same, each unordered pair is in one tile). Tiles hold at most
    TILE x TILE pairs; those whose sizes rule similarity out are skipped."""
    code = np.unique(np.concatenate([sets[i] for i in np.union1d(left, right)] or [np.zeros(0, np.uint64)]))
    coded = {int(i): np.searchsorted(code, sets[i]) for i in np.union1d(left, right)}
    size = np.array([len(s) for s in sets])
    place = np.zeros(len(code), np.int64)

    def dense(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), np.float32)
        wanted = np.zeros(len(code), bool)
        wanted[columns] = True
        place[columns] = np.arange(len(columns))
        for k, i in enumerate(rows):
            c = coded[int(i)]
            out[k, place[c[wanted[c]]]] = 1
        return out

    same = left is right
    tiles = [[x[k : k + TILE] for k in range(0, len(x), TILE)] for x in (left, right)]
    present = []
    for side in tiles[: 1 if same else 2]:
        present.append([np.unique(np.concatenate([coded[int(i)] for i in t])) for t in side])
    for p, a in enumerate(tiles[0]):
        for q, b in enumerate(tiles[1]):
            if same and q < p:
                continue
            low, high = sorted(((size[a].min(), size[a].max()), (size[b].min(), size[b].max())))
            if DENOMINATOR * low[1] < NUMERATOR * high[0]:
                continue
            columns = np.intersect1d(present[0][p], present[-1][q], assume_unique=True)
            common = np.zeros((len(a), len(b)), np.float32)
            for k in range(0, len(columns), 8192):
                x = dense(a, columns[k : k + 8192])
                common += x @ (x if same and p == q else dense(b, columns[k : k + 8192])).T
            similar = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size[a][:, None] + size[b][None, :])
            if same and p == q:
                np.fill_diagonal(similar, False)
            if similar.any():
                yield a, b, similar


def _verify_group(side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a group: the documents it is similar to and the least row it is connected to. Rows
    of two blocks (sides 0 and 1) are compared across, those of one block (side 0) with each other."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    lows, highs = order[side[order] == 0], order[side[order] == 1]
    left, right = (lows, highs) if len(highs) else (order, order)
    links, root, kept = np.zeros(len(sets), np.int64), np.arange(len(sets)), []
    for a, b, m in similar_tiles(sets, left, right):
        links[a] += m @ copies[b]
        if not np.array_equal(a, b):
            links[b] += m.T @ copies[a]
        kept.append((a, b, m.shape, np.packbits(m)))
    moved = True
    while moved:
        before = root.copy()
        for a, b, shape, bits in kept:
            m = np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool)
            far = len(sets)
            root[a] = np.minimum(root[a], np.where(m, root[b][None, :], far).min(axis=1))
            root[b] = np.minimum(root[b], np.where(m, root[a][:, None], far).min(axis=0))
        root = root[root]
        moved = not np.array_equal(root, before)
    return links, root


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, low, high); a group may run over several batches."""
    held: dict[bytes, tuple] = {}
    group = None
    out: list[tuple[bytes, bytes, int]] = []

    def close() -> None:
        if len(held) > 1 and (group[1] == group[2] or len({r[0] for r in held.values()}) == 2):  # one block alone is compared elsewhere
            names, rows = list(held), list(held.values())
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            links, root = _verify_group(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), sets)
            out.extend((k, names[t], int(n)) for k, n, t in zip(names, links, root, strict=True) if n)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        k, root, links = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(root, pa.binary()), pa.array(links, pa.int64())], names=["k", "local", "links"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "low", "high", "k", "side", "copies", "shingles")]
        for r, low, high, k, *row in zip(*columns, strict=True):
            if (r, low, high) != group:
                close()
                held, group = {}, (r, low, high)
            held.setdefault(k, tuple(row))  # rows of one id and text come more than once
        if out:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def _groups(found: DataFrame) -> DataFrame:
    """(k, groups) of the classes in a component: the groups (root, low, high, side) that compare it. A class
    is in one block of its component, and in one group with each of the component's blocks."""
    sizes = cut(found.groupBy("root").agg(F.count("*").alias("n")))
    n_found = sizes.agg(F.sum("n")).first()[0] or 0
    members = skew_join(found.withColumnRenamed("node", "k"), sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "root", n_found)
    members = members.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    group = lambda j: F.struct(F.col("root"), F.least("block", j).alias("low"), F.greatest("block", j).alias("high"), (F.col("block") > j).cast("int").alias("side"))
    return members.select("k", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), group).alias("groups"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (least id of its group of similar documents, linked directly
    or over others), n_links (other documents of similarity 0.8 or more, copies included), n_copies
    (documents with the same shingle set, itself included), a hash of its text and the group's key."""
    docs = docs.select("doc_id", "text")
    signed = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_signatures, "doc_id long, text_hash long, k binary, bands array<long>"))
    classes = cut(signed.groupBy("k").agg(F.count("*").alias("copies"), F.min("doc_id").alias("lead"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.any_value("bands").alias("bands")))
    n_classes, n_docs = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    banded = classes.select("k", F.explode("bands").alias("h"))
    buckets = cut(banded.groupBy("h").agg(F.min("k").alias("m"), F.count("*").alias("n")).filter("n > 1"))
    stars = skew_join(banded, buckets, "h", n_classes * BANDS).filter("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))
    members = _groups(cut(components(stars))).join(classes.select("k", "one", "copies"), "k")
    same = docs["doc_id"].eqNullSafe(members["one"]["doc_id"]) & (F.xxhash64(docs["text"]) == members["one"]["text_hash"])
    sets = docs.join(members, same).select("text", "groups", "k", "copies").mapInArrow(
        _sets, "groups array<struct<root:binary,low:int,high:int,side:int>>, k binary, copies long, shingles binary"
    )
    grouped = sets.select(F.inline("groups"), "k", "copies", "shingles").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "k")
    verified = cut(grouped.mapInArrow(_verify, "k binary, local binary, links long"))
    links = verified.groupBy("k").agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("k").alias("a"), F.col("local").alias("b")))
    placed = classes.select("k", "lead", "copies").join(links, "k", "left").join(groups.withColumnRenamed("node", "k"), "k", "left")
    placed = cut(placed.withColumn("root", F.coalesce("root", "k")))
    leads = cut(placed.groupBy("root").agg(F.min("lead").alias("class_id"), F.count("*").alias("n")))
    named = skew_join(placed, leads, "root", n_classes).select("k", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    named = cut(named.withColumn("n", F.col("n_copies")))
    return skew_join(signed.select("doc_id", "text_hash", "k"), named, "k", n_docs).select("doc_id", "class_id", "n_links", "n_copies", "text_hash", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of similar documents one row
    stays, that with the least (doc_id, text hash), nulls first; of its repeated rows that with the
    least JSON form."""
    plain = plain_names(docs, ("doc_id", "text"))
    judged = ngram_join(plain)
    rows = judged.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("r"))
    keys = least.select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"), F.col("r.n").alias("__n"))
    kept = plain.join(keys, plain["doc_id"].eqNullSafe(keys["__id"]) & (F.xxhash64(plain["text"]) == keys["__hash"]))
    row = F.struct(*plain.columns)
    again = kept.filter("__n > 1").groupBy("__id", "__hash").agg(F.min_by(row, F.to_json(row)).alias("r"))
    return kept.filter("__n = 1").select(*plain.columns).unionByName(again.select("r.*")).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
