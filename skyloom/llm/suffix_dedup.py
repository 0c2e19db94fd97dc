"""Removal of repeated byte strings by a column-wise multi-document suffix construction.

Every 50-byte string belongs to the least-hashed 16-byte anchor inside it, so equal strings meet
at equal anchors with equal offsets. Runs of neighbouring strings with one anchor occurrence form a
segment of at most 84 bytes. Segments whose anchor occurs in one document only can't match and go
no further; the others, distinct within a chunk of documents and with that chunk's least
doc_id, are dealt by anchor; there, distinct ones that share no hash of a 50-byte string with another have their
answer. Per group of anchors the segments' collection Burrows-Wheeler
transform and longest common prefixes are then built column by column: each round inserts one more
symbol of every segment (from the right) into the sequence of symbols, prefixes and owners of the
round before. The sequences are files in the session's shared folder that are read and written
from end to end, block by block; a task deletes its own, and one that dies is run again with new
ones. Common prefixes of 50 and more join equal strings; the least doc_id of such a group decides
what each chunk removes.

The text moves once, to chunks; anchors travel as packed sorted numbers, segments as packed bytes.
An anchor in more than ``HOT`` documents is cut into single 50-byte strings that are dealt by
content, so no group of segments grows with a hot passage. Hashes only bring candidates together;
what is equal is decided on bytes (two 64-bit hashes identify equal segments within a chunk).

Defined cases: a null text is empty; documents shorter than 50 bytes keep everything; rows with a
null doc_id neither lose nor cause anything; rows that share a doc_id don't match each other;
matches never cross documents; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import SLICE_BYTES, chunked, labels, mix, plain_names, release, shared_folder, span_hashes, table, unpack, utf8

LENGTH, ANCHOR = 50, 16
_SPAN = LENGTH - ANCHOR + 1  # anchor positions of a string
_PLACE = np.uint64((1 << 28) - 1)  # low bits that hold a position while hashes are compared
_LOW = np.uint64((1 << 40) - 1)
#: Documents of an anchor beyond which its segments are dealt as single strings.
HOT = 200_000
#: Segments built together (and those of their last anchor).
BIN = 16384


def _slices(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    low, n = 0, len(at) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, side="right")) - 1))
        yield low, high
        low = high


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, row, anchor hash and anchor position of each segment."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none
    h = data.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < ANCHOR:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= _SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < _SPAN:
        v = np.minimum(v[: -(_SPAN - size)], v[_SPAN - size :])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(v)]
    start = np.flatnonzero(np.arange(len(v)) + LENGTH <= at[row + 1])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none
    place = (v[start] & _PLACE).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first = start[edge]
    last = np.concatenate([start[edge[1:] - 1], start[-1:]])
    return first, last, row[first], h[place[edge]], place[edge]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(44)) % np.uint64(n)).astype(np.int64)


def _pack40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(b: bytes) -> np.ndarray:
    raw = np.zeros((len(b) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel().astype(np.uint64)


# --- the column-wise construction -------------------------------------------------------------


#: Entries of a sequence that are read or written at a time.
BLOCK = 1 << 17


class Sequence:
    """The entries in order, each packed as owner << 24 | suffix length << 16 | common prefix << 8 |
    preceding symbol. They live in a file of ``folder`` (any that pyarrow opens; in a buffer where
    it opens none) that is only read and written from end to end, in blocks of BLOCK entries. A
    sequence that fits in one block is still in the block it was written from."""

    def __init__(self, folder: str):
        self.name, self.round, self.size = uuid.uuid4().hex, 0, 0
        self.files, self.folder = _store(folder)
        self.buffers: dict[str, bytes] = {}
        self.block: np.ndarray | None = None
        self.written = [False, False]

    def _path(self, k: int) -> str:
        return f"{self.folder}/{self.name}-{k & 1}"

    def blocks(self) -> Iterator[np.ndarray]:
        if self.block is not None:
            yield self.block
            return
        path = self._path(self.round)
        with pa.BufferReader(self.buffers[path]) if self.files is None else self.files.open_input_stream(path) as f:
            while len(block := f.read_buffer(8 * BLOCK)):
                yield np.frombuffer(block, np.uint64)

    def _sink(self, path: str):
        if self.files is None:
            return pa.BufferOutputStream()
        k = (self.round + 1) & 1
        again, self.written[k] = self.written[k], True
        if isinstance(self.files, fs.LocalFileSystem):  # over the round before the last, which was shorter
            return open(path, "r+b" if again else "wb", buffering=0)
        return self.files.open_output_stream(path)

    def write(self, blocks: Iterator[np.ndarray], size: int) -> None:
        """The next round's ``size`` entries; those of this round can be read until it returns."""
        if size <= BLOCK:
            self.block = np.concatenate(list(blocks))
        else:
            path = self._path(self.round + 1)
            with self._sink(path) as sink:
                for block in blocks:
                    sink.write(np.ascontiguousarray(block))
                if self.files is None:
                    self.buffers[path] = sink.getvalue()
            self.block = None
        self.round += 1
        self.size = size

    def delete(self) -> None:
        self.buffers.clear()
        for k in (0, 1):
            if self.written[k]:
                self.files.delete_file(self._path(k))


def _store(folder: str):
    """The file system of a folder and its path there; None where pyarrow opens no such file system."""
    if folder.startswith("file:") or "://" not in folder:
        files, path = fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    else:
        try:
            files, path = fs.FileSystem.from_uri(folder)
        except (OSError, ValueError, NotImplementedError):
            return None, folder
    files.create_dir(path, recursive=True)
    return files, path


_OWNER, _SIZE, _COMMON = np.uint64(24), np.uint64(16), np.uint64(8)


def _find_places(state: Sequence, asked: np.ndarray, totals: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """One pass over a round's entries. The suffix that a symbol of the entries ``asked`` (sorted) makes
    longer has its place where that symbol's occurrence is among all of them, after the ``m`` empty
    suffixes. Returned, by place: places, owners, common prefixes and whether the entry is new; an
    old entry that follows a new one with its first symbol gets a new common prefix too."""
    begin = np.cumsum(totals) - totals - totals[0] + m
    seen, least, was_new = np.zeros(256, np.int64), np.zeros(256, np.uint8), np.zeros(256, bool)
    found, at = [], 0
    for entries in state.blocks():
        n = len(entries)
        symbols, prefixes = entries.astype(np.uint8), np.zeros(n + 1, np.uint8)
        prefixes[:n] = entries >> _COMMON
        order = pc.array_sort_indices(pa.array(symbols)).to_numpy().view(np.int64)  # stable, by counting
        count = np.bincount(symbols, minlength=256)
        first = np.cumsum(count) - count
        here = np.flatnonzero(count)
        new = np.zeros(n, bool)
        lo, hi = np.searchsorted(asked, (at, at + n))
        new[asked[lo:hi] - at] = True
        new = new[order]
        after = np.empty(n, bool)
        after[1:] = new[:-1]
        after[first[here]] = was_new[here]
        t = np.flatnonzero(new | after)
        x = order[t]
        symbol = symbols[x]
        common = np.zeros(len(t), np.uint64)
        inside = t > first[symbol]
        k = np.flatnonzero(inside)
        if len(k):
            k = k[np.argsort(-x[k])]  # falling, so that reduceat has nothing to reduce in between
            bounds = np.empty(2 * len(k), np.int64)
            bounds[0::2], bounds[1::2] = order[t[k] - 1] + 1, x[k] + 1
            common[k] = np.minimum.reduceat(prefixes, bounds)[0::2].astype(np.uint64) + np.uint64(1)
        k = np.flatnonzero(~inside & (seen[symbol] > 0))  # the occurrence before is in an earlier block
        if len(k):
            common[k] = np.minimum(np.minimum.accumulate(prefixes[:n])[x[k]], least[symbol[k]]).astype(np.uint64) + np.uint64(1)
        found.append((begin[symbol] + seen[symbol] + t - first[symbol], entries[x] >> _OWNER, common, new[t]))
        at += n
        if at < state.size:  # what the next blocks need to know
            least = np.minimum(least, prefixes[:n].min())
            prefixes[n] = 255
            ends = first[here] + count[here] - 1
            least[here] = np.minimum.accumulate(prefixes[::-1])[::-1][order[ends] + 1]
            was_new[here] = new[ends]
            seen += count
    place, owner, common, new = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(place)
    return place[order], owner[order], common[order], new[order]


def _inserted(state: Sequence, place: np.ndarray, entries: np.ndarray, changed: np.ndarray, common: np.ndarray) -> Iterator[np.ndarray]:
    """The round's entries with new ``entries`` at their places, and common prefixes of ``changed`` ones."""
    point = place - np.arange(len(place))  # in the order before
    changed = changed - np.searchsorted(place, changed)
    at = 0
    for block in state.blocks():
        n = len(block)
        lo, hi = np.searchsorted(point, (at, at + n))
        a, b = np.searchsorted(changed, (at, at + n))
        out = np.empty(n + hi - lo, np.uint64)
        old = np.ones(len(out), bool)
        own = point[lo:hi] - at + np.arange(hi - lo)
        old[own] = False
        out[own] = entries[lo:hi]
        if b > a:
            block = block.copy()
            k = changed[a:b] - at
            block[k] = block[k] & ~np.uint64(0xFF00) | common[a:b] << _COMMON
        out[old] = block
        at += n
        yield out
    if np.searchsorted(point, at) < len(entries):
        yield entries[np.searchsorted(point, at) :]


def build(right: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: their common prefixes (of each with the one before),
    their strings and their lengths. ``right``: the strings as right-aligned rows of symbols above
    0. Round j inserts the suffixes of j symbols: the place of one is given by how often its first
    symbol occurs among the preceding symbols before the place of its rest. Beside the strings and
    one number a string, memory holds one block of the sequence."""
    m, width = right.shape
    columns = np.ascontiguousarray(right.T)
    state = Sequence(folder)
    try:
        state.write(iter([np.arange(m, dtype=np.uint64) << _OWNER | columns[-1]]), m)
        totals = np.bincount(columns[-1], minlength=256)
        asked = np.flatnonzero(size > 0)
        for j in range(1, int(size.max(initial=0)) + 1):
            place, owner, common, new = _find_places(state, asked, totals, m)
            row = owner[new].astype(np.int64)
            before = np.where(size[row] > j, columns[max(width - j - 1, 0)][row], 0).astype(np.uint64)
            entries = owner[new] << _OWNER | np.uint64(j) << _SIZE | common[new] << _COMMON | before
            state.write(_inserted(state, place[new], entries, place[~new], common[~new]), state.size + len(entries))
            totals += np.bincount(before.astype(np.int64), minlength=256)
            asked = place[new][before > 0]
        entries = np.concatenate(list(state.blocks()))
    finally:
        state.delete()
    return (entries >> _COMMON).astype(np.uint8), (entries >> _OWNER).astype(np.int64), (entries >> _SIZE).astype(np.uint8).astype(np.int64)


def least_documents(strings: list[bytes], document: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The least document of every LENGTH-byte string that starts in a string, and where each
    string's begin. A string of which no LENGTH-byte part has its hash again can equal no other's
    part, so only the others are put in order."""
    size = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    count = size - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(first[-1]) + np.repeat(np.arange(len(size)) * (LENGTH - 1), count)
    value = span_hashes(data, start, start + LENGTH)
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(value), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    out = np.repeat(document, count)
    kept = np.flatnonzero(np.logical_or.reduceat(again, first[:-1]))
    if len(kept):
        own = np.repeat(np.isin(np.arange(len(size)), kept), count)
        out[own] = _ordered([strings[k] for k in kept.tolist()], size[kept], document[kept], folder)
    return out, first


def _ordered(strings: list[bytes], size: np.ndarray, document: np.ndarray, folder: str) -> np.ndarray:
    """The least document of every LENGTH-byte string, from the order of all suffixes."""
    width = int(size.max())
    flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)  # UTF-8 has no byte 255
    right = np.zeros((len(strings), width), np.uint8)
    right[np.arange(width) >= (width - size)[:, None]] = flat
    prefixes, owners, lengths = build(right, size, folder)
    starts = np.flatnonzero(prefixes < LENGTH)
    group = np.cumsum(prefixes < LENGTH) - 1
    least = np.minimum.reduceat(document[owners], starts)[group]
    long = lengths >= LENGTH
    first = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
    out = np.empty(int((size - LENGTH + 1).sum()), np.int64)
    out[first[owners[long]] + size[owners[long]] - lengths[long]] = least[long]
    return out


# --- the steps ---------------------------------------------------------------------------------


def _rows_of(table_: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bytes and offsets of the rows that have an id."""
    table_ = table_.filter(pc.is_valid(table_.column("doc_id")))
    data, at = utf8(table_.column("text"))
    return table_.column("doc_id").to_numpy().astype(np.int64), data, at


def _all_rows(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([unpack(r.as_buffer()) for r in packed.column("rows")]).combine_chunks()


def _first(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _anchors(n: int):
    names = labels(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush() -> pa.RecordBatch:
            rows = []
            for chunk, found in held.items():
                h, d = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = _first(h)
                docs = np.add.reduceat(_first(h, d).astype(np.int64), np.flatnonzero(new)) if len(h) else np.zeros(0, np.int64)
                h, bucket = h[new], _bucket_of(h[new], n)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if hi > lo:
                        own = order[lo:hi]
                        rows.append((int(names[b]), chunk, _pack40(h[own] & _LOW), docs[own].astype(np.uint32).tobytes()))
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "anchors", "docs"])

        count = 0
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, data, at = _rows_of(unpack(rows.as_buffer()))
                for lo, hi in _slices(data, at):
                    _, _, row, h, _ = segments(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    held.setdefault(chunk, []).append((h, ids[lo:hi][row]))
                    count += len(h)
            if count > 1 << 23:
                yield flush()
                count = 0
        yield flush()

    return run


def _repeated(hot: int):
    def run(t: pa.Table) -> pa.Table:
        lists = [_unpack40(b) for b in t.column("anchors").to_pylist()]
        docs = np.concatenate([np.frombuffer(b, np.uint32) for b in t.column("docs").to_pylist()]).astype(np.int64)
        value, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, docs, minlength=len(value))[inverse]
        out, flags, begin = [], [], 0
        for x in lists:
            own = slice(begin, begin + len(x))
            kept = total[own] > 1
            out.append(_pack40(x[kept]))
            flags.append(np.packbits(total[own][kept] > hot).tobytes())
            begin += len(x)
        return pa.table({"bucket": t.column("bucket"), "chunk": t.column("chunk"), "anchors": pa.array(out, pa.binary()), "hot": pa.array(flags, pa.binary())})

    return run


def _contents(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the spans."""
    return span_hashes(data, first, end), span_hashes(data[::-1], len(data) - end, len(data) - first)


def _segments_of_chunk(n: int):
    tags = labels(n)
    number = {int(x): k for k, x in enumerate(tags)}

    def run(key, texts: pa.Table, dup: pa.Table) -> pa.Table:
        ids, data, at = _rows_of(_all_rows(texts))
        names = ("bucket", "chunk", "sizes", "text", "docs", "anchors", "hash", "single")
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        keys, hots = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for b, anchors, hot in zip(*(dup.column(c).to_pylist() for c in ("bucket", "anchors", "hot")), strict=True):
            low = _unpack40(anchors)
            keys.append(low | np.uint64(number[b]) << np.uint64(40))
            hots.append(np.unpackbits(np.frombuffer(hot, np.uint8), count=len(low)).astype(bool))
        keys, hots = np.concatenate(keys), np.concatenate(hots)
        order = np.argsort(keys)
        keys, hots = keys[order], hots[order]
        found: list[tuple] = []
        for lo, hi in _slices(data, at) if len(keys) else ():
            part, offsets = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            first, last, row, h, _ = segments(part, offsets)
            own = (h & _LOW) | _bucket_of(h, n).astype(np.uint64) << np.uint64(40)
            k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[k] == own
            first, last, row, own, hot = first[hit], last[hit], row[hit], own[hit], hots[k[hit]]
            alone = np.zeros(len(own), bool)
            if hot.any():  # as single strings, dealt by content
                count = (last - first + 1)[hot]
                single = np.repeat(first[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row = np.concatenate([row[~hot], np.repeat(row[hot], count)])
                value = mix(span_hashes(part, single, single + LENGTH))
                own = np.concatenate([own[~hot], (value & _LOW) | _bucket_of(value, n).astype(np.uint64) << np.uint64(40)])
                first, last = np.concatenate([first[~hot], single]), np.concatenate([last[~hot], single])
                alone = np.arange(len(own)) >= (~hot).sum()
            h1, h2 = _contents(part, first, last + LENGTH)
            found.append((own, h1, h2, ids[lo:hi][row], first + at[lo], last + LENGTH + at[lo], alone))
        rows = []
        if found:
            own, h1, h2, doc, first, end, alone = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, h2, h1, own))
            order = order[_first(own[order], h1[order], h2[order])]  # of equal segments that of the least document
            bucket = (own[order] >> np.uint64(40)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                k = order[lo:hi]
                if hi > lo:
                    text = b"".join([data[a:e].tobytes() for a, e in zip(first[k].tolist(), end[k].tolist(), strict=True)])
                    rows.append((int(tags[b]), key[0].as_py(), (end - first)[k].astype(np.uint8).tobytes(), text, doc[k].tobytes(), (own[k] & _LOW).tobytes(), h1[k].tobytes(), alone[k].astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)})

    return run


def _decide(t: pa.Table, folder: str) -> pa.Table:
    """Per chunk: hashes, least documents and removal bits of its segments in this bucket."""
    sizes = [np.frombuffer(b, np.uint8).astype(np.int64) for b in t.column("sizes").to_pylist()]
    size, text = np.concatenate(sizes), b"".join(t.column("text").to_pylist())
    doc, anchor = (np.concatenate([np.frombuffer(b, d) for b in t.column(c).to_pylist()]) for c, d in (("docs", np.int64), ("anchors", np.uint64)))
    end = np.cumsum(size)
    begin = end - size
    strings: dict[bytes, int] = {}
    member = np.empty(len(size), np.int64)
    order = np.argsort(anchor, kind="stable")
    bits = np.zeros(len(size), np.uint64)
    held: list[int] = []

    def close() -> None:
        least_own = np.full(len(strings), np.iinfo(np.int64).max)
        rows = np.array(held, np.int64)
        np.minimum.at(least_own, member[rows], doc[rows])
        least, first = least_documents(list(strings), least_own, folder)
        count = size[rows] - LENGTH + 1
        begin_at = np.cumsum(count) - count
        offset = np.arange(count.sum()) - np.repeat(begin_at, count)
        lower = least[np.repeat(first[member[rows]], count) + offset] < np.repeat(doc[rows], count)
        bits[rows] = np.bitwise_or.reduceat(lower.astype(np.uint64) << offset.astype(np.uint64), begin_at)
        strings.clear()
        held.clear()

    previous = None
    for r in order.tolist():
        if previous is not None and anchor[r] != previous and len(strings) >= BIN:
            close()
        previous = anchor[r]
        member[r] = strings.setdefault(text[begin[r] : end[r]], len(strings))
        held.append(r)
    if held:
        close()
    out, at = [], 0
    for s in sizes:
        out.append(bits[at : at + len(s)].tobytes())
        at += len(s)
    return pa.table({"chunk": t.column("chunk"), "hash": t.column("hash"), "docs": t.column("docs"), "bits": pa.array(out, pa.binary()), "single": t.column("single")})


def _covered(data: np.ndarray, at: np.ndarray, ids: np.ndarray, decided: tuple[np.ndarray, ...], single: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which bytes of a slice are removed: by whole segments and, in hot ones, by single strings.
    Both are lists of hashes (sorted), least documents and bits."""
    change = np.zeros(len(data) + 1, np.int32)
    first, last, row, _, _ = segments(data, at)

    def mark(start: np.ndarray, stop: np.ndarray, row: np.ndarray, hashes: np.ndarray, least: np.ndarray, bits: np.ndarray) -> None:
        if not len(hashes):
            return
        value = span_hashes(data, start, stop)
        k = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        hit = np.flatnonzero(hashes[k] == value)
        k, a, count = k[hit], start[hit], (stop - start)[hit] - LENGTH + 1
        own = np.where(ids[row[hit]] > least[k], np.uint64((1 << 63) | ((1 << 63) - 1)), bits[k])
        spread = np.repeat(np.arange(len(hit)), count)
        offset = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
        gone = (own[spread] >> offset.astype(np.uint64)) & np.uint64(1) > 0
        begin = a[spread][gone] + offset[gone]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + LENGTH, -1)

    mark(first, last + LENGTH, row, *decided)
    if len(single[0]):
        count = last - first + 1
        start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        mark(start, start + LENGTH, np.repeat(row, count), *single)
    return np.cumsum(change[:-1]) > 0


def _apply(digest: bool):
    def run(key, packed: pa.Table, decided: pa.Table) -> pa.Table:
        texts = _all_rows(packed)
        blobs = [b"".join(decided.column(c).to_pylist()) for c in ("hash", "docs", "bits", "single")]
        lists = [np.frombuffer(b, t) for b, t in zip(blobs, (np.uint64, np.int64, np.uint64, np.uint8), strict=True)]
        order = np.argsort(lists[0])
        whole, single = (tuple(x[order[lists[3][order] == k]] for x in lists[:3]) for k in (0, 1))
        has_id = texts.column("doc_id").is_valid().to_numpy()
        ids = texts.column("doc_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
        has_text = texts.column("text").is_valid().to_numpy()
        data, at = utf8(texts.column("text"))
        out: list[tuple] = []
        for lo, hi in _slices(data, at):
            part, offsets = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            gone = _covered(part, offsets, ids[lo:hi], whole, single)
            for r in range(hi - lo):
                a, b = offsets[r], offsets[r + 1]
                g = gone[a:b] if has_id[lo + r] else np.zeros(b - a, bool)
                kept = part[a:b][~g].tobytes()
                if digest:
                    runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((int(b - a), int(g.sum()), runs, hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((kept.decode("utf-8", "ignore") if has_text[lo + r] else None,))
        release()
        columns = list(zip(*out, strict=True))
        if digest:
            names, types = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, t) for c, t in zip(columns or [()] * 4, types, strict=True)]
            return pa.table([texts.column("doc_id"), *made], names=["doc_id", *names])
        made = pa.array(columns[0] if columns else (), pa.string())
        return texts.set_column(texts.column_names.index("text"), "text", made)

    return run


def _removal(docs: DataFrame, digest: bool, hot: int) -> DataFrame:
    texts, n = chunked(docs)
    folder = f"{shared_folder(docs.sparkSession)}/strings-{uuid.uuid4().hex}"
    listed = texts.mapInArrow(_anchors(n), "bucket int, chunk int, anchors binary, docs binary").repartition(n, "bucket")
    repeated = listed.groupBy("bucket").applyInArrow(_repeated(hot), "bucket int, chunk int, anchors binary, hot binary").filter("length(anchors) > 0")
    dealt = texts.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(
        _segments_of_chunk(n), "bucket int, chunk int, sizes binary, text binary, docs binary, anchors binary, hash binary, single binary"
    )
    decided = dealt.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _decide(t, folder), "chunk int, hash binary, docs binary, bits binary, single binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else docs.schema
    return texts.groupBy("chunk").cogroup(decided.groupBy("chunk")).applyInArrow(_apply(digest), schema)


def removed_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every document."""
    return _removal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), True, hot)


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with their kept bytes as text (a character that lost some of its bytes goes whole; a
    null text stays null) and, where there is such a column, n_chars of that text."""
    needed = ("doc_id", "text", *(c for c in ("n_chars",) if c in docs.columns))
    out = _removal(plain_names(docs, needed), False, hot)
    if "n_chars" in needed:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))
