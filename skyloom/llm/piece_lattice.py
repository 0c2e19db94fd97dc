"""SentencePiece encoding and decoding by a relational lattice.

A text is normalised as the piece model does it (a leading and every other space become U+2581)
and cut into units that no piece crosses: runs of letters or runs of other characters, each with
the spaces before it. Per distinct unit of a chunk of documents (and then of the corpus), its
substrings of bounded length are exploded and equi-joined to the piece table; the edges found are
grouped by unit and a Viterbi fold (Spark's higher-order ``aggregate``) takes the best-scoring
path. Equal scores prefer the longer last piece. A character that no piece covers costs
``UNKNOWN_PENALTY`` more than the worst piece and becomes byte pieces. Units of more than
``LONGEST_UNIT`` characters (unspaced scripts, digits, separator lines) go over the same lattice in
the worker that answers for them, in time linear in their length, as the fold's is not.

The text moves once, to chunks; unit lists go to the lattice and piece ids come back packed by
(chunk, bucket), so neither the vocabulary nor any dictionary of the corpus is ever broadcast.

The model's ids, pieces and scores are used as they are. Where the model was trained as byte-pair
encoding, its own encoder merges greedily; the lattice gives the path of the best total score over
the same pieces, which may differ. Decoding is exact for both.

Defined cases: null and empty texts have no pieces and decode to ""; U+2581 in a text becomes byte pieces, so
that it isn't taken for a space and decodes as itself; runs of any length without a boundary are encoded whole;
repeated rows are encoded one by one; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import chunked, labels, pack, release, table, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Longest unit whose lattice is a relation; longer ones are walked in the worker.
LONGEST_UNIT = 256
#: Distinct words that an extracting task holds before it passes their units on.
HELD_WORDS = 1_000_000


@dataclass(frozen=True)
class Pieces:
    """A piece table. ``normal``: piece to (id, score); ``byte_ids``: id of each byte's piece."""

    texts: tuple[str, ...]
    normal: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.normal))

    @cached_property
    def unknown(self) -> float:
        return min((s for _, s in self.normal.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY


def load_pieces(path: str = MODEL) -> Pieces:
    """Read a SentencePiece model; raises ValueError where a piece crosses a unit's boundary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts = tuple(model.id_to_piece(i) for i in ids)
    normal = {texts[i]: (i, float(model.get_score(i))) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    for piece in normal:
        if len(units(piece)) > 1:
            raise ValueError(f"piece {piece!r} crosses the boundary of a unit")
    return Pieces(texts, normal, tuple(texts.index(f"<0x{b:02X}>") for b in range(256)))


@cache
def _pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Cuts texts of characters up to ``last``: the fewer ranges of letters, the faster."""
    ranges, start = [], None
    for c in range(last + 2):
        letter = c <= last and unicodedata.category(chr(c))[0] in "LM"
        if letter and start is None:
            start = c
        elif not letter and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    letters = "".join(ranges)
    return re.compile(f"{SPACE}*(?:[{letters}]+|[^{letters}{SPACE}]+)|{SPACE}+")


def units(normalised: str) -> list[str]:
    """The units of a normalised text, in order; joined they give it back."""
    return _pattern().findall(normalised)


_WORDS = re.compile(" *[^ ]+| +")


def words(text: str) -> list[str]:
    """A text's words without the one space before each of them (the model puts one before the first, too). A word
    after several spaces keeps the others, as pieces may span them. No unit crosses a word, so
    distinct words need cutting only once."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORDS.findall(" " + text)]
    return text.split(" ")


def word_units(word: str) -> list[str | None]:
    """The units of a word; None stands for a U+2581 of the text, which no piece spells."""
    if word.isalpha():  # letters only: one unit
        return [SPACE + word]
    cut = _pattern(0x7F if word.isascii() else 0xFFFF if max(word) <= "\uffff" else sys.maxunicode).findall
    if word and " " not in word and SPACE not in word:  # cut without the space: mostly ASCII, which is faster
        first, *others = cut(word)
        return [SPACE + first, *others]
    first, *others = word.split(SPACE)
    out: list[str | None] = cut(SPACE + first.replace(" ", SPACE))
    for part in others:
        out += [None, *cut(part.replace(" ", SPACE))]
    return out


def best_path(n: Column, edges: Column) -> Column:
    """Piece ids of the best path over a unit of ``n`` characters. ``edges``: every (end, short, id, score),
    ``short`` being minus the size, in this order; each position is the end of at least one. The state
    holds each position's best score and path, so one fold gives the ids."""
    node = lambda s, ids: F.struct(s.alias("s"), ids.alias("ids"))
    start = F.array(node(F.lit(0.0), F.array().cast("array<int>")))

    def step(a: Column, e: Column) -> Column:
        before = F.get(a, e["end"] + e["short"])
        score = before["s"] + e["score"]
        new = node(score, F.array_append(before["ids"], e["id"]))
        return F.when(F.size(a) <= e["end"], F.array_append(a, new)).when(
            score > F.get(a, e["end"])["s"], F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), new)
        ).otherwise(a)

    return F.get(F.aggregate(edges, start, step), n)["ids"]


def prefixes(pieces: Pieces) -> set[str]:
    return {p[:k] for p in pieces.normal for k in range(1, len(p) + 1)}


def long_path(unit: str, pieces: Pieces, starts: set[str]) -> list[int]:
    """What :func:`best_path` gives for a unit of any length. ``starts``: :func:`prefixes`."""
    n, normal, unknown = len(unit), pieces.normal, pieces.unknown
    scores, ids, sizes = array("d", [-math.inf]) * (n + 1), array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
    scores[0] = 0.0
    for start in range(n):
        # the earliest start that reaches a score has the longest last piece
        here = scores[start]
        for end in range(start + 1, n + 1):
            piece = unit[start:end]
            found = normal.get(piece)
            if found is None and end == start + 1:
                found = -1 - ord(piece), unknown
            if found is not None and here + found[1] > scores[end]:
                scores[end], ids[end], sizes[end] = here + found[1], found[0], end - start
            if piece not in starts:
                break
    out, end = [], n
    while end:
        out.append(ids[end])
        end -= sizes[end]
    return out[::-1]


def encode_units(distinct: DataFrame, pieces: Pieces, key: str) -> DataFrame:
    """(key, unit, ids) of distinct (key, unit), partitioned by ``key``. The piece table has as many
    rows as the model has pieces, which bounds what is broadcast. An id below 0 is a character
    without a piece: minus one minus its code point."""
    spark = distinct.sparkSession
    lookup = spark.createDataFrame(
        pa.table({"piece": list(pieces.normal), "id": pa.array([i for i, _ in pieces.normal.values()], pa.int32()), "score": pa.array([s for _, s in pieces.normal.values()], pa.float64())})
    )
    spans = (
        distinct.select(key, "unit", F.length("unit").alias("n"), F.monotonically_increasing_id().alias("row"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("start"))
        .select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("n") - F.col("start") + 1))).alias("size"))
        .select("*", F.substring("unit", F.col("start"), F.col("size")).alias("piece"))
    )
    edges = spans.join(F.broadcast(lookup), "piece", "left").filter("id IS NOT NULL OR size = 1").select(
        key, "row", "unit",
        F.struct(
            (F.col("start") + F.col("size") - 1).alias("end"), (-F.col("size")).alias("short"),
            F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
        ).alias("e"),
    )
    # a number names the unit while its edges are grouped: sorting numbers is cheaper than strings
    grouped = edges.groupBy("row", key).agg(F.first("unit").alias("unit"), F.collect_list("e").alias("edges"))
    return grouped.select(key, "unit", best_path(F.length("unit"), F.sort_array("edges")).alias("ids"))


def decode_ids(ids, pieces: Pieces, first_byte: dict[int, int] | None = None) -> str:
    """The text that piece ids spell, without the space that the model puts before it."""
    return spell_ids(ids, pieces, first_byte)[1:]


def spell_ids(ids, pieces: Pieces, first_byte: dict[int, int] | None = None) -> str:
    """The pieces of ids, joined: U+2581 of a piece is a space, byte pieces are the bytes of characters."""
    values = first_byte if first_byte is not None else {i: b for b, i in enumerate(pieces.byte_ids)}
    texts = pieces.texts
    if values.keys().isdisjoint(ids):
        return "".join([texts[i] for i in ids]).replace(SPACE, " ")
    return b"".join(bytes([values[i]]) if i in values else texts[i].replace(SPACE, " ").encode() for i in ids).decode("utf-8", "replace")


CHUNK_ROWS = "bucket int, chunk int, units string"


def _extract(n: int):
    buckets = labels(n).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[str]] = {}

        def flush() -> pa.RecordBatch:
            rows = []
            for chunk, found in held.items():
                split: list[list[str]] = [[] for _ in range(n)]
                for u in sorted({u for w in found for u in word_units(w) if u is not None}):
                    split[zlib.crc32(u.encode("utf-8", "surrogatepass")) % n].append(u)
                rows += [(buckets[b], chunk, " ".join(us)) for b, us in enumerate(split) if us]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["bucket", "chunk", "units"])

        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = held.setdefault(chunk, set())
                for text in unpack(rows.as_buffer()).column("text").to_pylist():
                    found.update(words(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield flush()
        yield flush()
        release()

    return run


def _spell(id_: int, byte_ids: tuple[int, ...]) -> list[int]:
    return [id_] if id_ >= 0 else [byte_ids[b] for b in chr(-1 - id_).encode("utf-8", "surrogatepass")]


def _answer(pieces: Pieces, kind: str):
    """Each chunk's units of a bucket with their piece ids as bytes of type ``kind``, and whether the
    ids decode to the unit. As texts decode unit by unit, that holds for a text if for its units."""
    byte_ids = pieces.byte_ids
    bytes_of = {i: b for b, i in enumerate(byte_ids)}

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("ids").combine_chunks()
        flat = lists.flatten().to_numpy()
        ends = np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
        width = np.dtype(kind).itemsize
        whole, paths, begin = flat.astype(kind).tobytes(), {}, 0
        for unit, end in zip(right.column("unit").to_pylist(), ends, strict=True):
            paths[unit] = whole[begin * width : end * width]
            begin = end
        missing = set(np.searchsorted(ends, np.flatnonzero(flat < 0), side="right").tolist())
        for k in missing:  # units with characters that have no piece
            paths[right.column("unit")[k].as_py()] = np.array([x for i in lists[k].as_py() for x in _spell(i, byte_ids)], kind).tobytes()
        starts = None
        for text in left.column("units").to_pylist():
            for u in text.split(" ") if len(text) > LONGEST_UNIT else ():
                if len(u) > LONGEST_UNIT and u not in paths:
                    starts = starts or prefixes(pieces)
                    paths[u] = np.array([x for i in long_path(u, pieces, starts) for x in _spell(i, byte_ids)], kind).tobytes()
        wrong = {u for u, b in paths.items() if spell_ids(np.frombuffer(b, kind).tolist(), pieces, bytes_of) != u.replace(SPACE, " ")}
        blobs = []
        for text in left.column("units").to_pylist():
            names = text.split(" ")
            columns = [pa.array(names, pa.string()), pa.array([paths[u] for u in names], pa.binary()), pa.array([u in wrong for u in names], pa.bool_())]
            blobs.append(pack(pa.RecordBatch.from_arrays(columns, names=["unit", "ids", "wrong"])))
        paths.clear()
        release()
        return pa.table({"chunk": left.column("chunk"), "paths": pa.array(blobs, pa.binary())})

    return run


class _Words(dict):
    """The ids of words as bytes, from the ``paths`` of their units; a word is cut when it is first asked for.
    ``wrong``: the words asked for that hold an ``odd`` unit, one that doesn't decode to itself."""

    def __init__(self, paths: dict[str, bytes], odd: set[str], literal: bytes):
        self.paths, self.odd, self.literal, self.wrong = paths, odd, literal, set()

    def __missing__(self, word: str) -> bytes:
        own = word_units(word)
        if self.odd and not self.odd.isdisjoint(own):
            self.wrong.add(word)
        self[word] = ids = self.paths[own[0]] if len(own) == 1 else b"".join([self.literal if u is None else self.paths[u] for u in own])
        return ids


def _assemble(kind: str, byte_ids: tuple[int, ...]):
    literal = np.array([byte_ids[b] for b in SPACE.encode()], kind).tobytes()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        paths: dict[str, bytes] = {}
        odd: set[str] = set()
        for blob in right.column("paths"):
            found = unpack(blob.as_buffer())
            paths.update(zip(found.column("unit").to_pylist(), found.column("ids").to_pylist(), strict=True))
            odd.update(found.filter(found.column("wrong")).column("unit").to_pylist())
        known = _Words(paths, odd, literal)
        out = []
        for rows in left.column("rows"):
            texts = unpack(rows.as_buffer())
            ids, same = [], []
            for text in texts.column("text").to_pylist():
                ws = words(text)
                ids.append(b"".join(map(known.__getitem__, ws)))
                same.append(known.wrong.isdisjoint(ws) if known.wrong else True)
            sizes = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
            flat = np.frombuffer(b"".join(ids), kind).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            out.append(pa.table({"doc_id": texts.column("doc_id"), "ids": lists, "n_pieces": pa.array(sizes), "round_trip": pa.array(same, pa.bool_())}))
        paths.clear()
        known.clear()
        release()
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip (the ids decode to the text) of every document."""
    pieces = load_pieces(model)
    kind = "<u2" if len(pieces.texts) <= 1 << 16 else "<u4"
    texts, n = chunked(docs.select("doc_id", "text"))
    listed = texts.mapInArrow(_extract(n), CHUNK_ROWS).repartition(n, "bucket")
    # the condition on chunk keeps all columns of the lists' shuffle, so that both readers share it
    names = F.when(F.col("chunk").isNotNull(), F.split("units", " "))
    distinct = listed.select(F.col("bucket").alias("own"), F.explode_outer(names).alias("unit")).filter(F.length("unit") <= LONGEST_UNIT).distinct()
    paths = encode_units(distinct, pieces, "own")
    answers = listed.groupBy("bucket").cogroup(paths.groupBy("own")).applyInArrow(_answer(pieces, kind), "chunk int, paths binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assemble(kind, pieces.byte_ids), "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of each row's ids."""
    pieces = load_pieces(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {i: b for b, i in enumerate(pieces.byte_ids)}
        for batch in batches:
            texts = [decode_ids(ids or [], pieces, values) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
