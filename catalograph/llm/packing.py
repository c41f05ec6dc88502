"""Packing token sequences: best-fit decreasing over windows of a fixed length.

Documents are encoded and cut: every full window of an overlong document is a piece of its own, the rest is one shorter piece.
Pieces are dealt by hash to packing groups of bounded size and each group is packed by itself, longest piece first, into the open
window with the least room that still takes it. The open windows hang in a segment tree indexed by the room they have left.
A group leaves a few windows open, so padding does not grow with the number of groups beyond that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from catalograph.llm.encoder import encoder
from catalograph.llm.tables import steps, text_or_empty, written

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 2048
END = 1
GROUP = 30_000  # pieces packed together: bounds a task's memory

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class OpenWindows:
    """Windows by remaining room; a segment tree over the rooms 0..capacity tells which are in use."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.used = np.zeros(2 * self.leaves, dtype=bool).tolist()
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def tightest(self, need: int) -> int | None:
        """The least room >= need that some window has."""
        i, used = need + self.leaves, self.used
        if not used[i]:
            while i > 1 and (i & 1 or not used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if used[2 * i] else 2 * i + 1
        return i - self.leaves

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        i = room + self.leaves
        while i and not self.used[i]:
            self.used[i] = True
            i >>= 1

    def take(self, room: int) -> int:
        window = self.windows[room].pop()
        if not self.windows[room]:
            i = room + self.leaves
            self.used[i] = False
            while i > 1 and not self.used[i ^ 1]:
                i >>= 1
                self.used[i] = False
        return window


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; `lengths` come in descending order."""
    tree, window, offset, made = OpenWindows(capacity), [], [], 0
    for n in lengths:
        room = tree.tightest(n)
        if room is None:
            room, at, made = capacity, made, made + 1
        else:
            at = tree.take(room)
        window.append(at)
        offset.append(capacity - room)
        if room > n:
            tree.put(room - n, at)
    return window, offset


def cut_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW,
               end: int = END) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, salt): each document's ids with the end id, cut into full windows and a rest.

    A null text is empty: one piece that holds the end id. `salt` counts pieces within a task, to tell repeated rows apart.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, salt = encoder(vocabulary), end.to_bytes(4, "little"), 0
        for b in steps(batches):
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.packed(t) + tail
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s: 4 * (s + window)]
                    at.append(i)
                    out.append((s, len(part) // 4, zlib.crc32(part), n, salt))
                    salt += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {PIECE}, salt bigint").withColumnRenamed("key", key)


def assign_windows(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length` of at most `window`.

    `pieces` is read twice (count, then pack), so it should be a written table. An empty table gives an empty result. Ties in length
    go by the other columns. A group is one sorted run of a partition, read in batches; memory follows `group`.
    """
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns
    ordered = (pieces.withColumn("grp", F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int"))
               .repartition(max(1, min(groups, 100_000)), "grp").sortWithinPartitions("grp", F.desc("length"), *names))

    def pack(grp: int, run: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(run).combine_chunks()
        seq, offset = best_fit(t["length"].to_pylist(), window)
        t = t.drop_columns(["grp"]).append_column("sequence_id", pa.array(np.array(seq, "i8") + (grp << 32)))
        return t.append_column("offset", pa.array(offset, pa.int64())).to_batches()[0]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            grp = np.asarray(b.column(b.num_columns - 1))
            cuts = [0, *(np.nonzero(np.diff(grp))[0] + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now is not None and grp[lo] != now:
                    yield pack(now, held)
                    held = []
                now = int(grp[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pack(now, held)

    schema = ordered.drop("grp").schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    return ordered.select(*names, "grp").mapInArrow(go, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, window: int = WINDOW,
         end: int = END, group: int = GROUP) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in exactly one piece."""
    pieces = written(cut_pieces(docs, key, text, vocabulary, window, end), "pieces")
    return assign_windows(pieces, window, group).drop("salt")


def sequences(docs: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
              end: int = END) -> DataFrame:
    """(sequence_id, ids): the packed windows with their ids, unpadded. `key` must be unique in `docs`.

    A sequence is gathered in one group; it holds `window` ids at most.
    """
    wanted = packed.groupBy(key).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    rows = docs.select(F.col(key), text_or_empty(text).alias("text")).join(wanted, key).select("text", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(vocabulary), end.to_bytes(4, "little")
        for b in steps(batches):
            seq, offset, ids = [], [], []
            for t, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                all_ids = np.frombuffer(enc.packed(t) + tail, "<u4").astype("i4")
                for p in pieces:
                    seq.append(p["sequence_id"])
                    offset.append(p["offset"])
                    ids.append(all_ids[p["start"]: p["start"] + p["length"]])
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(offset, pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    parts = rows.mapInArrow(run, "sequence_id bigint, offset bigint, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
