"""Token ids in Arrow IPC files with fixed-size-list batches.

Documents go in ascending key order into files of equal-length sequences: `ids fixed_size_list<uint16|uint32>[length]` and
`mask fixed_size_list<bool>[length]` (false: padding at a file's end), `BATCH` sequences a record batch. Buffers are not compressed, so
a mapped file gives sequence k as batch k // BATCH, row k % BATCH, without a copy. Beside each file lies a second one with the
key, start and length of its documents. One task writes one file under a name of its attempt and renames it at the end, so a
lost or repeated task leaves one whole file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalograph.llm.encoder import encoder
from catalograph.llm.tables import steps, text_or_empty, written
from catalograph.session import fresh_dir

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
BATCH = 64
END = 1
INDEX_ROWS = 10_000


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Fills sequences from a stream of ids and writes a batch whenever BATCH of them are full."""

    def __init__(self, uri: str, length: int, batch: int, dtype: np.dtype):
        self.fs, self.path = _fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temp = f"{self.path}.{uuid.uuid4().hex[:8]}.part"
        self.length, self.batch, self.dtype = length, batch, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"length": str(length), "batch": str(batch)})
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n, self.total, self.sequences = [], 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        full = self.length * self.batch
        if self.n >= full:
            every = np.concatenate(self.held)
            for i in range(0, len(every) - full + 1, full):
                self._put(every[i: i + full], full)
            rest = every[len(every) // full * full:]
            self.held, self.n = [rest], len(rest)

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(cols, schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        if self.n:
            ids = np.zeros(-(-self.n // self.length) * self.length, self.dtype)
            ids[: self.n] = np.concatenate(self.held)
            self._put(ids, self.n)
        self.out.close()
        self.sink.close()
        self.fs.move(self.temp, self.path)


def _write_table(uri: str, table: pa.Table) -> None:
    fs, path = _fs(uri)
    temp = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with fs.open_output_stream(temp) as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table, max_chunksize=INDEX_ROWS)
    fs.move(temp, path)


def write_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                length: int = LENGTH, batch: int = BATCH, end: int = END) -> DataFrame:
    """Write `docs` to `folder` and return the manifest `(part, path, documents, tokens, sequences, base)`, one row a file.

    Keys ascend over the files and inside them, nulls first; rows with one key go by their text. A null text is the end id alone. A range
    of keys is one task, whose rows stream; an empty table gives an empty manifest. `base` counts the ids of all earlier files.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    ranged = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        dtype = np.dtype("u2") if enc.library.get_vocab_size() <= 1 << 16 else np.dtype("u4")
        part = TaskContext.get().partitionId()
        uri, out, index = f"{folder}/part-{part:06d}.arrow", None, []
        for b in steps(batches):
            if not b.num_rows:
                continue
            out = out or _Writer(uri, length, batch, dtype)
            start, n = [], []
            for t in b.column(1).to_pylist():
                ids = np.append(np.frombuffer(enc.packed(t), "<u4").astype(dtype), dtype.type(end))
                start.append(out.total)
                n.append(len(ids))
                out.add(ids)
            index.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                                                    names=["key", "start", "n_tokens"]))
        if out:
            out.close()
            table = pa.Table.from_batches(index)
            _write_table(f"{folder}/part-{part:06d}.docs.arrow", table)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "documents": [len(table)], "tokens": [out.total],
                                              "sequences": [out.sequences]})

    manifest = written(ranged.mapInArrow(run, "part bigint, path string, documents bigint, tokens bigint, sequences bigint"), "manifest")
    return manifest.withColumn("base", F.expr(  # one row a file: a small table
        "coalesce(sum(tokens) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    ).withColumn("key_type", F.lit(key_type))


class TokenFile:
    """Random access to one file. On a local path the file is mapped and sequences are views of it."""

    def __init__(self, uri: str):
        fs, path = _fs(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = int(self.reader.schema.metadata[b"batch"])
        self._at: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch_ids(self, i: int) -> np.ndarray:
        """All ids of a record batch, flat, uncopied."""
        if self._at[0] != i:
            self._at = (i, self.reader.get_batch(i).column(0).flatten().to_numpy())
        return self._at[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k."""
        b, at = self.reader.get_batch(k // self.batch), (k % self.batch) * self.length
        return (b.column(0).flatten().to_numpy()[at: at + self.length],
                b.column(1).flatten().to_numpy(zero_copy_only=False)[at: at + self.length])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids `start` to `start + n` of the file."""
        full, out = self.length * self.batch, []
        while n > 0:
            at = start % full
            part = self.batch_ids(start // full)[at: at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files; a task reads its files batch by batch.

    `start` counts the ids of all documents before it, over all files; the checksum is over little-endian unsigned 32-bit ids.
    """
    kind = manifest.select("key_type").first()
    kind = kind[0] if kind else "bigint"
    files = manifest.select("part", "path", "base")
    spread = files.repartitionByRange(max(1, files.count()), "part")  # a file a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                tokens, (fs, path) = TokenFile(f["path"]), _fs(f["path"].removesuffix(".arrow") + ".docs.arrow")
                with fs.open_input_file(path) as src:
                    docs = pa.ipc.open_file(src)
                    for i in range(docs.num_record_batches):
                        d = docs.get_batch(i)
                        start, n = d.column(1).to_numpy(), d.column(2).to_numpy()
                        crc = [zlib.crc32(tokens.ids(s, m).astype("<u4").tobytes()) for s, m in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start + f["base"]), d.column(2), pa.array(crc, pa.int64())],
                                                         names=["key", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for token files below the shared one."""
    made = fresh_dir(spark, "tokens")
    return made if "://" in made or made.startswith("file:") else os.path.abspath(made)
