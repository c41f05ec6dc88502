"""Token counts with a whole-token shortcut.

`whole_tokens` proves, without any corpus, which strings of the vocabulary are one pre-token and encode alone as exactly one
token. A text's pre-tokens found in that set count one each with no merging; only the others are merged, once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalograph.llm.encoder import CACHE, encoder
from catalograph.llm.tables import steps, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def whole_tokens(vocabulary: str = VOCABULARY) -> frozenset[str]:
    """Vocabulary strings that are a single pre-token and, encoded alone, that one token. As many as the vocabulary at most."""
    enc = encoder(vocabulary)
    by_id = {i: enc.library.decode([i], skip_special_tokens=False) for i in enc.library.get_vocab().values()}
    single = [(i, s) for i, s in by_id.items() if s and "�" not in s and enc.plain(s) and enc.pre_tokens(s) == [s]]
    whole = enc.library.encode_batch_fast([s for _, s in single], add_special_tokens=False)
    return frozenset(s for (i, s), got in zip(single, whole, strict=True) if got.ids == [i])


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys keep their rows. Other columns are not read. A text with
    characters the shortcut does not cover, or with a special token's string, is encoded whole by the library.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))  # bounded by the vocabulary
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        size = dict.fromkeys(proven.value, 1)
        for b in steps(batches):
            texts = b.column(1).to_pylist()
            cuts = [enc.pre_tokens(t) if enc.plain(t) else None for t in texts]
            if len(size) > CACHE:
                size = dict.fromkeys(proven.value, 1)
            new = [p for p in {p for c in cuts if c is not None for p in c} if p not in size]
            size.update(zip(new, map(len, enc.alone(new)), strict=True))
            counts = [sum(map(size.__getitem__, c)) if c is not None else len(enc.library.encode(t, add_special_tokens=False).ids)
                      for t, c in zip(texts, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                names=["key", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
