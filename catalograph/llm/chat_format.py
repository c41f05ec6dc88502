"""Chat formatting over a prefix tree: what conversations share at their beginning is formatted and stored once.

A turn becomes `<|turn|>` role `<|text|>` text `<|end|>`. A control string inside a role or text (of this template or of other common ones) gets a
backslash after its first character, one that has backslashes there gets one more, so a mark in the output is always the template's and the
texts come back exactly.

Conversations with equal first turns share the nodes of a `Trie`. A tree is a first turn with all that follows it; its nodes are laid out depth-first, a
node's children by their least conversation. So the nodes of one conversation that no lesser one has, a chain, lie side by side, and what a
token may attend to is a list of intervals, one for each chain on its path: its own chain up to itself and the listed part of every chain above. A list is
kept once a chain; its length is at most the turns of the chain's conversation. Offsets need the size of whole subtrees, which come from the trie's rollup,
and two running sums; no tree is ever gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalograph.llm.encoder import encoder
from catalograph.llm.prefix_trie import LOCAL, Trie, marked, ordered, rollup
from catalograph.llm.running import running
from catalograph.llm.tables import steps, written

VOCABULARY = "byte_bpe_50k.json"
ASSISTANT = "assistant"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Beginnings and the rest of control strings of common templates.
CONTROL = re.compile(r"(<)(\\*)(\||/?s>|/?SYS>|<SYS>|</SYS>|(?:start|end)_of_turn>|(?:bos|eos|pad)>)|(\[)(\\*)(/?INST\])")
ESCAPED = re.compile(r"(<)\\(\\*)(\||/?s>|/?SYS>|<SYS>|</SYS>|(?:start|end)_of_turn>|(?:bos|eos|pad)>)|(\[)\\(\\*)(/?INST\])")
PARSED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def _joined(m: re.Match, more: str) -> str:
    return f"{m[1]}{more}{m[2]}{m[3]}" if m[1] else f"{m[4]}{more}{m[5]}{m[6]}"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: _joined(m, "\\"), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: _joined(m, ""), text)


class Layout(NamedTuple):
    """`segments`: (tree, offset, length, position, ids, loss_from, loss_to, chain, depth), a row a node: its ids, at `offset` of the tree's
    stream, the first with the position id `position`; the ids from loss_from to loss_to are trained on.
    `chains`: (chain, tree, attends array<struct<depth, chain, until, start, end>>), a row a conversation: the intervals [start, end) that its last token
    sees, by depth; a token of the chain sees those that start before it, up to itself. `until` is the depth of an interval's last node."""

    segments: DataFrame
    chains: DataFrame


def _encoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(k1, k2, ids, loss_from, loss_to) of `rows(k1, k2, role, text)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in steps(batches):
            ids, lo, hi = [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                head, body, tail = (np.frombuffer(enc.packed(x), "<u4").astype("i4") for x in (TURN + escape(role) + TEXT, escape(text), END))
                ids.append(np.concatenate([head, body, tail]))
                lo.append(len(head))
                hi.append(len(head) + len(body) if role == ASSISTANT else len(head))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                             names=["k1", "k2", "ids", "loss_from", "loss_to"])

    return rows.select("k1", "k2", "role", "text").mapInArrow(run, "k1 bigint, k2 bigint, ids array<int>, loss_from int, loss_to int")


def layout(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str = VOCABULARY,
           local: int = LOCAL) -> Layout:
    """Format all conversations. Turns go by `turn`, nulls first, then role and text; a null role or text is empty, a repeated row is a turn of its own,
    rows without a conversation id are left out, an empty table gives empty tables."""
    turns = written(ordered(conversations, conv, turn, role, text), "chat_turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    trie = Trie(marked(turns).join(sizes, "conv_id"), sizes)
    inner = trie.nodes.filter("depth > 0")
    texts = turns.select("conv_id", (F.col("i") + 1).alias("depth"), "role", "text")
    coded = written(_encoded(inner.join(texts, ["conv_id", "depth"]), vocabulary), "chat_ids")
    sized = written(trie.nodes.join(coded.select("k1", "k2", F.size("ids").cast("bigint").alias("length")), ["k1", "k2"], "left").fillna(0, ["length"]), "chat_nodes")
    sums = rollup(sized, trie.paths, ["length"], local)
    below = sized.filter("depth > 1").join(sums, ["k1", "k2"]).select("p1", "p2", "conv_id", "k1", "k2", F.col("sum_length").alias("whole"))
    after = running(below, ["p1", "p2"], ["conv_id"], {"before": F.col("whole")}).select("k1", "k2", "before")
    step = sized.filter("depth > 0").join(after, ["k1", "k2"], "left").select(
        "k1", "k2", F.col("conv_id").alias("chain"), "length", F.coalesce("before", F.lit(0)).alias("before"))
    walked = trie.paths.select("conv_id", "depth", "k1", "k2").join(step, ["k1", "k2"])
    # Along a conversation: a node begins where its parent ends, after its earlier siblings' subtrees.
    sums = running(walked, ["conv_id"], ["depth"], {"position": F.col("length"), "skipped": F.col("before"), "tree": F.when(F.col("depth") == 1, F.col("chain")).otherwise(0)})
    on = written(sums.withColumns({"offset": F.col("position") + F.col("skipped") + F.col("before"),
                                   "tree": F.when(F.col("depth") == 1, F.col("chain")).otherwise(F.col("tree"))}).drop("skipped", "before"), "chat_paths")
    segments = on.filter("conv_id = chain").join(coded, ["k1", "k2"]).select(
        "tree", "offset", "length", "position", "ids", "loss_from", "loss_to", "chain", "depth")
    spans = on.groupBy("conv_id", "tree", "chain").agg(F.min("depth").alias("depth"), F.max("depth").alias("until"), F.min("offset").alias("start"),
                                                       F.max(F.col("offset") + F.col("length")).alias("end"))
    chains = spans.groupBy(F.col("conv_id").alias("chain"), "tree").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("chain").alias("chain"), "until", "start", "end"))).alias("attends"))
    return Layout(written(segments, "chat_segments"), written(chains, "chat_chains"))


def read_back(out: Layout, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): every conversation as its last token sees it, decoded and parsed.

    A conversation's turns stream through one task in order, as its digests need; none is held whole.
    """
    parts = out.chains.select(F.col("chain").alias("conv_id"), F.explode("attends").alias("x")).select(
        "conv_id", F.col("x.chain").alias("chain"), F.explode(F.sequence("x.depth", "x.until")).alias("depth"))
    seen = parts.join(out.segments.select("chain", "depth", "ids", "loss_from", "loss_to"), ["chain", "depth"])
    rows = seen.select("conv_id", "depth", "ids", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, now, held = encoder(vocabulary).library, None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        out = lambda: pa.RecordBatch.from_pydict({k: [v] for k, v in zip(names, [now, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]], strict=True)})
        for b in steps(batches):
            conv, _, ids, lo, hi = (c.to_pylist() for c in b.columns)
            whole = lib.decode_batch(ids, skip_special_tokens=False)
            loss = lib.decode_batch([i[x:y] for i, x, y in zip(ids, lo, hi, strict=True)], skip_special_tokens=False)
            for c, w, m in zip(conv, whole, loss, strict=True):
                if held is None or c != now:
                    if held is not None:
                        yield out()
                    now, held = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in PARSED.findall(w):
                    held[0] += 1
                    held[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                plain = unescape(m)
                held[2] += len(plain)
                held[3].update(plain.encode())
                held[4] += len(w)
        if held is not None:
            yield out()

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
