"""Periodic runs of words: maximal stretches that repeat with a period.

A document's words become numbers. A run of length n >= max(24, 3 q) with period q holds every window of WIDE words twice within q words, so
only stretches that are covered by such windows can hold runs (`stretches`, exact: no run is lost or cut). Each stretch gets the suffix trees
of its words and of their reversal (Ukkonen). The Euler tour of a tree, kept between neighbouring leaves, answers the longest common extension
of two positions in constant time: a range minimum over the depths of the lowest common ancestors. By the runs theorem (Bannai et al., 2017) a run
has a Lyndon root that is the longest Lyndon word from its place, in the order of words or in its reverse. So each place gives two candidates,
which are extended to both sides and kept if they are long enough.

Memory of a task follows its longest repetitive stretch: some 400 bytes a word. A document is one task's work.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from catalograph.llm.tables import steps, text_or_empty

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
WIDE = 8  # words of a window: at most LEAST - 2 * (LEAST // TIMES) + 1, so that each window of a run has a partner in it
RUN = "start bigint, length bigint, period bigint"


def _windows(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of WIDE numbers; equal windows have equal hashes."""
    h = (x.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < WIDE:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:]
        step *= 2
    return h


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of disjoint stretches that hold all runs whole."""
    found, todo = [], [(0, len(x))]
    h = _windows(x) if len(x) >= LEAST else None
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        part = h[lo: hi - WIDE + 1]
        order = np.argsort(part, kind="stable")
        gap = np.diff(order)
        near = (part[order[1:]] == part[order[:-1]]) & (gap * TIMES <= hi - lo)
        if not near.any():
            continue
        edge = np.zeros(hi - lo + 1, "i4")
        starts = np.unique(np.concatenate([order[1:][near], order[:-1][near]]))
        edge[starts] += 1
        edge[starts + WIDE] -= 1
        cover = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype("i1"), [0]])
        cuts = np.nonzero(np.diff(cover))[0].reshape(-1, 2) + lo
        if len(cuts) == 1 and cuts[0, 1] - cuts[0, 0] == hi - lo:
            found.append((lo, hi))
        else:
            todo += [(int(a), int(b)) for a, b in cuts]
    return sorted(found)


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers, reduced to what common extensions need: the rank of each suffix among the leaves and the
    string depth of the lowest common ancestor of neighbouring leaves."""

    def __init__(self, numbers: list[int]):
        n, top = len(numbers) + 1, max(numbers, default=0) + 2
        s = [*numbers, top - 1]  # an end that occurs nowhere else
        far = n + 1
        start, end, link, depth, parent, suffix = [0], [0], [0], [0], [-1], [-1]
        go: dict[int, int] = {}

        def add(a: int, b: int, d: int, of: int, leaf: int) -> int:
            start.append(a)
            end.append(b)
            link.append(0)
            depth.append(d)
            parent.append(of)
            suffix.append(leaf)
            return len(start) - 1

        node = at = length = left = 0
        for i, c in enumerate(s):
            waits, left = 0, left + 1
            while left:
                if not length:
                    at = i
                key = node * top + s[at]
                child = go.get(key)
                if child is None:
                    go[key] = add(i, far, -1, node, i - left + 1)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    a = start[child]
                    span = (end[child] if end[child] <= i else i + 1) - a
                    if length >= span:
                        at, length, node = at + span, length - span, child
                        continue
                    if s[a + length] == c:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    fork = add(a, a + length, depth[node] + length, node, -1)
                    go[key] = fork
                    start[child], parent[child] = a + length, fork
                    go[fork * top + s[a + length]] = child
                    go[fork * top + c] = add(i, far, -1, fork, i - left + 1)
                    if waits:
                        link[waits] = fork
                    waits = fork
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, at = length - 1, i - left + 1
        del go
        # The tour: a later child of a node meets the leaf before it in that node, a first child where its parent does.
        of = np.array(parent)
        order = np.argsort(of, kind="stable")
        begin = np.searchsorted(of[order], np.arange(len(of) + 1)).tolist()
        order = order.tolist()
        leaves, meet, stack = [], [], [(0, 0)]
        while stack:
            v, low = stack.pop()
            if suffix[v] >= 0:
                leaves.append(suffix[v])
                meet.append(low)
            else:
                kids, d = order[begin[v]: begin[v + 1]], depth[v]
                stack += [(k, d) for k in kids[:0:-1]]
                stack.append((kids[0], low))
        rank = np.zeros(n, "i4")
        rank[leaves] = np.arange(n)
        self.rank, self.table = rank, [np.array(meet, "i4")]
        while (w := 1 << len(self.table)) <= n:
            below = self.table[-1]
            self.table.append(np.minimum(below[: n - w + 1], below[w // 2: w // 2 + n - w + 1]))
        self._rank, self._table = array("i", rank.tobytes()), [array("i", t.tobytes()) for t in self.table]

    def common(self, i: int, j: int) -> int:
        """How far the suffixes from two different places agree."""
        a, b = self._rank[i], self._rank[j]
        if a > b:
            a, b = b, a
        k = (b - a).bit_length() - 1
        row = self._table[k]
        x, y = row[a + 1], row[b - (1 << k) + 1]
        return x if x < y else y

    def commons(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        k = np.frexp((b - a).astype("f8"))[1] - 1
        out = np.zeros(len(a), "i8")
        for level in np.unique(k):
            m = k == level
            row = self.table[level]
            out[m] = np.minimum(row[a[m] + 1], row[b[m] - (1 << int(level)) + 1])
        return out


def _lyndon_ends(s: list[int], tree: SuffixTree) -> np.ndarray:
    """The end of the longest Lyndon word from each place: the next smaller suffix, where a prefix is smaller."""
    n, common = len(s), tree.common
    end = [n] * n
    for i in range(n - 2, -1, -1):
        j, a = i + 1, s[i]
        while j < n:
            b = s[j]
            if a == b:
                far = common(i, j)
                if j + far == n or s[i + far] > s[j + far]:
                    break
            elif a > b:
                break
            j = end[j]
        end[i] = j
    return np.array(end)


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers, by start and period."""
    found: set[tuple[int, int, int]] = set()
    for lo, hi in stretches(x):
        s = np.unique(x[lo:hi], return_inverse=True)[1]
        n = len(s)
        ahead, back = SuffixTree(s.tolist()), SuffixTree(s[::-1].tolist())
        for order in (s, s.max() - s):
            i, j = np.arange(n), _lyndon_ends(order.tolist(), ahead)
            right, left = np.zeros(n, "i8"), np.zeros(n, "i8")
            m = j < n
            right[m] = ahead.commons(i[m], j[m])
            m = i > 0
            left[m] = back.commons(n - i[m], n - j[m])
            period, length = j - i, j + right - i + left
            m = (length >= LEAST) & (length >= TIMES * period)
            found.update(zip((i - left + lo)[m].tolist(), length[m].tolist(), period[m].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(code.__getitem__, words), "i8", len(words))


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs array<struct<start, length, period>>, collapsed) of every row.

    Words are parted by the six ASCII spaces. `collapsed` joins by one space the words that no run holds after its first period. A null or
    blank text has no words, no runs and an empty `collapsed`; repeated rows and null keys are rows like others, other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in steps(batches):
            every, rest = [], []
            for t in b.column(1).to_pylist():
                words = t.encode().split()
                runs = runs_of(numbered(words)) if len(words) >= LEAST else []
                if runs:
                    keep = np.ones(len(words), bool)
                    for start, length, period in runs:
                        keep[start + period: start + length] = False
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                every.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                rest.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(every, kind), pa.array(rest, pa.string())], names=["key", "runs", "collapsed"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, runs array<struct<{RUN}>>, collapsed string").withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): in a tenth of the keys, by checksum, the words from a place on repeat with a period that the checksum gives. Null keys stay."""
    h = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8"))
    words = F.filter(F.split(text_or_empty(text), "[ \\t-\\r]+"), lambda w: w != "")

    def repeated(x: Column) -> Column:
        a = F.expr("h div 10") % F.size("words")
        p = F.lit(1) + F.floor((F.size("words") - a) / (3 + F.expr("h div 10") % 8))
        at = F.when(x >= a, a + (x - a) % p).otherwise(x)
        return F.get("words", at.cast("int"))

    some = docs.select(F.col(key), text_or_empty(text).alias("text"), h.alias("h")).withColumn(
        "words", F.when((F.col("h") % 10 == 0) & (F.size(words) > 0), words))
    return some.select(key, F.when(F.col("words").isNull(), F.col("text")).otherwise(
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.greatest(F.size("words"), F.lit(1)) - 1), repeated))).alias("text"))


def digest(collapsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a row of `collapse`: the count of runs, the run of the greatest length / period (then least start, then period), checksums."""
    by_power = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(
        a["length"] * b["period"] < b["length"] * a["period"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(
        a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    best = F.get(F.array_sort("runs", by_power), F.lit(0))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                                  r["period"].cast("string"), F.lit("\n"))))
    return collapsed.select(key, "runs", "collapsed", best.alias("best")).select(
        key, F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
