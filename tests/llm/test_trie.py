"""The prefix trie, its rollup and the chat layout against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from catalograph.llm import chat_format as C, prefix_trie as P, queries as Q
from catalograph.llm.running import running
from catalograph.llm.tables import written
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, i string, k1 int, depth string, _pid int"


def lists(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    """The contract's rows, node by node."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
        ends[tuple(t)].add(c)
    kids = defaultdict(list)
    for v in members:
        if v:
            kids[v[:-1]].append(v)
    leaves, saved = {}, {}
    for v in sorted(members, key=len, reverse=True):
        leaves[v] = sum(leaves[k] for k in kids[v]) if kids[v] else 1
        saved[v] = sum(saved[k] for k in kids[v]) + ((len(members[v]) - 1) * len(v[-1][1].encode()) if v else 0)
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), len(kids[v]), leaves[v], saved[v],
                   hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()) for v, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


ODD = [(0, None, None, None), (0, 1, "user", "hé"), (0, 1, "user", "hé"), (0, 1, "assistant", "a"), (5, 0, "", ""), (5, 2, "user", ""), (None, 1, "user", "lost"),
       (1, 0, "user", "own"), (7, 3, "user", "x " * 20_000), (7, 3, "user", "x " * 20_000), (8, 0, "assistant", "y"), (9, 0, "assistant", "y"), (21, 4, None, "z")]


def wide(rng, n=160):
    """A long conversation, a star below one turn, a comb of ever longer conversations, copies, turns that end early."""
    rows = [(500, i, "user", f"deep {i % 3}") for i in range(n)]
    rows += [(1000 + j, i, "user", f"deep {i % 3}" if i <= j else f"own {j}") for j in range(0, n // 2, 3) for i in range(j + 2)]
    rows += [(2000 + j, i, "user", "hub" if i == 0 else f"leaf {rng.randrange(60)}") for j in range(n) for i in range(2)]
    return rows + [(3000 + j, i, "assistant", f"same {i}") for j in range(40) for i in range(4)]


@pytest.mark.parametrize("local", [2, 25, 20_000])
def test_rollup_of_chains_stars_and_combs(spark, local):
    """With a small bound the components are split by joins, else within a task: the same rows."""
    rows = wide(random.Random(3))
    turns = written(P.marked(P.ordered(frame(spark, rows))), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    assert rows_of(P.report(P.Trie(turns.join(sizes, "conv_id"), sizes), local)) == brute(lists(rows))


def test_rebuilt_conversations_with_odd_rows(spark):
    rng = random.Random(5)
    rows = ODD + [(c, t, rng.choice(["user", "assistant"]), rng.choice("pqr")) for c in range(40, 75) for t in range(rng.randrange(1, 12)) if c % 7]
    turns = written(P.marked(P.ordered(frame(spark, rows))), "turns")
    assert rows_of(P.report(P.Trie(*P.branched(turns)), 10)) == brute(rebuilt(lists(rows)))


def test_empty_conversations(spark):
    none = frame(spark, []).limit(0)
    assert P.report(P.Trie(*P.branched(P.marked(P.ordered(none))))).count() == 0
    out = C.layout(none)
    assert out.segments.count() == out.chains.count() == C.read_back(out).count() == 0


def test_repeated_rows_beyond_one_step(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES", 4)
    got = P.ordered(frame(spark, [(1, 1, "user", "a")] * 11 + [(1, 0, "user", "b"), (1, 2, "user", "c")])).collect()
    assert sorted((r.i, r.text) for r in got) == [(0, "b"), *[(i, "a") for i in range(1, 12)], (12, "c")]


def test_running_sums_cross_tasks_and_wrap(spark):
    """A third of the rows in one group, over many tasks; the sums leave the range of a long."""
    rng = random.Random(1)
    rows = [(7 if i % 3 == 0 else i % 11, i, rng.randrange(-(1 << 63), 1 << 63)) for i in range(4000)]
    got = running(spark.createDataFrame(rows, "g bigint, o bigint, v bigint").repartition(5), ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}).collect()
    sums, n, want = defaultdict(int), defaultdict(int), set()
    for g, o, v in rows:
        want.add((g, o, (sums[g] + (1 << 63)) % (1 << 64) - (1 << 63), n[g]))
        sums[g], n[g] = sums[g] + v, n[g] + 1
    assert {(r.g, r.o, r.s, r.n) for r in got} == want and len(got) == len(rows)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(C.TURN + C.escape(r) + C.TEXT + C.escape(t) + C.END) for r, t in turns))


@pytest.mark.parametrize("local", [3, 20_000])
def test_layout_reads_back_and_stores_each_node_once(spark, local):
    marks = ["<|turn|>", "<|end|>", "<\\|text|>", "</s>[INST] ok [/INST]", "<|endoftext|>", "[\\\\INST]", "漢é\n", ""]
    rows = ODD + wide(random.Random(9), 60) + [(4000 + i, j, f"r{m}" if j % 2 else "assistant", m * (j + 1)) for i, m in enumerate(marks) for j in range(3)]
    convs = lists(rows)
    out = C.layout(frame(spark, rows), local=local)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in C.read_back(out).collect()}
    assert got == {c: digest(t) for c, t in convs.items()}
    nodes = {tuple(t[:d]) for t in convs.values() for d in range(1, len(t) + 1)}
    segments = out.segments.collect()
    assert len(segments) == len(nodes)
    trees = defaultdict(list)
    for s in segments:
        trees[s.tree].append(s)
        assert s.length == len(s.ids) and s.loss_from <= s.loss_to <= s.length
    for parts in trees.values():  # a tree's stream has neither gap nor overlap
        at = 0
        for s in sorted(parts, key=lambda s: s.offset):
            assert s.offset == at
            at += s.length
    chains = {r.chain: r for r in out.chains.collect()}
    for s in segments:  # a node's position id is the number of ids it can see before itself
        seen = [(x.start, min(x.end, s.offset)) for x in chains[s.chain].attends if x.start < s.offset and x.depth < s.depth]
        assert sum(b - a for a, b in seen) == s.position
        assert all(a < b for a, b in seen)


def test_escapes_are_reversible():
    rng = random.Random(2)
    bits = ["<|", "|>", "<\\|", "</s>", "<s>", "[INST]", "[\\/INST]", "[/INST]", "\\", "é", "\n", "ab", "<|end|>", "<<SYS>>", "<", "[", "|", "<end_of_turn>"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        e = C.escape(t)
        assert C.unescape(e) == t and not any(x in e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<end_of_turn>"))


def test_registered_chat_query(spark, sf):
    convs = lists(tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in Q.QUERIES["op12_chat_format"](spark, sf).collect()}
    assert got == {c: digest(t) for c, t in convs.items()}
