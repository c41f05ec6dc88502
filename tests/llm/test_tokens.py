"""Sharding, packing, token files and token counts against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalograph.llm import packing, sharding, token_counts, token_files
from catalograph.llm.encoder import encoder, resolve
from catalograph.llm.queries import QUERIES

ODD = ["", None, "a", "  two  spaces ", "x" * 5000, "tab\tand\nline\r\n\n  end ", "It's we'll they'VE 'tis", "naïve Ñandú straße ÀÉ œuvre",
       "日本語 テキスト", "emoji 😀 ok", "<|endoftext|>inside<|startoftext|>", "é combining", " nbsp em", "12 345,6 ½ ³",
       "ΣΑΣ İstanbul", "\x00\x1c ctl", "quotes “a” — b…", "word " * 3000, "İ", "ǅ ß ſ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(2, "a", "y", 2), (2, "a", "y", 2), (None, "null key", "z", 3), (None, None, "z", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, start int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_librarys(spark, sf, name):
    lib = Tokenizer.from_file(resolve(name))
    texts = [t or "" for t in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(encoder(name).packed(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


def test_counts(spark, docs):
    lib = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = token_counts.count_tokens(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_whole_tokens_are_proved():
    lib, whole = Tokenizer.from_file(resolve("byte_bpe_50k.json")), token_counts.whole_tokens()
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole
    assert all(len(e.ids) == 1 for e in lib.encode_batch(sorted(whole), add_special_tokens=False))


def _ids(name, text):
    return [*Tokenizer.from_file(resolve(name)).encode(text or "", add_special_tokens=False).ids, 1]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("group", [packing.GROUP, 3])
def test_packing_holds_every_id_once(spark, docs, group):
    got = packing.pack(docs, group=group).collect()
    want = Counter()
    for r in docs.collect():
        ids = _ids("byte_bpe_50k.json", r.text)
        for s in range(0, len(ids), 2048):
            want[(r.doc_id, s, len(ids[s: s + 2048]), _crc(ids[s: s + 2048]), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    for seq in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    got, room = packing.best_fit(lengths, 64), []
    for n, w, o in zip(lengths, *got):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[w] == min(fits)
        else:
            assert w == len(room)
            room.append(64)
        assert o == 64 - room[w]
        room[w] -= n


def test_sequences_rebuild_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    packed = packing.pack(docs).cache()
    seqs = {r.sequence_id: r.ids for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        assert _crc(seqs[r.sequence_id][r.offset: r.offset + r.length]) == r.ids_crc32


def test_token_files_round_trip(spark, docs, tmp_path):
    docs = docs.repartition(3)
    manifest = token_files.write_files(docs, f"file://{tmp_path}/out", length=32, batch=4)
    got = sorted(token_files.read_files(manifest).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = _ids("word_bpe_49k.json", r.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), _crc(ids))
        at += len(ids)
    for f in manifest.collect():
        file = token_files.TokenFile(f.path)
        ids, mask = file.sequence(f.sequences - 1)
        assert len(ids) == 32 and mask.sum() == f.tokens - 32 * (f.sequences - 1)
    assert token_files.read_files(token_files.write_files(docs.limit(0), f"file://{tmp_path}/none")).count() == 0


def _shard(tree, key):
    def pick(names, weights):
        draws = []
        for i, (n, w) in enumerate(zip(names, weights)):
            h = 42 if key is None else xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(n.encode(), h)
            draws.append((-np.log(((h >> 11) + 0.5) / 2**53) / w, i))
        return min(draws)[1]
    names = list(tree.regions)
    g = names[pick(names, [sum(sum(k.values()) for k in tree.regions[n].values()) for n in names])]
    racks = list(tree.regions[g])
    k = racks[pick([f"{g}/{r}" for r in racks], [sum(tree.regions[g][r].values()) for r in racks])]
    leaf = tree.regions[g][k]
    return list(leaf)[pick([f"{g}/{k}/{s}" for s in leaf], list(leaf.values()))]


def test_tree_draws_and_growth(spark):
    tree = sharding.balanced()
    rows = spark.range(-50, 3000).withColumnRenamed("id", "doc_id").union(spark.sql("select cast(null as bigint)"))
    got = sharding.assign(sharding.assign(rows, tree), tree.grown(), into="grown").collect()
    for r in got[:400] + got[-1:]:
        assert r.shard == _shard(tree, r.doc_id) and r.grown == _shard(tree.grown(), r.doc_id)
    assert all(r.grown in (r.shard, 8) for r in got)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) < 1.25 * len(got) / 8


def test_moves_stay_in_the_subtree_whose_weight_changed(spark):
    tree = sharding.balanced()
    heavy = tree.reweighted("region-0", "rack-0", 1, 3.0)
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    for r in sharding.assign(sharding.assign(rows, tree), heavy, into="after").collect():
        if r.shard != r.after:
            assert r.after < 4  # only into region-0, the one that grew
            assert r.shard >= 4 or r.after < 2  # inside it only into rack-0


def test_slots_are_gapless_with_repeats(spark):
    rows = spark.createDataFrame([(i % 7, 5) for i in range(3000)] + [(1, 5)] * 3000 + [(None, None)] * 5, "doc_id bigint, extra int")
    placed = sharding.assign(rows, sharding.balanced())
    got = sharding.number(placed, bucket=100).collect()
    assert len(got) == 6005
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.number(placed.limit(0)).count() == 0


def test_shard_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tree = sharding.balanced()
    got = QUERIES["op1_hash_tree_shards"](spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.grown_shard) for r in got} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode()), _shard(tree, i), _shard(tree.grown(), i)) for i, t in docs.items()}
    assert {r.law for r in got} == {"key"}


def test_null_text_has_size_one(spark):
    assert spark.range(1).select((F.octet_length(F.coalesce(F.lit(None).cast("string"), F.lit(""))) + 1)).first()[0] == 1
