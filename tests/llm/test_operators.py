"""The ten operators against brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paxlens.llm import ann, embedding_dedup, kd_shards, mixing, packing, quality, simhash, token_files, toxicity, warc
from paxlens.llm.common import components, id_key, range_cuts, read, run_of
from paxlens.llm.queries import QUERIES
from paxlens.llm.tokens import PieceEncoder, public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(30000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", None, 3), (5, LONG, "de", "b", 1), (6, LONG, "de", "b", 1), (6, LONG, "de", "b", 1), (None, "no id here at all", "en", "a", 5), (7, "é ü  x y <|endoftext|>", "fr", "c", 9), (9007199254740993, "large id", "en", "a", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"fp": F.lit("clash"), "size": F.lit("clash"), "shard": F.lit(1), "score": F.lit("x"), "key": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def groups(nodes, links):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            of[n] = of[of[n]]
            n = of[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = [e for e in edges if e[0] != e[1]]
    assert got == groups({x for e in links for x in e}, links)


# 1


def brute_links(rows, threshold):
    good = [(i, np.asarray(v, float), y) for i, v, y in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]


@pytest.mark.parametrize("block", [4096, 64])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 64))
    v = np.concatenate([base[i % 60 if i < 240 else 0] + rng.normal(0, rng.choice([0.02, 0.2, 0.3]), 64) for i in range(700)]).reshape(-1, 64).astype(np.float32)
    rows = [(i, v[i].tolist(), int(i % 3)) for i in range(700)]
    rows += [(700, v[0].tolist(), 0), (701, v[0].tolist(), None), (702, None, 0), (703, [0.0] * 64, 0), (704, [float("nan")] * 64, 0), (705, [None] + [1.0] * 63, 0), (706, [1.0, 2.0], 0), (707, [2.0, 4.0], 0), (708, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("clash"))
    links = brute_links(rows, 0.93)
    assert len(links) > 1000
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    of = groups([r[0] for r in rows], links)
    got = embedding_dedup.near_duplicates(df, 0.93, block).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.999 * 2 * len(links) and all(r.n_links <= count[r.vec_id] for r in got)
    assert sum(of[r.vec_id] != r.component_id for r in got) <= 2 and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_embedding_cells_cover_large_labels():
    assert embedding_dedup.lead_plan(8000, 0.93, 4096) == (0, 1)
    k, tables = embedding_dedup.lead_plan(10**8, 0.93, 4096)
    near, far = embedding_dedup.lead_chances(0.93)
    assert k > 3 and (1 - near**k) ** tables <= 1.1 * (1 - embedding_dedup.STEP_RECALL) and tables * far**k < 0.5


def test_embedding_recall_of_both_steps():
    """Pairs exactly at the threshold, through the cells and the count as they are calibrated for a large label."""
    rng = np.random.default_rng(22)
    k, tables = embedding_dedup.lead_plan(10**6, 0.93, 4096)
    r, n = np.sqrt(2 * (1 - 0.93)), 20000
    met = (np.abs(rng.normal(0, r, (n, embedding_dedup.PROJECTIONS))) <= embedding_dedup.WINDOW * r).sum(1) >= embedding_dedup.needed()
    width = embedding_dedup.LEAD_WIDTH * r
    a = rng.uniform(0, width, (n, tables, k))
    cell = np.zeros(n, bool)
    for t in range(tables):
        cell |= (np.floor((a[:, t] + rng.normal(0, r, (n, k))) / width) == 0).all(1)
    assert (met & cell).mean() >= embedding_dedup.RECALL - 4 * np.sqrt(1e-4 / n)


def test_embedding_leading_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "lead_plan", lambda n, t, b: (2, 12))
    rng = np.random.default_rng(3)
    v = np.repeat(rng.standard_normal((40, 64)), 5, 0) + rng.normal(0, 0.15, (200, 64))
    rows = [(i, v[i].tolist(), 1) for i in range(200)]
    links = brute_links(rows, 0.93)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()
    assert sum(r.n_links for r in got) == 2 * len(links) > 100


def test_embedding_odd(spark):
    form = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], form)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, None, None)], form)).collect()
    assert sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(-1, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (-1, 0, None, False)], key=str)


# 2


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark, docs):
    texts = [r.text for r in docs.limit(30).collect()] + [r[1] for r in ODD] + ["ÀB CÉ d"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    for n in (1, 3, 4, 5):
        words = " ".join("abcde"[:n])
        assert spark.sql(f"select xxhash64('{words}')").first()[0] % 2**64 == simhash.fingerprint(words) or n > 4


@pytest.mark.parametrize("parts", [5, 6, 7])
def test_near_links_are_complete(spark, parts):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**64, 300, np.uint64).tolist()
    for k in range(900):
        f = fps[int(rng.integers(0, len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            f ^= 1 << int(b)
        fps.append(f)
    fps = sorted({np.uint64(f).astype(np.int64).item() for f in fps})
    u = np.array(fps, np.int64).view(np.uint64)
    links = [(fps[i], fps[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4) + i + 1]
    got = {r.node: r.component for r in components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, parts)).collect()}
    want = groups({x for e in links for x in e}, links)
    assert got == want


def test_near_links_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = np.random.default_rng(5)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(12, 3, replace=False)) | 1 << 40) for _ in range(400)})
    u = np.array(fps, np.int64).view(np.uint64)
    links = [(fps[i], fps[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4) + i + 1]
    got = {r.node: r.component for r in components(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert got == groups(set(fps), links)


def test_simhash(spark, docs):
    rows = docs.collect()
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in rows}
    ids = sorted(fp)
    u = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4) + i + 1]
    got = simhash.simhash_components(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", c) for i, c in groups(ids, links).items()}
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert kept == set(groups(ids, links).values())


def test_simhash_odd(spark, odd, empty):
    got = simhash.simhash_components(odd).collect()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(got) == len(ODD) and {r.doc_id for r in zero} == {1, 2, 3} and {r.component_id for r in zero} == {1}
    assert simhash.simhash_components(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.deduplicated(odd).collect()) == ["1", "4", "5", "7", "9007199254740993", "None"]


# 3, 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(docs, name):
    plain = Tokenizer.from_file(public_path(name))
    plain.encode_special_tokens = True
    enc = PieceEncoder(public_path(name))
    texts = [r.text for r in docs.collect()] + [r[1] for r in ODD] + [" a", "a ", "a  b", "a \n b", "\n", "\n\na", "a\nb c|d | e", "é x", "ΑΣ ΒΣ", "| |", "a, b. c,, d.. 'tis don't", "x y", "ﬁ ſ", "A.B, C.\nD"]
    for _ in range(2):
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def expected_tokens(rows, name):
    plain = Tokenizer.from_file(public_path(name))
    plain.encode_special_tokens = True
    return [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, empty, docs, monkeypatch):
    name = "byte_bpe_50k.json"
    monkeypatch.setattr(token_files, "FRAME_IDS", 5000)
    for table, rows in ((odd, ODD), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        want, start = [], 0
        for i, ids in expected_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), name):
            want.append((i, start, len(ids), crc(ids)))
            start += len(ids)
        manifest = token_files.write_tokens(table, public_path(name), files=3)
        got = [tuple(r) for r in token_files.read_tokens(spark, manifest).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    some = token_files.read_tokens(spark, manifest, [3, 5], with_ids=True).collect()
    assert {r.doc_id for r in some} == {3, 5} and all(crc(r.ids) == r.ids_crc32 for r in some)
    assert token_files.read_tokens(spark, token_files.write_tokens(empty, public_path(name))).count() == 0


def test_frames_are_plain_zstd_and_checked(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    out = io.BytesIO()
    w = token_files.FrameWriter(out, 2)
    data = [np.arange(n, dtype="<u2").tobytes() for n in (3, 0, 70000)]
    for i, d in enumerate(data):
        w.add(i, d)
    w.close()
    raw = out.getvalue()
    unpacked = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    got = b""
    for f in range(3):
        got += zstandard.ZstdDecompressor().decompress(raw[sum(t[0] for t in w.table[:f]) : sum(t[0] for t in w.table[: f + 1])])
    assert got == b"".join(data) and unpacked.read(len(data[0])) == data[0]
    broken = bytearray(raw)
    broken[len(raw) - 9 - 12 * 3 + 8] ^= 1  # a checksum in the seek table
    assert token_files.FrameReader(pa.BufferReader(raw)).ids(2).tolist() == list(range(65536)) + list(range(70000 - 65536))
    with pytest.raises(ValueError, match="checksum"):
        token_files.FrameReader(pa.BufferReader(bytes(broken))).ids(0)


def test_pack():
    rng = np.random.default_rng(6)
    for lengths in ([1], [4096], [5000] * 3, [10, 20, 30], rng.integers(1, 9000, 300).tolist(), rng.geometric(0.002, 2000).tolist(), []):
        found = packing.pack(lengths)
        pieces = sorted(p for s in found for p in s)
        at = defaultdict(int)
        for doc, start, n in pieces:
            assert start == at[doc] and n > 0
            at[doc] += n
        assert dict(at) == dict(enumerate(lengths))
        assert all((n := sum(p[2] for p in s)) <= 4096 and n & (n - 1) == 0 for s in found)
        groups_ = packing.steps([sum(p[2] for p in s) for s in found], 8192)
        loads = np.bincount(groups_, [sum(p[2] for p in s) for s in found]) if found else np.zeros(1)
        assert loads.max() - loads.min() <= 4096


def test_packing(spark, odd, empty, docs):
    name = "word_bpe_49k.json"
    for table, rows in ((odd, ODD), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = packing.packed(table, public_path(name), with_ids=True).collect()
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append(r)
            assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        for s in by.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist() and sum(r.length for r in s) == s[0].sequence_tokens <= 4096
        want = defaultdict(int)
        for i, ids in expected_tokens(rows, name):
            want[i, tuple(ids)] += 1
        whole = defaultdict(list)
        for r in got:
            whole[r.doc_id].append(r)
        for (i, ids), times in want.items():
            pieces = sorted(((r.start, r.ids) for r in whole[i]), key=lambda p: p[0])
            assert [x for _, p in pieces for x in p] == list(ids) if times == 1 else sum(len(p) for _, p in pieces) == times * len(ids)
    assert packing.packed(empty, public_path(name)).count() == 0


def test_groups_close_by_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 100)
    got = packing.packed(spark.createDataFrame([(None, None)] * 950, "doc_id long, text string").coalesce(1), public_path("word_bpe_49k.json")).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) == 950 and max(r.n for r in got) == 64


# 4


def test_shards(spark, odd, empty, docs):
    got = kd_shards.sharded(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in got} == set(text) and {r.shard for r in got} <= set(range(8))
    sizes, slots, of = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode()))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    largest = max(len(t.encode()) for t in text.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    few = kd_shards.sharded(odd, 40).collect()
    assert len(few) == len(ODD) and all(0 <= r.shard < 40 for r in few) and len({(r.shard, r.slot) for r in few}) == len(ODD)
    assert kd_shards.sharded(empty, 40).count() == 0 and kd_shards.sharded(odd.limit(1), 1).first().slot == 0


def plain_tree(points, weights, leaves):
    """Shards by a k-d tree with exact weighted medians: points are rows of keys."""
    if leaves == 1 or not len(points):
        return np.zeros(len(points), int)
    values = points >> kd_shards.HASH_BITS
    dim = int(np.argmax(values.max(0) - values.min(0)))
    order = np.argsort(points[:, dim], kind="stable")
    upto, goal = np.cumsum(weights[order]), weights.sum() * (leaves // 2) / leaves
    k = int(np.searchsorted(upto, goal))
    k += abs(upto[k] - goal) <= abs(goal - (upto[k - 1] if k else 0))  # the nearer side
    out = np.zeros(len(points), int)
    out[order[:k]] = plain_tree(points[order[:k]], weights[order[:k]], leaves // 2)
    out[order[k:]] = leaves // 2 + plain_tree(points[order[k:]], weights[order[k:]], leaves - leaves // 2)
    return out


@pytest.mark.parametrize(("n", "leaves"), [(400, 7), (900, 16), (30, 40), (5, 1), (1, 3)])
def test_tree_equals_exact_medians(spark, monkeypatch, n, leaves):
    monkeypatch.setattr(kd_shards, "NEAR", 0.0)
    rng = np.random.default_rng(n)
    points = rng.integers(0, [2**63 - 1, 2**55, 2**50], (n, 3), np.int64)
    points[: n // 3, 1] = points[0, 1] >> kd_shards.HASH_BITS << kd_shards.HASH_BITS | points[: n // 3, 1] & (2**kd_shards.HASH_BITS - 1)  # equal values, apart by their hashes
    weights = rng.integers(1, 1000, n)
    items = spark.createDataFrame([(i, int(w), *map(int, p)) for i, (w, p) in enumerate(zip(weights, points))], "i long, weight long, k0 long, k1 long, k2 long")
    tree = kd_shards.kd_tree(items.drop("i"), leaves)
    got = {r.i: r.shard for r in items.select("i", tree.shard([F.col(f"k{d}") for d in range(3)]).alias("shard")).collect()}
    assert [got[i] for i in range(n)] == plain_tree(points, weights, leaves).tolist()


def test_shards_of_a_target_size(spark, docs):
    got = kd_shards.sharded(docs, target_bytes=60_000).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    whole, largest = sum(r.w for r in got), max(len(r.text.encode()) for r in docs.collect())
    assert len(got) == -(-whole // 60_000) and max(r.w for r in got) <= 60_000 + 2 * largest


def test_names_differ_behind_what_they_share(spark):
    rows = [(i, f"text {i:03d} " * 20, "en", f"collection_{i % 4}", 9) for i in range(400)]
    got = kd_shards.sharded(spark.createDataFrame(rows, DOCS), 4).collect()
    of = defaultdict(set)
    for r in got:
        of[r.doc_id % 4].add(r.shard)
    assert sorted(map(len, of.values())) == [2] * 4  # cut by doc_id first, then by source


def test_null_rows_are_dealt(spark):
    rows = [(None, None, None, None, None)] * 2000 + [(i, f"t{i}", "en", "a", 9) for i in range(1000)]
    got = kd_shards.sharded(spark.createDataFrame(rows, DOCS), 10).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    assert len(got) == 10 and max(r.w for r in got) < 1.15 * sum(r.w for r in got) / 10


def test_hot_group_is_split(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", "en", "a", 9) for i in range(3000)]
    got = kd_shards.sharded(spark.createDataFrame(rows, DOCS), 10).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    w = [r.w for r in got]
    assert len(w) == 10 and max(w) < 1.1 * sum(w) / 10


# 6, 9


@pytest.mark.parametrize(("query", "table"), [("op6_toxicity", "toxic"), ("op9_quality", "quality")])
def test_classifiers(spark, query, table):
    d = "/root/testdata/sf0.1"
    got = QUERIES[query](spark, d).join(read(spark, d, "labels").select("doc_id", table if table == "quality" else F.col("toxic").alias("truth")), "doc_id")
    rows = [(r[table if table == "quality" else "truth"], r.score, r.predicted) for r in got.where("held_out").collect()]
    assert len(rows) > 500 and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in rows)
    assert np.mean([y == p for y, _, p in rows]) > 0.98


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd(spark, odd, empty, module):
    labels = spark.createDataFrame([(5, 1, 0), (2, 0, 1), (4, 1, None), (None, 1, 1), (7, None, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    run = module.toxicity if module is toxicity else module.quality
    got = run(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in run(odd, labels.limit(0)).collect()} == {0.5}
    assert run(empty, labels).count() == 0


def test_scorer_equals_model():
    rng = np.random.default_rng(8)
    model = toxicity.Convolution.new()
    words = [f"w{i}" for i in rng.integers(0, 500, 70000)]
    model.bias[:] = rng.normal(size=len(model.bias))
    texts = [words[:n] for n in (0, 1, 2, 5, 40000, 0, 3, 70000, 1)] + [words[k : k + 7] for k in range(0, 700, 7)]
    got = toxicity.Scorer(model).pooled(texts)
    for words, own in zip(texts, got):
        ids = np.array([toxicity.word_ids(w) for w in words], np.int32).reshape(-1, 3)
        assert own == pytest.approx(model.pooled(ids)[0], abs=1e-4)


def slopes(loss, array, places, step=1e-5):
    """Numeric derivatives of ``loss`` at some places of an array."""
    out = []
    for at in places:
        was, ends = array[at], []
        for sign in (1, -1):
            array[at] = was + sign * step
            ends.append(loss())
        array[at] = was
        out.append((ends[0] - ends[1]) / (2 * step))
    return out


def log_loss(z, y, weight):
    return np.mean([w * (np.logaddexp(0, -v) if t else np.logaddexp(0, v)) for v, t, w in zip(z, y, weight)])


def test_convolution_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(18)
    model = toxicity.Convolution.new()
    model.emb *= 20
    model.bias[:] = rng.normal(0, 0.3, len(model.bias))
    texts = [np.array([toxicity.word_ids(f"w{i}") for i in rng.integers(0, 40, n)], np.int32).reshape(-1, 3) for n in (0, 1, 2, 9, 30, 12)]
    y, weight = np.array([1, 0, 1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 1.5, 0.7])
    grad = model.gradients(texts, y, weight)
    loss = lambda: log_loss([np.maximum(model.pooled(t)[0], 0) @ model.out[:-1] + model.out[-1] for t in texts], y, weight)
    for name in ("out", "bias", "taps", "emb"):
        array = getattr(model, name)
        places = [tuple(p) for p in np.argwhere(np.abs(grad[name]) > 0)]
        places = [places[i] for i in rng.choice(len(places), min(40, len(places)), replace=False)] + [(0,) * array.ndim]
        assert len(places) > 20
        assert [grad[name][p] for p in places] == pytest.approx(slopes(loss, array, places), abs=1e-6)


def test_machine_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(19)
    features = quality.Features(("kind",))
    rows = [features(t, (k,)) for t, k in (("a few words | here !!", "x"), ("", "y"), ("More text. With lines\nand 3 numbers", None), ("one", "x"))]
    m = quality.blank(np.array([s for _, s in rows]))
    m.w[:], m.w0 = rng.normal(0, 0.2, len(m.w)), 0.4
    data, y, weight = [m.sparse(*r) for r in rows], np.array([1, 0, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0])
    ids, dw, dv, g0 = m.gradients(data, y, weight)
    loss = lambda: log_loss([m.logit(*d)[0] for d in data], y, weight)
    assert dw == pytest.approx(slopes(loss, m.w, ids.tolist()), abs=1e-7)
    some = [(int(i), int(f)) for i in rng.choice(len(ids), 30, replace=False) for f in range(quality.RANK)]
    assert [dv[i, f] for i, f in some] == pytest.approx(slopes(loss, m.v, [(ids[i], f) for i, f in some]), abs=1e-7)
    w0 = m.w0
    ends = []
    for step in (1e-5, -1e-5):
        m.w0 = w0 + step
        ends.append(loss())
    assert g0 == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)


def plain_statistics(text):
    """The statistics straight from their meaning, text by text."""
    import re

    words, n, chars = text.split(), len(text.split()), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    count = lambda pattern: sum(map(len, re.findall(pattern, text)))
    times = [words.count(w) for w in set(words)]
    return [
        np.log1p(chars), np.log1p(n), (chars - n) / n, len(times) / n, max(times) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, count(r"[^\W\d_]+") / chars, count(r"\d+") / chars,
        count(r"[A-ZÀ-ÖØ-Þ]+") / chars, count(r"[^\w\s.,;:'’\"()!?-]") / n, text.count("|") / n, len(re.findall(r"[!?]{2,}", text)) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] not in ".!?" for x in lines) / len(lines),
        sum(len(w) <= 3 for w in words) / n, sum(w.istitle() for w in words) / n, sum(w[-1] in ".!?" for w in words) / n, sum(len(w) >= 15 for w in words) / n,
    ]


def test_statistics(docs, monkeypatch):
    monkeypatch.setattr(quality, "KEPT_WORDS", 500)  # words are forgotten on the way, and one text has more than are kept
    features = quality.Features()
    texts = [r.text for r in docs.limit(60).collect()] + ["Été ÀB x3 3x _a ½ a.b. wow!! ?! (x) a| . \u2003b", " ".join(f"W{i}" for i in range(900))]
    for t in texts:
        ids, stats = features(t)
        assert stats == pytest.approx(plain_statistics(t), rel=1e-6)
        assert sorted(ids.tolist()) == sorted({zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in t.split()})


def test_thresholds_follow_from_histograms():
    right, wrong = np.zeros(1000), np.zeros(1000)
    assert toxicity.threshold(right, wrong) == 0.5
    right[900], right[700], wrong[600], wrong[100] = 50, 50, 10, 1000
    assert toxicity.threshold(right, wrong) == pytest.approx((700 + 601) / 2000)  # 100 of 110 below is short of the aim
    right[650], wrong[650] = 100, 5
    assert toxicity.threshold(right, wrong) == pytest.approx((650 + 601) / 2000)


def test_thresholds_use_every_label_that_was_not_fitted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SCORE_BINS", 10)
    model = toxicity.Convolution.new()
    model.fitted = [0, 1]
    scores = spark.createDataFrame([(i, "en" if i < 60 else "de", 0.95 if i % 2 else (0.65 if i < 60 else 0.15)) for i in range(100)], "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(200, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    own, default = toxicity.calibrated(scores, scores, labels, F.lit(True), model)
    assert own == {"en": pytest.approx(0.8), "de": pytest.approx(0.55)} and default == pytest.approx(0.8)


def test_factorisation_equals_pairs():
    rng = np.random.default_rng(9)
    k = len(quality.STATISTICS)
    n = quality.BUCKETS + k + k * quality.BINS
    m = quality.Machine(np.zeros(k), np.ones(k), np.zeros((k, quality.BINS - 1)), 0.3, rng.normal(size=n), rng.normal(size=(n, quality.RANK)))
    ids, x = m.sparse(*quality.Features(("kind",))("a few words | here !!", ("web",)))
    want = 0.3 + m.w[ids] @ x + sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
    assert m.logit(ids, x)[0] == pytest.approx(want)


# 7


def test_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    extra = spark.createDataFrame([(900, "http://a/ b\r\nX: y", "same é"), (901, None, "same é"), (899, "u", "same é"), (902, "u", None), (903, "u", ""), (None, "u", "same é"), (None, "v", "alone"), (None, "v", "alone"), (904, "u", "twice"), (904, "u", "twice")], "page_id long, url string, html string")
    all_ = pages.select("page_id", "url", "html").unionByName(extra).withColumn("sha", F.lit("clash"))
    manifest = warc.write_warc(all_, roll_bytes=20000, parts=3)
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == all_.count()
    got = warc.read_warc(spark, manifest, with_payload=True).collect()
    rows = {(r.page_id, r.html or "") for r in all_.collect()}
    last = defaultdict(lambda: -1)
    for i, h in rows:
        if i is not None:
            last[h] = max(last[h], i)
    seen = defaultdict(int)
    for r in got:
        html = next(h for i, h in rows if i == r.page_id and base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() == r.payload_digest)
        assert r.payload_bytes == len(html.encode())
        first = last[html] == -1 or r.page_id == last[html] and not seen[r.page_id]
        if r.page_id != 904:
            assert (r.record_type, r.refers_to, r.html) == (("response", None, html) if first else ("revisit", last[html], None))
        seen[r.page_id] += 1
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 904)[1] == ("revisit", 904)
    again = warc.write_warc(all_.repartition(5), roll_bytes=20000, parts=3).collect()
    assert sorted((f.sha1, f.bytes) for f in files) == sorted((f.sha1, f.bytes) for f in again)
    assert warc.read_warc(spark, warc.write_warc(extra.limit(0))).count() == 0


@pytest.mark.parametrize("rolled", [1 << 20, 64 << 20])
def test_warc_bytes_follow_from_the_table_alone(spark, monkeypatch, rolled):
    monkeypatch.setattr(warc, "RUN_BYTES", 1 << 17)
    text = F.concat(F.lit("<p>"), F.repeat(F.md5((F.col("id") % 9001).cast("string")), (F.col("id") % 7 + 1).cast("int")), F.lit("</p>"))
    pages = spark.range(12000).select(F.when(F.col("id") % 3 > 0, (F.col("id") * 7919) % 100003).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), text.alias("html"))
    made = []
    for table, parts in ((pages, "4"), (pages.repartition(9), "4"), (pages.orderBy(F.rand(1)), "7")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made.append(sorted((f.sha1, f.records, f.bytes) for f in warc.write_warc(table, roll_bytes=rolled).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made[0] == made[1] == made[2] and len(made[0]) > 8 and sum(f[1] for f in made[0]) == 12000
    assert max(f[1] for f in made[0]) < 3 * 12000 / len(made[0])  # rows with null ids, a third, are cut too


@pytest.mark.parametrize("cut", [None, 1, 2, 5, 64])
def test_range_cuts(spark, cut):
    rng = np.random.default_rng(20)
    rows = [(f"{k:04d}", int(w)) for k, w in zip(rng.integers(0, 300, 2000), rng.integers(1, 100, 2000))]
    df = spark.createDataFrame(rows, "key string, weight long")
    whole = sum(w for _, w in rows)
    target = lambda w: -(-w // cut) if cut else 10**9
    cuts = range_cuts(df, target)
    assert cuts == range_cuts(df.repartition(7), target) and len(cuts) == (cut or 1) - 1
    got = df.withColumn("run", run_of(F.col("key"), cuts)).collect()
    assert all(r.run == sum(c <= r.key for c in cuts) for r in got)
    loads = defaultdict(int)
    for r in got:
        loads[r.run] += r.weight
    assert max(loads.values()) <= whole / (cut or 1) + 2000
    assert range_cuts(df.limit(0), target) == []


def test_id_keys_keep_the_order(spark):
    ids = [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**40, 2**63 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", id_key("doc_id").alias("k")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.k)] == ids


def test_warc_damage():
    raw = warc.record(1, "u", b"hello", warc.digest32(b"hello"), None, 0)
    body = zlib.decompress(raw, 31)
    assert warc.parsed(body)["payload"] == b"hello"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(body.replace(b"hello", b"hellO"))


# 8


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 100 * 2.5 / 3, 100 * 5 / 3]
    got = mixing.targets([10, 500, 40, 0], [3, 1, 2, 3])
    assert sum(got) == pytest.approx(1.5 * 550) and all(t <= 2 * s for t, s in zip(got, [10, 500, 40, 0]))
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def test_mixing(spark, odd, empty, docs):
    for table, n in ((docs, 200), (odd, len(ODD))):
        got = mixing.mixed(table).collect()
        again = mixing.mixed(table.repartition(3)).collect()
        assert len(got) == n and sorted(map(str, got)) == sorted(map(str, again))
        taken, target = defaultdict(int), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
        rows = mixing.mixture(table).collect()
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == sum(taken.values())
        assert len(rows) == sum(-(-r.taken // r.size) for r in got if r.taken) and {r.doc_id for r in rows} == {r.doc_id for r in got if r.taken}
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).columns == empty.columns


# 10


def test_nearest(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((300, 32))
    v = np.concatenate([base[i % 300] + rng.normal(0, 0.3, 32) for i in range(3000)]).reshape(-1, 32)
    v[5:40] = v[5]  # copies
    rows = [(i, v[i].tolist()) for i in range(3000)] + [(3000, None), (3100, [0.0] * 32), (3200, [float("inf")] * 32), (3300, [1.0, 2.0]), (None, v[0].tolist()), (100, v[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        assert [x[2] for x in got[q]] == list(range(1, 11)) and [x[1] for x in got[q]] == sorted(x[1] for x in got[q]) and all(s == d[i] for i, s, _ in got[q])
        hit += len(set(want.tolist()) & {x[0] for x in got[q]})
        total += 10
    assert hit / total >= 0.9 and 3300 not in got and 3000 not in got
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0), few).count() == 0 and ann.nearest(few, few.limit(0)).count() == 0


def test_recall_is_measured(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    assert ann.recall(ann.nearest(vectors, asked, 10), vectors, asked, 10) >= 0.9
    assert ann.recall(ann.nearest(vectors, asked, 10, exact=True), vectors, asked, 10) == 1 and ann.recall(ann.nearest(vectors, asked.limit(0)), vectors, asked.limit(0)) == 1


def test_pairs_that_rounding_leaves_open_stay():
    rng = np.random.default_rng(21)
    v = rng.normal(0, 1e-7, (400, 8)) + 1e3  # near each other, far from the origin
    v[0] *= 1e180
    ids = np.arange(400)
    with np.errstate(all="ignore"):
        i, j = ann._near(v[5:9], (v[5:9] ** 2).sum(1), ids[5:9], v, (v * v).sum(1), ids, 10)
        for q in range(4):
            d = np.sqrt(((v - v[q + 5]) ** 2).sum(1))
            d[q + 5] = np.inf
            assert set(np.argsort(d, kind="stable")[:10].tolist()) <= set(j[i == q].tolist()) and q + 5 not in j[i == q]


def test_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(11)
    v = rng.normal(0, 0.01, (200, 8)) + 1
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df, 5).collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(200) for j in np.argsort(d[i])[:5]}
    assert len(got) == 1000 and len(want & {(r.query_id, r.vec_id) for r in got}) >= 900


def test_probes_are_in_order():
    at = np.array([0.2, 0.9, 0.5])
    found = list(ann.probes(at, 200))
    cost = [sum((d - a if d > 0 else a - d - 1 if d < 0 else 0) ** 2 for d, a in zip(p, at)) for p in found]
    assert tuple(found[0]) == (0, 0, 0) and cost == pytest.approx(sorted(cost)) and len({tuple(p) for p in found}) == 200


def test_fit_reaches_its_target_for_large_tables():
    sample = np.random.default_rng(12).standard_normal((3000, 64))
    index = ann.Index(sample, 15_000_000, 10)
    keys = [index.key(np.floor(index.place(sample, t)), t) for t in range(getattr(index, "tables", ann.TABLES))]
    hit = 0
    for i, v in enumerate(sample[: ann.SAMPLE_QUERIES]):
        d = ((sample - v) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d)[:10]
        hit += sum(np.any([np.isin(k[near], index.key(index.visited(index.place(v[None], t)[0], index.most), t)) for t, k in enumerate(keys)], axis=0))
    assert hit >= ann.TARGET * 10 * ann.SAMPLE_QUERIES


def test_fit_ends_in_one_cell_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "BLOCK", 64)
    v = np.random.default_rng(13).standard_normal((300, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert ann.Index(v, 300, 10).lines == 0
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df, 10).collect()}
    assert got == {(i, r + 1, int(j)) for i in range(300) for r, j in enumerate(np.argsort(d[i])[:10])}


def test_nearest_completes_queries_off_the_bulk(spark):
    rng = np.random.default_rng(14)
    v = rng.standard_normal((2000, 32))
    v[:20] *= 20
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id < 20 or vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 39 and all(len(set(x)) == 10 for x in got.values())
    hit = sum(len(set(got[q]) & set(np.argsort(np.where(np.arange(2000) == q, np.inf, ((v - v[q]) ** 2).sum(1)))[:10].tolist())) for q in range(20))
    assert hit >= 180


def test_deduplicated_keeps_one_row_of_each_group(spark):
    say = lambda t: " ".join(f"{t}{k}" for k in range(30))
    rows = [(None, say("a")), (None, say("b")), (None, say("c")), (None, say("c")), (None, say("d")), (3, say("d")), (5, say("d")), (5, say("e")), (6, say("f")), (6, say("f")), (7, say("g")), (7, say("h"))]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, "a"), (None, "b"), (None, "c"), (3, "d"), (5, "e"), (6, "f"), (7, "g"), (7, "h")]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={say(t)!r})" for i, t in want)
