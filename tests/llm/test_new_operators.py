"""The prefix trie, hard negatives and the Jaccard join against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidecast.llm import hard_negatives, jaccard_join, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _trie(rows):
    """{depth, members}: the columns of every node, from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    seqs = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        under = [x for x in nodes if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        ends = sorted(c for c in members if len(seqs[c]) == len(node))
        out.append(
            (
                min(members),
                len(node),
                min(nodes[node[:-1]]) if node else None,
                len(members),
                sum(len(x) == len(node) + 1 for x in under),
                sum(leaf(x) for x in under),
                sum((len(nodes[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in under if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(None, 1, "user", "lost"), (7, 0, None, None), (7, None, "", ""), (0, 5, "user", "a b")]
    for c in [*range(1, 70), 100, 119, 20007]:
        for k in range(rng.randint(1, 2 + (c == 41) * 70)):
            rows.append((c, k, rng.choice(["user", "bot", None]), rng.choice(["a b", "a  b c", "", None, "é ü"])))
    rows += [(c, k, "user", f"same {k}") for c in range(200, 300) for k in range(3 + c % 2)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int").repartition(5)
    got = prefix_trie.prefix_trie(docs)
    assert sorted(map(tuple, got.collect()), key=str) == _trie(rows)
    assert prefix_trie.prefix_trie(docs.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(docs.filter("conv_id IS NULL")).count() == 0


def test_repeated_turns_of_a_long_conversation(spark):
    """A conversation over many tasks keeps each turn once, in order, whatever their number."""
    rows = [(5, k // 3, "user", f"t{k // 3}") for k in range(900)] + [(6, 0, "user", "t0")]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)).collect()
    own = sorted((r["pos"], r["name"]) for r in turns if r["conv_id"] == 5)
    assert [p for p, _ in own] == list(range(900))
    assert all(own[k][1] == own[k - k % 3][1] for k in range(900)) and len({n for _, n in own}) == 300


def test_ids_of_a_hot_node_are_joined_in_pieces():
    node = b"n" * 16
    batch = pa.RecordBatch.from_arrays([pa.array([node] * 10_000, pa.binary()), pa.array(range(10_000), pa.int64())], ["node", "conv_id"])
    pieces = list(prefix_trie._id_pieces(iter([batch.slice(0, 5000), batch.slice(5000)])))
    assert sum(p.num_rows for p in pieces) == 3
    (got,) = prefix_trie._streamed_digests(p.select(["node", "ids"]) for p in pieces)
    assert got.column(1).to_pylist() == [hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()]


def _negatives(rows, anchors):
    """Over (id, label, whole numbers): the contract's rows by sorting all others."""
    out = []
    for a in rows:
        if a[0] % anchors:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r is not a))
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("dims, chunk, block", [(64, 4096, 512), (5, 7, 3)])
def test_negatives_equal_brute_force(spark, dims, chunk, block):
    rng = np.random.default_rng(12)
    vectors = np.round(rng.normal(size=(160, dims)) / 4, 2)
    vectors[20:40] = vectors[20]  # equal scores
    rows = [(k, int(k) % 3, vectors[k].tolist()) for k in range(160)]
    odd = [(None, 1, rows[0][2]), (900, None, rows[0][2]), (901, 1, None), (902, 1, [None] * dims), (903, 1, [float("nan")] * dims), (904, 1, [float("inf")] * dims)]
    short = [(906, 2, [0.5]), (910, 1, [])]
    frame = spark.createDataFrame([(*r, 0) for r in rows + odd + short], "vec_id long, label int, embedding array<double>, key int").repartition(4)
    usable = hard_negatives.usable(frame)
    got = hard_negatives.mine(usable, F.col("id") % 10 == 0, chunk_rows=chunk, block_anchors=block)
    whole = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows + short]
    want = _negatives(whole, 10)
    assert len(want) > 40 and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(usable.limit(0), F.col("id") % 10 == 0).count() == 0


def test_summaries_bound_every_score():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-256, 256, (40, 64)), rng.integers(-256, 256, (50, 64))
    exact, mine, other = a @ b.T, hard_negatives.Summaries(a), hard_negatives.Summaries(b)
    widths = []
    for level in range(len(hard_negatives.LENGTHS)):
        low, high = mine.bounds(level, np.arange(40), other, np.arange(50))
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (3, 2, [0.8]), (4, 2, [0.8]), (5, 2, [0.1])]
    frame = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("id") == 0).collect()))
    assert got == sorted([(0, 0, k + 1, n, 65536, 256 * 204) for _ in range(2) for k, n in enumerate((3, 4))])


@pytest.mark.parametrize("scale, labels", [(1.0, 1), (1.0, 60), (1e5, 3), (3e6, 3)])
def test_negatives_of_many_cells(spark, monkeypatch, scale, labels):
    """Rows and anchors in many cells, with scores that are exact in floats, in doubles and in neither; few and many labels."""
    monkeypatch.setattr(hard_negatives, "PAIRS", 1)
    rng = np.random.default_rng(14)
    rows = [(k, int(rng.integers(labels)), np.round(scale * rng.uniform(-1, 1, 5), 2).tolist()) for k in range(300)]
    usable = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    assert min(hard_negatives.dealing(300, 30, 5, 7)) > 1
    got = hard_negatives.mine(usable, F.col("id") % 10 == 0, chunk_rows=7, block_anchors=4)
    want = _negatives([(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows], 10)
    assert (len(want) > 40) == (labels > 1) and sorted(map(tuple, got.collect())) == want


def test_vectors_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Neither many chunks nor many blocks multiply what is shuffled, and no row holds many vectors."""
    sent, kind = [], type(spark.range(1))
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: sent.append(self) or run(self, *a, **b))
    rows = [(k, k % 3, [float(k % 7), 1.0]) for k in range(400)]
    frame = hard_negatives.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    hard_negatives.mine(frame, F.col("id") % 50 == 0, chunk_rows=8, block_anchors=2).count()
    for given in sent:
        lists = [F.size(f.name) for f in given.schema if f.dataType.simpleString().startswith("array<struct")]
        (n,) = given.select(F.sum(sum(lists, F.lit(0)) if lists else F.lit(1))).first()
        assert not lists and n <= 2 * len(rows)
    assert len(sent) == 2
    for n in (10**5, 10**7, 10**9):
        groups, parts = hard_negatives.dealing(n, n // 50, 64, hard_negatives.ROWS)
        assert n * 64 / groups <= hard_negatives.HELD and parts <= hard_negatives.PARTS and groups <= max(25, 1 + n * 64 // hard_negatives.HELD)


def test_levels_that_pay_discard_no_wanted_row():
    rng = np.random.default_rng(15)
    vectors = np.repeat(rng.integers(-90, 90, (900, 64)), 16, axis=1) + rng.integers(-3, 4, (900, 1024))  # even segments
    chunks = [{"key": np.arange(k, k + 300), "id": np.arange(k, k + 300), "label": np.ones(300, dtype=np.int64), "vectors": vectors[k : k + 300]} for k in (0, 300, 600)]
    low, high = np.full((40, 2), -(2**62)), np.full((40, 2), 2**62)
    high[:, 1] = 10**6
    anchors = {"key": np.arange(40), "label": np.zeros(40, dtype=np.int64), "vectors": vectors[:40], "low": low, "high": high}
    levels = hard_negatives.Levels()
    block = hard_negatives.Block(anchors, False, 3, levels)
    for chunk in chunks:
        block.meet(chunk)
    assert not levels.rests[0]
    exact, got = vectors[:40] @ vectors.T, block.found().to_pydict()
    want = [(a, w, exact[a, r], r) for w in (0, 1) for a in range(40) for r in sorted((r for r in range(900) if r != a and exact[a, r] <= high[a, w]), key=lambda r: (-exact[a, r], r))[:3]]
    assert sorted(zip(got["anchor_key"], got["window"], got["score"], got["id"])) == sorted(want)


def _set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


@pytest.mark.parametrize("cut, list_size", [(None, 1 << 16), (0, 1 << 16), (10**6, 1 << 16), (30, 2)])
def test_jaccard_groups_equal_brute_force(spark, cut, list_size):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(30)]
    texts = [None, "", " \t", "a b", "A  b", "a b c", "É x", "é x", "a b c d e f g h i", "a b c d e f g h i j", "x" * 3000]
    for _ in range(9):
        base = [word() for _ in range(rng.randint(8, 120))]
        texts.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy + [word()] * rng.randint(0, 2)))
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(20)] + texts[20:30] * 3
    sets, root = [_set(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert 60 < len(set(root)) < len(texts) - 40
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard_join.jaccard_groups(docs, cut=cut, list_size=list_size).collect()}
    assert got == {k: (len(s), r) for k, (s, r) in enumerate(zip(sets, root))}


def _linked(x, y, percent=85):
    return 100 * len(x & y) >= percent * len(x | y)


@pytest.mark.parametrize("percent, cut", [(85, 0), (85, 40), (60, 0)])
def test_linked_sets_have_a_key_in_common(percent, cut):
    """Also where only shared shingles are keyed and the frequent ones come last."""
    rng = random.Random(7)
    sets = []
    for n in [2, 5, 6, 7, 8, 12, 13, 14, 30, 31, 90, 400] * 4:
        base = {rng.randrange(1 << 64) for _ in range(n)}
        sets += [base | {rng.randrange(1 << 64) for _ in range(k)} - set(rng.sample(sorted(base), k)) for k in range(0, n // 5 + 2)]
        sets += [set(list(base)[k:]) | {rng.randrange(1 << 64) for _ in range(k)} for k in range(0, n // 6 + 2)]
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    sizes = np.array([len(s) for s in sets])
    plain = [set(k.tolist()) for k in jaccard_join.part_keys(arrays, sizes, percent, cut)]
    held = {}
    for s in sets:
        for x in s:
            held[x] = held.get(x, 0) + 1
    shared = [np.array([x for x in a.tolist() if held[x] > 1], dtype=np.uint64) for a in arrays]
    some = [k for k, a in enumerate(shared) if len(a)]
    late = [np.array([held[x] > 4 for x in shared[k].tolist()]) for k in some]
    anew = jaccard_join.part_keys([shared[k] for k in some], sizes[some], percent, cut, sizes[some] - [len(shared[k]) for k in some], late)
    anew = {k: set(x.tolist()) for k, x in zip(some, anew)}
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] != sets[b] and _linked(sets[a], sets[b], percent)]
    assert len(pairs) > 200
    assert all(plain[a] & plain[b] and anew[a] & anew[b] for a, b in pairs)


def test_family_of_near_copies_does_not_meet_in_pairs(spark, monkeypatch):
    """Copies with few edits join through one of them, those with many go by the shingles that no other holds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(120)], []
    for k in range(300):
        copy = list(base)
        for _ in range(1 if k < 150 else 8):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    judged, judge = [], jaccard_join.settle
    monkeypatch.setattr(jaccard_join, "settle", lambda df: (out := judge(df), judged.append(out.count()) if "links" in df.columns else None)[0])
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component"] for r in jaccard_join.jaccard_groups(docs, list_size=8).collect()}
    assert all(got[k] == 0 for k in range(150))
    assert sum(judged) < 2000  # of 44 850 pairs


def test_jaccard_groups_of_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d E"), (3, "other text"), (None, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_groups(docs).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 1, 3), (None, 0, None), (None, 0, None)], key=str)
    assert jaccard_join.jaccard_groups(docs.limit(0)).count() == 0


def test_long_lists_go_out_as_they_come(monkeypatch):
    """Every entry of a list carries one number, however the list falls over batches and the buffer."""
    rng = random.Random(5)
    lists = {s: sorted(rng.sample(range(1000), rng.choice([1, 2, 40, 90]))) for s in range(30)}
    rows = [(s, n, 0) for s, nodes in lists.items() for n in nodes for _ in range(rng.choice([1, 1, 2]))]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], ["shingle", "node", "frequency"])
    monkeypatch.setattr(jaccard_join, "_BUFFER", 50)
    for size in (7, 64, 5000):
        got = [r for b in jaccard_join._shared(whole.slice(a, size) for a in range(0, len(rows), size)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(got) == len(set(got))
        numbers = {}
        for node, shingle, frequency in got:
            numbers.setdefault(shingle, set()).add(frequency)
        assert {(s, n) for n, s, _ in got} == {(s, n) for s, nodes in lists.items() if len(nodes) > 1 for n in nodes}
        assert all(len(f) == 1 and (f == {len(lists[s])} or len(lists[s]) > 50) for s, f in numbers.items())


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for size in (1, 50, 3000):
        a = set(rng.integers(-(2**62), 2**62, size).tolist())
        b = set(sorted(a)[: size // 2]) | set(rng.integers(-(2**62), 2**62, 40).tolist())
        bits = sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(jaccard_join.parities(list(a)), jaccard_join.parities(list(b))))
        assert 0 < bits <= len(a ^ b)
