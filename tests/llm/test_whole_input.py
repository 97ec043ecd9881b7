"""Results that come from the whole input instead of its beginning or a sample."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import decontamination, quality, url_rules


def test_url_rules_read_every_token(spark):
    common = "/".join(f"part{k}" for k in range(14))
    urls = [(f"http://h{k % 7}.net/{common}/{'casino' if k % 2 else 'news'}/{k}", "block" if k % 2 else "allow") for k in range(120)]
    labelled = spark.createDataFrame(urls, "url string, verdict string")
    pages = spark.createDataFrame([(1, f"http://new.net/{common}/casino/x"), (2, f"http://new.net/{common}/news/x"), (3, "http://new.net/casino")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in url_rules.judge(pages, labelled, []).collect()}
    assert got == {1: ("block", "path:casino"), 2: ("allow", "path:news"), 3: ("block", "path:casino")}


def test_url_rules_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for _ in range(400):
        tokens = [x for x in "abcdef" if rng.random() < (0.6 if x in "abc" else 0.4)]
        bad = ("a" in tokens and "d" in tokens and rng.random() < 0.9) or ("b" in tokens and "e" in tokens and "f" not in tokens) or rng.random() < 0.05
        rows.append((tokens, "block" if bad else "allow"))
    held = [(set(t), v) for t, v in rows if t]
    sure = {}
    for bits in range(1, 64):
        part = {x for k, x in enumerate("abcdef") if bits >> k & 1}
        for verdict in ("allow", "block"):
            n, hits = sum(part <= t for t, _ in held), sum(part <= t and v == verdict for t, v in held)
            if hits >= 8 and hits / n >= 0.7 and hits / n / (sum(v == verdict for _, v in held) / len(held)) >= 1.1:
                sure[frozenset(part), verdict] = hits / n
    want = {k: c for k, c in sure.items() if not any(less < k[0] and v == k[1] and d >= c for (less, v), d in sure.items())}
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 8, 0.7, 1.1).collect()
    assert {(frozenset(r["tokens"]), r["verdict"]): round(r["confidence"], 9) for r in mined} == {k: round(c, 9) for k, c in want.items()}
    assert len(mined) == len(want) and max(len(k[0]) for k in want) >= 3


def test_quality_learns_from_every_label(spark):
    """The bad documents that come last by hash, beyond the 6 000 of the former sample, are bad in a way of their own."""
    bad = [r["id"] for r in spark.range(6100).withColumn("h", F.xxhash64("id", F.lit(3))).orderBy("h", "id").collect()]
    late = set(bad[6000:])
    rows = [(k, f"thE hoUSe and a gaRDen lIE hEre nuMBer {k}" if k in late else f"the #### house %%%% and $$$$ garden {k}", 0) for k in bad]
    rows += [(k, f"the house and a garden lie here number {k}", 1) for k in range(10_000, 10_100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    scores = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()}
    assert all((scores[k] >= quality.CUT) == bool(good) for k, _, good in rows)


def test_quality_pairs_use_each_row_by_its_weight(spark, monkeypatch):
    monkeypatch.setattr(quality, "GROUP_ROWS", 40)
    monkeypatch.setattr(quality, "PAIRS", 1)
    rows = spark.createDataFrame([(0, [float(k)], 1 + k % 3) for k in range(400)] + [(1, [1000.0], 2)], "label int, features array<double>, weight long")
    pairs = quality._pairs(rows, {0: 400, 1: 1}, 1).collect()
    drawn = {}
    for p in pairs:
        bad = 1000.0 - abs(p["apart"][0])
        drawn[bad] = drawn.get(bad, 0) + p["weight"]
        assert (p["apart"][0] > 0) == (p["label"] == 1)
    assert {k: round(w, 6) for k, w in drawn.items()} == {float(k): 2 * (1 + k % 3) for k in range(400)}  # two rounds


def test_walks_end_early_without_losing_a_hit(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(30)) for k in range(20)]
    texts = [f"{prose(60)} {items[k % 20][1][k % 5 :]} {prose(60)}" for k in range(40)]
    raw = np.frombuffer(" ".join(texts).encode() + bytes(decontamination.STEPS + 1), dtype=np.uint8)
    starts = np.arange(0, len(raw) - decontamination.STEPS - 1, 2)
    index, ended = decontamination.Index(items, 0.8), []
    whole = index.walks.keys
    monkeypatch.setattr(index.walks, "keys", lambda *given: ended.append(whole(*given)) or ended[-1])
    got = {tuple(row) for row in index.candidates(raw, starts).tolist()}
    assert sum(len(part) for part, _ in ended) < 0.5 * decontamination.WALKS * len(starts)
    wide, held = raw.astype(np.intp), {}
    for key, where in zip(index.keys.tolist(), index.where.tolist()):
        held.setdefault(key, []).append(where)
    want = set()
    for w in range(decontamination.WALKS):
        for keys in whole(w, wide, starts, lambda steps, key: slice(None))[1]:
            want |= {(s, *where) for s, key in zip(starts.tolist(), keys.tolist()) for where in held.get(key, [])}
    assert got == want and len(want) > 500
    found = {(k, i) for k, i, *_ in decontamination.matches(index, texts)}
    assert found >= {(k, k % 20) for k in range(40)}


def test_filters_send_each_text_to_python_once(spark):
    """A second copy of every text beside its row would double what a batch holds on both sides."""
    docs = spark.createDataFrame([(1, "###$$$ BUY | BUY !!! " * 9), (2, "some plain prose of a few words."), (3, None)], "doc_id long, Text string")
    items = spark.createDataFrame([(0, "some plain prose of a few words.")], "item_id long, text string")
    size = len(quality.FEATURES)
    weights = np.zeros(size)
    weights[quality.FEATURES.index("symbol_share")] = -1.0
    good = quality.keep_good(docs, quality.Model(np.zeros(size), np.ones(size), weights, -0.2, 0.5, 10.0), text="text")
    clean = decontamination.drop_contaminated(docs, items, text_column="text")
    for df, ids in ((good, [2, 3]), (clean, [1, 3])):
        sent = re.findall(r"MapInArrow \w+\(([^)]*)\)", df._jdf.queryExecution().analyzed().toString())
        assert sent and not any("," in columns for columns in sent)
        assert sorted(r["doc_id"] for r in df.collect()) == ids and df.columns == docs.columns
