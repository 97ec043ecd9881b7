"""Rows that share an id or a text with a removed one."""

import random

import corpus_pipeline
from tidecast.llm import decontamination, simhash


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_stage_links_as_the_operator_does(spark):
    rng, texts = random.Random(31), [None, "", "a b", "A  b"]
    for _ in range(8):
        base = _words(rng, rng.randint(200, 400))
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base, "more"]), " ".join(_words(rng, 1) + base[1:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {r["component"] for r in simhash.near_duplicate_groups(docs).collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert 8 < len(want) < len(texts) - 12 and sorted(kept) == sorted(want)


def test_simhash_removal_is_per_row(spark):
    rng = random.Random(33)
    base, other, third = (" ".join(_words(rng, 60)) for _ in range(3))
    rows = [(1, base), (None, base.upper()), (None, other), (5, third), (5, third.upper()), (5, other + " " + base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert (1, base) in kept and (None, other) in kept and (5, other + " " + base) in kept
    assert len(kept) == 4 and sum(k in [(5, third), (5, third.upper())] for k in kept) == 1


def test_decontamination_is_per_row(spark):
    rng = random.Random(34)
    item, one, two, three = (" ".join(_words(rng, 30)) for _ in range(4))
    clean, leaked = [(None, one), (None, None), (5, two), (5, two), (6, three)], [(None, f"{one} {item}"), (5, f"{three} {item}")]
    docs = spark.createDataFrame(clean + leaked, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = [tuple(r) for r in decontamination.drop_contaminated(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted(clean, key=str)


def test_contaminations_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(35)
    item = " ".join(_words(rng, 30))
    edited = item.replace("a", "z", 2)
    docs = spark.createDataFrame([(1, item), (1, item), (2, edited)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (7, edited), *((k, " ".join(_words(rng, 30))) for k in range(10, 20))], "item_id long, text string")
    one = sorted(map(tuple, decontamination.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 256)
    assert sorted(map(tuple, decontamination.contaminations(docs, bench).collect())) == one
    assert [r[:3] for r in one] == [(1, 7, 0), (1, 7, 0), (2, 7, 0)]
