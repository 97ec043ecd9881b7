import hashlib
import random

from tidecast.llm import suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for k in range(len(r) - length + 1):
            seen[r[k : k + length]] = seen.get(r[k : k + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randint(15, 90)) for _ in range(4)]
    texts = [None, "", "short", "ab " * 400, "x" * 900, prose(400)]
    for _ in range(30):
        parts = [prose(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[a : len(p) - rng.randint(0, len(p) // 4)])
        texts.append("".join(parts))
    return texts + texts[-3:] + [texts[5][:300] + "!" + texts[5][300:]]


def run(spark, texts, length, **options):
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, gram string").repartition(5)
    rows = suffix_dedup.remove_repeats(docs, length, **options).drop("kept_bytes").collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_equals_brute_force(spark):
    texts = fixture(1)
    assert run(spark, texts, 120) == brute(texts, 120)


def test_crowded_grams_give_the_same(spark):
    texts = fixture(2)
    assert run(spark, texts, 120, hot=2) == brute(texts, 120)


def test_order_is_that_of_bytes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    strings += [strings[0] * 3, b"", b"a" * 99, b"a" * 98]
    for shallow in (0, 8, 32):
        order = suffix_dedup.deep_shallow_order(strings, shallow)
        assert sorted(order) == list(range(len(strings))) and [strings[k] for k in order] == sorted(strings)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
