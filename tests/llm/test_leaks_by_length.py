"""Recall of leaked items by their length."""

import random

import pytest

from tidecast.llm import decontamination


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("klmnop")
        elif kind == 1:
            out.insert(k, rng.choice("klmnop"))
        else:
            del out[k]
    return "".join(out)


def prose(rng, n):
    """Words of n characters in all."""
    words = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))
    return words[: n - 1].rstrip().ljust(n, "x")


@pytest.mark.parametrize("length", [24, 26, 28, 40, 63])
def test_short_items_are_found_whole(length):
    rng = random.Random(length)
    items = [(k, prose(rng, length)) for k in range(40)]
    index = decontamination.Index(items, 0.8)
    for edits in (0, int(0.2 * length)):
        texts = [f"{prose(rng, 200)} {edited(rng, t, edits)} {prose(rng, 200)}" for _, t in items]
        found = {(k, i) for k, i, *_ in decontamination.matches(index, texts)}
        assert {(k, k) for k in range(40)} <= found


def test_longer_items_at_most_of_the_allowance():
    rng = random.Random(81)
    items = [(k, prose(rng, 81)) for k in range(150)]
    index = decontamination.Index(items, 0.8)
    texts = [f"{prose(rng, 200)} {edited(rng, t, 12)} {prose(rng, 200)}" for _, t in items]
    found = {(k, i) for k, i, *_ in decontamination.matches(index, texts)}
    assert sum((k, k) in found for k in range(150)) >= 0.85 * 150
