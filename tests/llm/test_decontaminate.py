"""Items found in texts against all pairs in plain Python, and openings that many items share."""

import random
import time

import pyarrow as pa
import pytest

from factspark.llm.decontaminate import Items, contained


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(texts, items, threshold):
    out = []
    for r, text in enumerate(texts):
        for i, item in enumerate(items):
            words = (item or "").split(" ") if item else []
            if words:
                n = min(5, len(words))
                want = shingles(words, n)
                got = len(want & shingles((text or "").split(" "), n))
                if got >= threshold * len(want) - 1e-9 and got:
                    out.append((r, i, len(want), got))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("seed", range(4))
def test_all_pairs(seed, threshold):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range((3, 12, 100, 1000)[seed])]
    items = [" ".join(rng.choices(voc, k=rng.choice([1, 2, 4, 5, 6, 9, 20, 24, 40, 90]))) for _ in range(40)]
    texts = []
    for _ in range(25):
        words = rng.choices(voc, k=rng.randint(1, 150))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items).split(" ")
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(" ".join(words))
    items += [None, "", items[0]]
    texts += [None, "", texts[0]]
    got = contained(pa.array(texts, pa.string()), Items(list(range(len(items))), items, threshold))
    # the number of an item counts texts that are neither null nor empty
    place = [i for i, t in enumerate(items) if t]
    assert sorted((r, place[i], *rest) for r, i, *rest in got) == plain(texts, items, threshold)


@pytest.mark.parametrize("length", [8, 40])
def test_an_opening_that_all_items_share_costs_little(length):
    rng = random.Random(1)
    words, others = ([f"{c}{i}" for i in range(5000)] for c in "vu")
    items = Items(list(range(20000)), ["which of the following is " + " ".join(rng.choices(words, k=length)) for _ in range(20000)])
    texts = pa.array(["which of the following is " + " ".join(rng.choices(others, k=300)) for _ in range(10)])
    start = time.perf_counter()
    assert contained(texts, items) == []
    assert time.perf_counter() - start < 1
