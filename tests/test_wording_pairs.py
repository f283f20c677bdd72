import difflib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from factspark.operators import wording


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("letters", ["ab", "0123456789", "abcé数", "\0\x7fa"])
def test_signs_are_matched_as_difflib_does(letters):
    rnd = random.Random(letters)
    for _ in range(60):
        head = "xyz#"[: rnd.randint(0, 4)] + "q" * rnd.randint(0, 3)
        n, m = rnd.randint(1, 14), rnd.randint(1, 14)
        a, b = ([head + "".join(rnd.choice(letters) for _ in range(k)) for _ in range(80)] for k in (n, m))
        x, y = wording.signs(pa.array(a), n + len(head)), wording.signs(pa.array(b), m + len(head))
        if x.dtype != y.dtype:
            x, y = x.astype(np.uint32), y.astype(np.uint32)
        want = [sum(k.size for k in difflib.SequenceMatcher(None, p, q).get_matching_blocks()) for p, q in zip(a, b, strict=True)]
        assert list(wording.matched_signs(x, y)) == want


def test_judged_by_signs_or_by_difflib():
    rnd = random.Random(1)
    a = [f"name {rnd.randrange(300):06d}" for _ in range(4000)] + ["y" * 300, "x", "été 1", "abc"]
    b = [f"name {rnd.randrange(300):06d}" for _ in range(4000)] + ["y" * 299 + "z", "x", "ete 1", "abcdefgh"]
    got = wording.judged(pa.array(a), pa.array(b), 0.9).to_pylist()
    assert [(r["a"], r["b"], r["ab"], r["ba"]) for r in got] == [(x, y, ratio(x, y), ratio(y, x)) for x, y in zip(a, b, strict=True) if max(ratio(x, y), ratio(y, x)) >= 0.9]


def test_variants_in_columns_are_those_of_plain_python(spark):
    texts = ["abcdefghijklmnopqr", "aabbccddeeffgghhii", "é数数x" * 4, "short", "aaaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {}
    for r in wording.dealt_variants(df, 0.92, {len(t) for t in texts}).collect():
        got.setdefault(r.text, []).append(r.piece)
        assert r.at == 0 and r.piece == r.text or r.piece == r.text[: r.at - 1] + r.text[r.at :] and (r.at == 1 or r.text[r.at - 2] != r.text[r.at - 1])
    for t in texts:
        want = {v[1:] for v in wording.variants(t, 0.92)} - (set() if len(t) + 1 in map(len, texts) else {t})
        assert sorted(got.get(t, [])) == sorted(want if len(t) > 12 else ())


def test_numbered_names_are_neither_cut_to_pieces_nor_met_twice(spark, monkeypatch):
    """Names of one length meet by variants alone, each pair once, also those that alternate two signs (12 and 21, 121 and 212) or have runs."""

    def no(*_):
        raise AssertionError("pieces of names that have no partner of another length")

    monkeypatch.setattr(wording, "piece_counts", no)
    names = [f"item#{i:06d}x" for i in (*range(160), 1010, 10101, 101010, 10102, 110011, 1100, 11001, 121212, 212121, 111111, 111112, 211111)]
    got = [(r.a, r.b, r.ab, r.ba) for r in wording.similar_wordings(spark.createDataFrame([(n,) for n in names], "text string"), 0.91).collect()]
    want = [(a, b, ratio(a, b), ratio(b, a)) for a, b in itertools.combinations(sorted(names), 2)]
    assert sorted(got) == [x for x in want if max(x[2:]) >= 0.91] and len(got) > 1000


def test_lengths_next_to_each_other_meet_once(spark):
    rnd = random.Random(7)
    texts = sorted({"".join(rnd.choice("ab1") for _ in range(rnd.randint(20, 44))) for _ in range(40)} | {"a" * n for n in range(18, 44)} | {"ab" * n for n in range(9, 22)} | {"ba" * n for n in range(9, 22)})
    for threshold in (0.85, 0.95, 0.97):
        got = sorted((r.a, r.b, r.ab, r.ba) for r in wording.similar_wordings(spark.createDataFrame([(t,) for t in texts], "text string"), threshold).collect())
        every = [(a, b, ratio(a, b), ratio(b, a)) for a, b in itertools.combinations(texts, 2)]
        assert got == [x for x in every if max(x[2:]) >= threshold]
