"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import pytest

from factspark.llm import align, common

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def two():
    return align.pair(*FILES)


def brute(two, rows):
    """Each text encoded whole; bytes and ends by plain loops."""
    docs = []
    for id_, text in rows:
        groups = links = None
        if text:
            a = two.a.encode(" " + text, add_special_tokens=False).ids
            b = two.b.encode(text)
            if b"".join(two.a_bytes[i] for i in a) == b"".join(two.b_bytes[i] for i in b) == (" " + text).encode():
                ends = []
                for ids, table in ((a, two.a_bytes), (b, two.b_bytes)):
                    at, out = 0, []
                    for i in ids:
                        at += len(table[i])
                        out.append(at)
                    ends.append(out)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                groups, low = [], 0
                for c in cuts:
                    groups.append(",".join(str(i) for i, e in zip(a, ends[0], strict=True) if low < e <= c) + "|" + ",".join(str(j) for j, e in zip(b, ends[1], strict=True) if low < e <= c))
                    low = c
                by_end = {}
                for i, e in zip(a, ends[0], strict=True):
                    by_end.setdefault(e, []).append(i)
                links = [(i, j) for j, e in zip(b, ends[1], strict=True) for i in by_end.get(e, [])]
                docs.append((id_, len(a), len(b), groups, links))
                continue
        docs.append((id_, 0, 0, [], []))
    count = Counter(x for d in docs for x in d[4])
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((i, a, b, len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, x in docs), key=str)


def odd_texts():
    rng = random.Random(6)
    signs = ["word", "Größe", "12345", "don't", "  ", "\n", "\t", " ", "　", " ", "日本語", "привет", "कि", "🙂👍🏽", ".", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "x1", "\x00", "\x85", "é", "\x1c", "Ａ"]
    texts = ["".join(rng.choice(signs) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    fixed = [" ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "a\t\n  b", "▁", "a ▁ b", "x  y", "plain", "plain", "abc" * 3000, "日本" * 2000, "word " * 20_000, " 'tis it's I'LL", "tab\t word"]
    return [None, "", *fixed, *texts]


def test_alignment(spark, two, monkeypatch):
    monkeypatch.setattr(align, "STEP", 3000)  # many batches
    rows = [(i if i != 5 else None, t) for i, t in enumerate(odd_texts())] + [(1, "again and again"), (1, "again and again"), (None, "again")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, batch int, names string, n_a int").repartition(3)
    got = align.align(docs, *FILES, common.work_dir(spark, "test")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(two, rows)


def test_parts_join_to_the_text(two):
    import pyarrow as pa

    texts = [t or "" for t in odd_texts()]
    parts, n = two.cut(pa.array(texts))
    parts, at = parts.to_pylist(), 0
    for text, k in zip(texts, n.tolist(), strict=True):
        assert "".join(" " + p for p in parts[at : at + k]) == (" " + text if text else "")
        at += k


def test_links_of_a_group_with_several_common_ends(two):
    a = [two.a.encode(" a", add_special_tokens=False).ids[0]]
    b = two.b.encode("a")
    assert two.links(f"{a[0]}|{b[0]}") == [(a[0], b[0], 1)]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "▁")]])
def test_tables_without_tokens(spark, rows):
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), *FILES, common.work_dir(spark, "test")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows), key=str)


class Noted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode(self, texts, **options):
        self.given.append(len(texts))
        return self.tokenizer.encode(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.given.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def alone(two, parts):
    """The ids of each part, encoded by itself, if both give its bytes back."""
    out = []
    for t in parts:
        a, b = two.a.encode(" " + t, add_special_tokens=False).ids, two.b.encode(t)
        out.append((a, b) if b"".join(two.a_bytes[i] for i in a) == b"".join(two.b_bytes[i] for i in b) == (" " + t).encode() else ([], []))
    return out


def listed(two, parts):
    import numpy as np
    import pyarrow as pa

    ids, n = two.encoded(pa.array(parts, pa.large_string()))
    return list(zip(*([x.tolist() for x in np.split(flat, np.cumsum(k)[:-1])] for flat, k in zip(ids, n, strict=True)), strict=True))


def test_parts_are_encoded_together(two, monkeypatch):
    parts = [f"word{i}," for i in range(5000)]
    want = alone(two, parts)
    a, b = Noted(two.a), Noted(two.b)
    monkeypatch.setattr(two, "a", a)
    monkeypatch.setattr(two, "b", b)
    assert listed(two, parts) == want
    assert sum(a.given) == sum(b.given) <= 20  # texts of 4 kB; each of the 5000 parts was a text of its own before


@pytest.mark.parametrize("together", [1, 30, 4096])
def test_parts_beside_ones_that_do_not_come_back(two, monkeypatch, together):
    monkeypatch.setattr(align, "TOGETHER", together)
    ends = ["x▁y", "▁", "end ", " begin", "two\n", "\n", "three　", "　three", "nbsp\xa0", "x" * 5000, "日本語", "<s>", "<|endoftext|>", "-", "é", "\x85", "Ａ", "🙂"]
    rng = random.Random(3)
    parts = [*ends, *(rng.choice([*ends, *(f"w{i}" for i in range(30))]) for _ in range(600)), "x▁y"]
    assert listed(two, parts) == alone(two, parts)
    assert any(not a for a, _ in alone(two, parts))
    assert listed(two, ["x▁y", "z"]) == alone(two, ["x▁y", "z"])
    assert listed(two, ["x▁y"]) == [([], [])]
