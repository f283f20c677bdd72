"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factspark.llm import ann, common, decontaminate, html_extract, jaccard, langid, pieces, quality, substring, token_output, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "zeta"]) + rng.choice("abcdefghij") + rng.choice(["", "", ",", "."]) for _ in range(n))


def nasty():
    rng = random.Random(4)
    passage, base = prose(rng, 60), prose(rng, 200)
    changed = base.split()
    changed[100] = "changed"
    rows = [
        (1, base, "en", "a", 1), (2, " ".join(changed), "en", "a", 1), (3, base, None, None, None), (3, base, None, None, None), (4, None, "en", "a", 0), (5, "", "de", "a", 0), (None, "two words", "en", "b", 9),
        (6, prose(rng, 30) + "\n" + passage + " " + prose(rng, 40), "de", "b", 5), (7, prose(rng, 10) + "  " + passage.replace(" ", "\t") + " " + prose(rng, 3), "de", None, 5), (8, "x " * 500, "de", "c", 1000), (9, prose(rng, 20_000), "en", "c", 7), (10, "§ 1 2 !!", "de", "c", 8), (11, "naïve Ünïcode ß İstanbul don't 12 é", "de", "c", 3),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), DOCS)


@pytest.fixture
def folder(spark):
    return common.work_dir(spark, "test")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_match_a_plain_split():
    texts = [t for _, t, *_ in nasty()]
    w = common.words(pa.array(texts))
    got = [[bytes(w.buf[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [split(t) for t in texts]
    by_hash = dict(zip(w.hash.tolist(), itertools.chain(*got), strict=True))
    assert [[by_hash[h] for h in w.hash[a:b].tolist()] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == got


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_structured_words_are_told_apart(spark, folder):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    w = common.words(pa.array([f"{one} {two}", " ".join(one), " ".join(two)]))
    assert w.hash[0] != w.hash[1]
    spans = common.span_hash(w, w.first[1:-1], w.first[2:])
    assert spans[0] != spans[1]
    tail = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(df, folder).collect()] == [0, 0]
    items = spark.createDataFrame([(7, f"{one} x y z")], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame([(1, f"{two} x y z"), (2, f"{one} x y z")], "doc_id long, text string"), items, folder).select("doc_id").collect() == [(2,)]


def test_word_hashes_depend_on_words_alone():
    rng = random.Random(9)
    word = ["".join(rng.choice("ab é") for _ in range(rng.choice([1, 3, 70, 200]))).replace(" ", "_") for _ in range(300)]
    text = [" ".join(rng.choices(word, k=40)) for _ in range(50)]
    seen = {}
    for i in range(0, 50, 7):
        w = common.words(pa.array(text[i : i + 7]))
        for h, x in zip(w.hash.tolist(), w.spelled().to_pylist(), strict=True):
            assert seen.setdefault(h, x) == x
        spans = common.span_hash(w, w.first[:-1], w.first[1:])
        assert all(common.span_hash(v, v.first[:-1], v.first[1:])[0] == s for s, v in zip(spans, (common.words(pa.array([x])) for x in text[i : i + 7]), strict=True))
    assert len(set(seen.values())) == len(seen)


def test_variable_length_codes():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 4, 0, 11])
    ranks = (2 ** rng.uniform(0, 32, sizes.sum())).astype(np.uint32)
    parts = [token_output.pack(x) for x in np.split(ranks, np.cumsum(sizes)[:-1])]
    assert (token_output.unpack(b"".join(a for a, _ in parts), b"".join(b for _, b in parts), sizes) == ranks).all()


def test_token_output(spark, docs, folder):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = token_output.read_tokens(token_output.write_tokens(docs, folder, path, 2), folder, with_ids=True).collect()
    want = sorted(((i is not None, i or 0, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in nasty()), key=lambda r: r[:2])
    got = sorted(got, key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == sorted(want)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    assert [r.doc_id or 0 for r in got] == sorted(r.doc_id or 0 for r in got)


POOLS = ["abcdefghij", "ABCDEFXYZ", "áéíóúñçßøåæÁÉÍÓÚÑÇØÅÆ", "łśžőāęůŉſıķŁŚŽŐĀĘŮŒĶİ", "0123456789²½", "'’!?.,;:-–—…\"()[]{}<>|@#$%^&*_+=~`/\\", "\n\t\r\x0b\x0c \u3000\u200b\x85\x1c", "日本語한국αβγςΣΩ", "\u0327\u0301\u0308", "🙂ﬁǅȺ"]
SPELLINGS = ["don't", "it's", "We're", "Łódź", "–", "İstanbul", "straße", "hello.", "I'LL", "Œuvre", "e.g.,", "a'b'c", "<|endoftext|>", "Łódź – miasto w Polsce", "Śląsk – region", "Żółw – zwierzę"]


def mixed(rng):
    out = []
    for _ in range(rng.randint(0, 8)):
        out.append(rng.choice(SPELLINGS) if rng.random() < 0.3 else "".join(rng.choice(rng.choice(POOLS)) for _ in range(rng.randint(1, 9))))
        out.append(rng.choice([" ", " ", " ", "", "\n", "  "]))
    return "".join(out)


def test_word_memo_gives_the_library_s_ids():
    encoder = token_output.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(12)
    texts = [mixed(rng) for _ in range(20_000)]
    want = [x.ids + [2] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 500):
        ids, first = encoder.encode(texts[at : at + 500], 2)
        for i, x in enumerate(want[at : at + 500]):
            assert ids[first[i] : first[i + 1]].tolist() == x, texts[at + i]


def test_decontamination(spark, docs, folder):
    rows = nasty()
    passage = " ".join(split(rows[7][1])[35:70])
    items = [(1, passage), (1, passage), (2, "two words"), (3, ""), (None, None), (4, "never seen in any text at all"), (5, " ".join([*passage.split()[:30], "other"]))]
    got = sorted(decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), folder).select("doc_id", "item_id", "shingles", "found").collect(), key=repr)

    def grams(words, n):
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    want = []
    for (d, text, *_), (i, item) in itertools.product(rows, items):
        n = min(5, len(split(item)))
        q = grams(split(item), n) if n else set()
        both = len(q & grams(split(text), n)) if n else 0
        if q and both >= 0.8 * len(q):
            want.append((d, i, len(q), both))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) >= 5


def test_one_shingle_items_are_never_missed(spark, folder):
    rng = random.Random(21)
    texts = [prose(rng, 400) for _ in range(60)]
    items = [(100 * i + j, " ".join(split(t)[at : at + 5])) for i, t in enumerate(texts) for j, at in enumerate(rng.sample(range(390), 5))]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), folder).collect()
    assert {x.item_id for x in found if x.item_id // 100 == x.doc_id} == {i for i, _ in items}


def test_benchmark_in_blocks(spark, docs, folder, monkeypatch):
    rows = nasty()
    items = spark.createDataFrame([(i, " ".join(split(r[1])[:40])) for i, r in enumerate(rows) if r[1]], "item_id long, text string")
    whole = sorted(map(repr, decontaminate.contaminated(docs, items, f"{folder}/a").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert sorted(map(repr, decontaminate.contaminated(docs, items, f"{folder}/b").collect())) == whole and len(whole) > 8


def brute_repeats(texts, window):
    seen = {}
    words = [split(t) for t in texts]
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup(spark, docs, folder):
    rows = nasty()
    got = substring.remove_repeats(docs, folder).collect()
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 35), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_frequent_windows_are_counted_first(spark, docs, folder, monkeypatch):
    rng = random.Random(61)
    passage = prose(rng, 50).split()
    rows = [(i, " ".join([*split(prose(rng, rng.randint(0, 40))), *passage[rng.randint(0, 4) : 50 - rng.randint(0, 4)], *split(prose(rng, rng.randint(0, 40)))]).replace(" ", rng.choice([" ", "  ", "\n"]))) for i in range(80)]
    rows += [(100, "x " * 400), (100, "x " * 400), (None, "x\t" * 90), (101, " ".join(passage)), *((r[0], r[1]) for r in nasty())]
    want = sorted(zip((r[0] for r in rows), brute_repeats([r[1] for r in rows], 35), strict=True), key=repr)
    for hot in (10**9, 3, 0):
        monkeypatch.setattr(substring, "HOT", hot)
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), f"{folder}/{hot}").collect()
        assert sorted(((r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in got), key=repr) == want


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_finds_every_repeated_window(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc" if seed % 2 else "abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    window = 6
    w = common.words(pa.array(texts))
    kept = [i for i, t in enumerate(texts) if len(t.split()) >= window]
    table = pa.table({"passage": pa.array([texts[i].encode() for i in kept]), "places": pa.array([np.array([i, 0], np.int64).tobytes() for i in kept]), "n": pa.array([1] * len(kept), pa.int64()), "name": pa.array([0] * len(kept), pa.int64())})
    got = substring.search_shard(table, window)
    covered = {i: set() for i in range(len(texts))}
    for k, a, b in zip(*(got[c].to_pylist() for c in ("key", "a", "b")), strict=True):
        covered[k].update(range(a, b))
    assert [len(covered[i]) for i in range(len(texts))] == [x[1] for x in brute_repeats(texts, window)] and len(w.hash)


def test_jaccard_join(spark, docs, folder):
    rows = nasty()
    got = jaccard.link(docs, folder).collect()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []) for w in (split(r[1]) for r in rows)]
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    assert (by[1].class_id, by[2].class_id, by[3].class_id) == (1, 1, 1) and (by[1].n_links, by[1].n_copies, by[2].n_links) == (1, 3, 1)
    distinct = {s for s in sets if s}
    links = sum(len(a & b) >= 0.8 * len(a | b) for a, b in itertools.combinations(distinct, 2))
    assert sum({r.text_class: r.n_links for r in got}.values()) == 2 * links == 2
    assert by[4].class_id == 4 and by[5].class_id == 5 and by[None].class_id is None


def test_jaccard_join_against_all_pairs(spark, folder):
    """Links at every similarity from 0.8 on, beside pairs below; recall is measured against all pairs."""
    rng = random.Random(31)
    rows = []
    for g in range(150):
        base = prose(rng, rng.randint(30, 200)).split()
        for k in range(rng.randint(1, 5)):
            words = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((rng.choice([None, 1000 * g + k, 1000 * g]), " ".join(words)))
    cluster = prose(rng, 150).split()
    for k in range(120):  # one dense cluster
        words = cluster[:]
        words[rng.randrange(150)] = f"c{k}"
        rows.append((200_000 + k, " ".join(words)))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (split(t) for _, t in rows)]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    assert len(got) == len(rows)
    distinct = list(dict.fromkeys(sets))
    degree = {s: 0 for s in distinct}
    for a, b in itertools.combinations(distinct, 2):
        if len(a & b) >= 0.8 * len(a | b):
            degree[a] += 1
            degree[b] += 1
    want = sorted((i is None, i or 0, degree[s]) for (i, _), s in zip(rows, sets, strict=True))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_links) for r in got)
    assert sum(x[2] for x in found) >= 0.99 * sum(x[2] for x in want) and sum(x[2] for x in found) <= sum(x[2] for x in want)
    assert found == want and sum(x[2] for x in want) > 100


def test_jaccard_sql_gives_the_same_rows(spark, folder):
    rng = random.Random(41)
    base = [prose(rng, 60).split() for _ in range(6)]
    rows = [*((r[0], r[1]) for r in nasty()), (900, "two words"), (901, "two  words"), (902, " \t"), (903, None), (None, " ".join(base[0]))]
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    want = duckdb.connect().register("documents", documents).execute(jaccard.ORACLE).fetchall()
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("doc_id", "text_class", "class_id", "n_links", "n_copies").collect())
    assert sum(r[3] > 0 for r in want) > 20


def test_null_ids_keep_their_links(spark, folder):
    rng = random.Random(41)
    base = prose(rng, 80).split()
    near = " ".join([*base[:79], "other"])
    got = jaccard.link(spark.createDataFrame([(1, " ".join(base)), (None, near), (None, near), (None, prose(rng, 50))], "doc_id long, text string"), folder).collect()
    assert sorted((r.n_links, r.class_id or -1) for r in got) == [(0, -1), (1, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize("n", [40, 300])
def test_blocks_are_compared_exactly(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(np.concatenate([np.arange(40, dtype=np.uint64)[rng.random(40) < 0.95], rng.integers(100, 140, 3).astype(np.uint64)])) for _ in range(n)]
    got = jaccard.compare_sets(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 0.8)
    for i, j in itertools.product(range(0, n, 7), range(0, n, 5)):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert got[i, j] == (i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9)


def test_runs_reach_the_recall():
    assert 1 - (1 - jaccard.meeting_chance(0.8)) ** jaccard.RUNS >= jaccard.RECALL


def test_runs_reach_the_recall_at_the_deepest_level():
    rng = np.random.default_rng(1)
    met, n = 0, 4000
    for _ in range(n):
        e = rng.integers(0, 1 << 16, (2, jaccard.T)).astype(np.uint16)
        e[1] = np.where(rng.random(jaccard.T) < 0.8, e[0], e[1])
        p, r = jaccard.paths_of(e, jaccard.DEEPEST)
        met += len(np.intersect1d(p[r == 0], p[r == 1])) > 0
    assert met >= n * jaccard.RECALL - 3 * math.sqrt(n * (1 - jaccard.RECALL)) and jaccard.miss_chance(0.8, jaccard.DEEPEST, jaccard.RUNS) <= 1 - jaccard.RECALL


def test_jaccard_join_compares_all_blocks_of_a_large_bucket(spark, folder, monkeypatch):
    for name, value in {"BUCKET": 4, "BLOCK": 3, "NEAR": 0.95, "DEEPEST": jaccard.DEPTH}.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    shared, rows = prose(rng, 900), []
    for i in range(50):  # rows of different pairs are in the same large buckets, but only the two of a pair are near
        own = prose(rng, 100)
        rows += [(2 * i, f"{shared} {own} a"), (2 * i + 1, f"{shared} {own} b")]
    got = {r.doc_id: r for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), folder, threshold=0.97).collect()}
    assert [(got[i].class_id, got[i].n_links) for i in range(100)] == [(i - i % 2, 1) for i in range(100)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/'>Menu</a></nav><div class="cookie-notice">Accept</div><div id="main"><article class="post"><h1>Head &amp; more</h1><p>First <b>bold</b>text
of it.<p>Second &lt;x&gt; part<br>line<script>var a="</p><p>no";</script><form><input value=x>Send</form></p><aside>Side</aside><ul><li>one<li>two</ul></article><section class="comments"><p>Nice!</p></section></div><footer>Foot</footer></body></html>"""


def test_html_extraction(spark, folder):
    rows = [(1, "https://h.example/a", PAGE), (2, "https://h.example/b", PAGE), (3, None, None), (4, "nonsense", ""), (5, "https://other.example/", "just text & more"), (6, "https://h.example/c", "<div>broken <p>one <p>two"), (2, "https://h.example/b", PAGE), (7, "https://h.example/d", "<" * 3000)]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).collect()}
    want = "Head & more First boldtext of it. Second <x> part line one two"
    assert got[1].text == want == got[2].text and got[1].n_chars == len(want)
    assert (got[3].text, got[4].text, got[5].text, got[6].text) == ("", "", "just text & more", "broken one two")


TEXT = "A sentence of the article that is long enough to be its text. " * 5
KEPT = TEXT.strip()


@pytest.mark.parametrize("name", ["content with-sidebar", "site no-sidebar", "page has-header", "widget", "sidebar-layout", "social"])
def test_names_of_a_wrapper_lose_no_article(name):
    for inner in (f"<article><p>{TEXT}</p></article>", f"<main>{TEXT}</main>", f"<p>{TEXT}</p>"):
        for attribute in ("class", "id"):
            assert html_extract.extract(f'<body><div {attribute}="{name}">{inner}</div><div class="site-footer">Foot</div></body>') == KEPT


@pytest.mark.parametrize("part", ['<h2 id="related-work">Part</h2>', '<section id="social-impact">Part</section>', '<p id="side-effects">Part</p>', '<h3 id="comments">Part</h3>', '<div class="side-by-side">Part</div>'])
def test_slugs_lose_no_article_text(part):
    assert html_extract.extract(f"<article><p>{TEXT}</p>{part}</article>") == KEPT + " Part"


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "adBanner", "site-header", "page-footer", "main-nav", "cookie-notice", "related-posts", "share_buttons", "sidebar-left", "newsletter-cta", "comments-area", "post-comments"])
def test_names_of_what_is_not_the_article(name):
    assert html_extract.extract(f'<main><p>{TEXT}</p><div class="{name}"><p>Other</p></div></main>') == KEPT
    assert html_extract.extract(f'<main><p>{TEXT}</p><div class="{name}"><article>Other</article></div></main><p>Outside</p>').startswith(KEPT)
    assert html_extract.extract(f'<div><article><p>{TEXT}</p></article><div class="comments"><div><article class="comment">{TEXT * 9}</article></div></div></div>') == KEPT
    assert html_extract.extract(f'<div class="{name}">{TEXT}</div><article><h1>Short.</h1></article>') == "Short."


@pytest.mark.parametrize("page", [
    '<body><div class="has-sidebar"><article><p>{}</p></article></div></body>', '<body><div class="no-sidebar"><p>{}</p></div>', '<article class="post comments-open"><p>{}</p></article>', '<div class="post comments-open"><p>{}</p></div>',
    '<div class="post sticky-header"><p>{}</p></div>', '<body><form><article><p>{}</p></article></form></body>', '<body><form id="aspnetForm"><div><p>{}</p></div></form><form>Search</form></body>',
])
def test_states_and_forms_lose_no_article(page):
    assert html_extract.extract(page.format(TEXT)) == KEPT


def test_formulas_and_objects_are_text():
    assert html_extract.extract(f"<article><p>{TEXT}<math><mi>x</mi></math> <object>shown</object></p></article>") == KEPT + " x shown"


def test_unmatched_end_tags_take_linear_time():
    import time

    began = time.perf_counter()
    html_extract.extract("<div>" * 20_000 + "</b>" * 20_000)
    assert time.perf_counter() - began < 5


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "ro", "mi"], "bb": ["thu", "shem", "gal"], "cc": ["ñe", "öl", "çé"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(20)), lang) for i, lang in enumerate(list(syllables) * 60)] + [(900, None, "aa"), (901, "12 !!", "aa"), (902, "karomi", None), (None, "thushem", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("held_out", langid.held_out(df.doc_id))
    got = langid.identify(df, langid.train(df, ~df.held_out), ["doc_id", "lang", "held_out"]).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(got) == len(rows) and held and all(r.lang_pred == r.lang for r in held)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got}[900] == ("und", 0.0) == {r.doc_id: (r.lang_pred, r.score) for r in got}[901]
    assert all(0 <= r.score <= 1 for r in got)


def test_codewords_are_apart():
    for n in (2, 4, 9):
        book = langid.codebook(n)
        assert min((a != b).sum() for a, b in itertools.combinations(book, 2)) >= 3


@pytest.mark.parametrize("text", ["the cat", "a  b", "x\ny", "thaï é", "", " ", " end", "▁mark"])
def test_n_best_pieces(text):
    p = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    s, found = p.model.normalize(text), []

    def go(i, score, ids):
        if i == len(s):
            found.append((score, ids))
            return
        known = s[i] in p.scores
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in p.scores:
                go(j, score + p.scores[s[i:j]][0], [*ids, p.scores[s[i:j]][1]])
        if not known:
            go(i + 1, score + p.unknown, ids + [p.byte[b] for b in s[i].encode()])

    go(0, 0.0, [])
    found.sort(key=lambda x: -x[0])
    got = [(x, ids.tolist()) for x, ids in p.encode([text], 5)[0]]
    assert [x for x, _ in got] == [x for x, _ in found[:5]] and all((x, ids) in found for x, ids in got) and len({tuple(i) for _, i in got}) == len(got)
    assert p.decode(np.array(got[0][1], np.int64), np.array([0, len(got[0][1])])) == [text.replace("▁", " ")]


def test_piece_table(spark, docs):
    got = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, n=3, with_nbest=True)
    assert got.count() == len(nasty()) and got.where("not decodes").count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(got, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert back[11] == nasty()[-1][1] and back[4] == ""
    p = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for r in got.collect():
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_crc32 == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in r.nbest_ids]
        assert (r.score, r.ids_crc32, r.n_pieces) == (r.nbest_scores[0], r.nbest_crc32[0], len(r.nbest_ids[0])) and r.second_score == (r.nbest_scores[1] if len(r.nbest_scores) > 1 else None)
        assert len(r.nbest_ids) == len({tuple(x) for x in r.nbest_ids}) == (3 if r.n_pieces > 3 else len(r.nbest_ids))
        assert len(set(p.decode(np.concatenate([np.array(x, np.int64) for x in r.nbest_ids]), np.cumsum([0, *map(len, r.nbest_ids)])))) == 1


def test_long_parts_without_a_mark():
    p = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = "qzj" * 2000 + "日本"
    (one, two) = p.encode([text], 2)[0]
    assert one[0] >= two[0] and p.decode(one[1].astype(np.int64), np.array([0, len(one[1])])) == [text] == p.decode(two[1].astype(np.int64), np.array([0, len(two[1])]))


def test_nearest_neighbours(spark, folder):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.5, 1.5, (600, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0]), (780, [None] * 16), (800, v[3].tolist()), (None, v[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.vec_id % 20 == 0, folder, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    all_ids, every = [*range(600), 800], np.vstack([v, v[3]])
    hit = 0
    for q, found in got.items():
        own = v[3] if q == 800 else v[q]
        want = sorted(((-float(x @ own), i) for i, x in zip(all_ids, every, strict=True) if i != q))[:10]
        hit += len({i for _, i in want} & {i for i, _ in found})
        assert len(found) == 10 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == pytest.approx(float(every[all_ids.index(i)] @ own)) for i, s in found)
    assert set(got) == {*range(0, 600, 20), 800} and hit >= 0.98 * 10 * len(got)


def test_repeated_ids_and_equal_vectors(spark, folder):
    rows = [(40, [1.0, 0.0]), (40, [0.0, 1.0]), (7, [0.6, 0.8]), (3, [0.6, 0.8]), (5, [0.6, 0.8]), (60, [-1.0, 0.1])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, folder, k=4).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault((r.query_id, r.rank), []).append((r.vec_id, round(r.score, 6)))
    assert by[40, 1] == [(3, 0.6), (3, 0.8)] or by[40, 1] == [(3, 0.8), (3, 0.6)]
    assert sorted(by[40, 4]) == [(40, 0.0), (60, 0.1)] and by[60, 1] == [(40, 0.1)] and len(got) == 12


def test_probing_returns_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for r in (0, 3, 5, 8, 11, 17, 25, 40, 64):
        rows, d = index.within(codes[7], r)
        want = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert sorted(rows.tolist()) == np.flatnonzero(want <= r).tolist() and (want[rows] == d).all()


def test_warc(spark, folder):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/ b\r\nX: y", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n"), (1, "http://a/", "<p>é</p>")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = warc.read_archives(manifest).collect()
    import base64

    want = []
    first = {"<p>é</p>": 1, "": 3, "x" * 300_000: 5, "WARC/1.1\r\n\r\n": 6}
    for i, _, h in rows:
        data, again = (h or "").encode(), i is not None and first[h or ""] != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    path = manifest.first().path
    fs, at = common.filesystem(path)
    with fs.open_input_stream(at + ".idx", compression=None) as f:
        entries = [json.loads(x) for x in f.read().decode().splitlines()]
    assert warc.read_record(path, entries[-1]["offset"], entries[-1]["length"]).startswith(b"WARC/1.1\r\n")
    assert not [x for x in os.listdir(os.path.dirname(at)) if x.endswith((".raw", ".part"))]


def test_quality(spark, folder):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        kind = i % 8
        text = prose(rng, rng.randint(30, 120))
        if kind == 1:
            text = " ".join(w + rng.choice(["%%%", "###", "***"]) for w in text.split())
        elif kind == 2:
            text = " ".join(rng.choice(text.split()) for _ in range(3) for _ in [0]) + " " + " ".join([rng.choice(text.split())] * 60)
        elif kind == 3:
            at = text.split()
            for w in ("vilest", "horrid", "nastiest"):
                at.insert(rng.randrange(len(at)), w)
            text = " ".join(at)
        rows.append((i, text))
        if i % 2 or i % 16 == 2:
            labels.append((i, int(kind not in (1, 2)), int(kind == 3)))
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    labels += [(None, 1, 0), (5000, 1, 0), (4, None, 0), (12, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.classify(df, quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder), ["doc_id"]).collect()
    assert len(got) == len(rows)
    judged = {r.doc_id: r.keep for r in got}
    wrong = [i for i in range(400) if judged[i] != (i % 8 not in (1, 2, 3))]
    assert len(wrong) <= 12 and not judged[900] and not judged[901]


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(8)
    kind = rng.choice(3, 40_000, p=[0.7, 0.2, 0.1])
    tables = [np.array(quality.START[k]) for k in quality.NAMES]
    # true tables are not those that the search starts from
    tables[0] = np.array([[0.75, 0.2, 0.05], [0.1, 0.2, 0.7], [0.8, 0.1, 0.1]])
    tables[3] = np.array([[0.6, 0.3, 0.1], [0.3, 0.3, 0.4], [0.7, 0.2, 0.1]])
    tables[8] = np.array([[0.5, 0.48, 0.01, 0.01], [0.5, 0.02, 0.47, 0.01], [0.5, 0.02, 0.01, 0.47]])
    votes = np.stack([(rng.random((len(kind), 1)) > np.cumsum(t, axis=1)[kind][:, :-1]).sum(axis=1) for t in tables], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(prior - [0.7, 0.2, 0.1]).max() < 0.02 and np.allclose(post.sum(axis=1), 1)
    for want, got in zip(tables, found, strict=True):
        assert np.abs(want - got).max() < 0.06


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labels", [[(777, 1, 0)], [(777, 0, 0), (778, 1, 1)], []])
def test_labels_of_unknown_ids_say_nothing(spark, folder, labels):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, prose(rng, 60)) for i in range(20)] + [(i, " ".join(["###"] * 40)) for i in range(20, 24)], "doc_id long, text string")
    got = quality.classify(df, quality.train(df, labels_of(spark, labels), folder), ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got if r.keep) == list(range(20))


def test_repeated_and_null_ids_teach_once(spark, folder):
    rng = random.Random(6)
    texts = [prose(rng, 60) for _ in range(30)]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    model = quality.train(df, labels_of(spark, [(1, 1, 0)]), folder, sample=3)
    assert common.staged(df, folder, "x").count() == 30 and spark.read.parquet(f"{folder}/labelled").collect() == [(1, min(texts), 1)]
    assert quality.classify(df, model, ["doc_id"]).where("keep").count() == 30
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert quality.classify(none, quality.train(none, labels_of(spark, []), f"{folder}/n"), ["doc_id"]).where("keep").count() == 30


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.classify(none, quality.train(none, labels, f"{folder}/q"), ["doc_id"]).count() == 0
    assert token_output.read_tokens(token_output.write_tokens(none, f"{folder}/t", public_tokenizers.path("word_bpe_49k.json"), 2), f"{folder}/t").count() == 0
    assert decontaminate.contaminated(none, items, f"{folder}/d").count() == 0
    assert substring.remove_repeats(none, f"{folder}/s").count() == 0
    assert jaccard.link(none, f"{folder}/j").count() == 0
    assert langid.identify(none, langid.train(none, none.doc_id > 0), ["doc_id"]).count() == 0
    assert pieces.encode(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages, f"{folder}/h").count() == 0
    assert warc.read_archives(warc.write_archives(pages, f"{folder}/w")).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True), f"{folder}/a").count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(51)
    base, passage = prose(rng, 150), prose(rng, 70)
    changed = base.split()
    changed[50] = "changed"
    item = prose(rng, 25)
    rows = [(i, prose(rng, rng.randint(40, 150))) for i in range(60)]
    rows += [(100, base), (101, base), (102, " ".join(changed)), (103, prose(rng, 60) + " " + passage), (104, passage + " " + prose(rng, 60)), (105, prose(rng, 50) + " " + item + " " + prose(rng, 20)), (106, " ".join(["###"] * 50)), (107, None), (108, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels_of(spark, [(i, 1, 0) for i in range(30)] + [(106, 0, 0), (999, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # rejected, copies and near copies, contaminated documents are gone; words of the repeated passage too
    kept = [(i, t) for i, t in rows if i not in (106, 107, 108)]
    group = {100, 101, 102}
    one = group & set(got)
    assert len(one) == 1 and set(got) == {i for i, _ in kept} - group - {105} | one
    left = [(i, t) for i, t in kept if i not in group or i in one]
    model = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    gone = brute_repeats([t for _, t in left], 35)
    for (i, t), (_, removed, sha) in zip(left, gone, strict=True):
        if i in got:
            text = t
            if removed:
                at = t.find(passage)
                text = (t[:at] + t[at + len(passage) :]).strip()
                assert hashlib.sha256(text.encode()).hexdigest() == sha
            score, ids = model.encode([text], 1)[0][0]
            assert (got[i].n_pieces, got[i].ids_crc32, got[i].score) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes()), score) and got[i].decodes
    assert [x[1] for (i, _), x in zip(left, gone, strict=True) if i in (103, 104)] == [70, 70]


def test_clashing_columns(spark, folder):
    odd = spark.createDataFrame([(*r, 1, "x", True, 5, "y") for r in nasty()], DOCS + ", key int, n_words string, keep boolean, id int, node string")
    plain = odd.select("doc_id", "text", "lang")

    def rows(df):
        return sorted(map(repr, df.collect()))

    items = spark.createDataFrame([(1, "two words", 3)], "item_id long, text string, id int")
    path = public_tokenizers.path("word_bpe_49k.json")
    for name, f in {
        "a": lambda d, at: decontaminate.contaminated(d, items, at), "b": lambda d, at: substring.remove_repeats(d, at), "c": lambda d, at: jaccard.link(d, at), "d": lambda d, at: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
        "e": lambda d, at: token_output.read_tokens(token_output.write_tokens(d, at, path, 2), at), "f": lambda d, at: quality.classify(d, quality.train(d, labels_of(spark, [(1, 1, 0)]), at), ["doc_id"]), "g": lambda d, at: langid.identify(d, langid.train(d, d.doc_id > 0), ["doc_id"]),
    }.items():
        assert rows(f(odd, f"{folder}/{name}1")) == rows(f(plain, f"{folder}/{name}2")), name


def test_pipeline_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = spark.createDataFrame([(*r, 1, "x", True) for r in nasty()], DOCS + ", key int, n_words string, keep boolean")
    for name, stage in corpus_pipeline.STAGES:
        for given in (odd, odd.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            if name != "pieces":
                assert out.columns == odd.columns
            if name == "near_duplicates" and rows:
                assert len([r for r in rows if r.doc_id in (1, 2, 3)]) == 1 and len(rows) == len(nasty()) - 3
            if name == "decontamination" and rows:
                assert len(rows) == len(nasty()) - 1
