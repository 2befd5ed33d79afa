"""Suffix, passage and near-duplicate dedup against brute force, and their edge cases."""

import random

import duckdb
import numpy as np
import pytest

from stepweave.llm import jaccard, passages, suffixes
from stepweave.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def sample(sf):
    return {d: t or "" for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}


def planted(seed):
    """Texts with shared passages cut at odd places, small edits, repeats within a text, and copies."""
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(60, 200))) for _ in range(6)]
    out = {}
    for d in range(40):
        words = " ".join(rng.choices(WORDS, k=rng.randint(0, 60))).split()
        for _ in range(rng.randint(0, 3)):
            words += base[rng.randrange(6)].split()[rng.randint(0, 20) : rng.randint(40, 200)]
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = "edit"
        out[d * 7 % 41] = " ".join(words)
    out[90], out[91] = out[3], "ab" * 400
    out[92] = "ab" * 300 + "c"
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 64), (1, 0), (2, 1), (3, 3)])
def test_against_brute_force(spark, docs_of, seed, hot):
    texts = planted(seed)
    raw = {d: t.encode() for d, t in texts.items()}
    cut = suffixes.suffix_dedup(docs_of(texts), hot).selectExpr("doc_id", "n_removed", "n_spans", "sha2(kept, 256) s").collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.s) for r in cut} == suffixes.kept_by_brute_force(raw)
    cut = passages.passage_dedup(docs_of(texts), hot).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) s").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.s) for r in cut} == passages.kept_by_brute_force(raw)


def test_queries_on_a_sample(spark, sf):
    texts = sample(sf)
    raw = {d: t.encode() for d, t in texts.items()}
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op3_suffixes(spark, sf).collect()}
    assert got == suffixes.kept_by_brute_force(raw)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.op4_passages(spark, sf).collect()}
    assert got == passages.kept_by_brute_force(raw)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10_jaccard(spark, sf).collect()}
    assert got == jaccard.components_by_brute_force(texts)


@pytest.mark.parametrize("run", [suffixes.suffix_dedup, passages.passage_dedup])
def test_one_doc_id_with_unlike_texts_is_cut_row_by_row(docs_of, run):
    first, second = (" ".join(f"{x}{i:03}" for i in range(90)) for x in "uv")
    rows = {(r.doc_id, r.text): r.n_removed for r in run(docs_of([(1, first), (5, "short"), (5, first + " end"), (5, second), (5, "x " + second)])).collect()}
    assert rows[5, "short"] == rows[5, second] == rows[5, "x " + second] == rows[1, first] == 0 and rows[5, first + " end"] in (90, len(first))


def test_the_automaton_decides(spark, docs_of, monkeypatch):
    """Without the automaton's occurrences, parts of unlike stretches stay."""
    rng = random.Random(8)
    shared = rng.choices(WORDS, k=70)
    mine = np.array([int(w) if w.isdigit() else hash(w) & 0xFFFF for w in shared], np.uint64)
    before, after = (np.arange(7000 + i, 7010 + i, dtype=np.uint64) for i in (0, 500))
    flat = np.concatenate([before, mine, after, after, mine, before])
    edge, ids = np.array([0, 90, 180]), np.array([4, 9])
    key = passages.rolled(mine[30 : 30 + passages.SEED], passages.SEED) >> np.uint64(16)
    keys = np.repeat(key, 2)
    which, window = passages._resolve(flat, edge, np.arange(2), ids, keys)
    assert set(which.tolist()) == {1} and set(window.tolist()) <= set(range(10, 31)) and len(window) == 21
    none = np.empty(0, np.int64)
    monkeypatch.setattr(passages, "occurrences", lambda words, edges, seeds: (none, none, none))
    assert len(passages._resolve(flat, edge, np.arange(2), ids, keys)[0]) == 0


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(1)
    flat = np.concatenate([np.tile(np.frombuffer(b"abcabd", np.uint8), 60), rng.integers(97, 99, 600).astype(np.uint8)])
    at = rng.permutation(len(flat) - 50)
    order, heads = suffixes.suffix_order(flat, at)
    strings = [flat[p : p + 50].tobytes() for p in at[order]]
    assert strings == sorted(strings)
    assert [i for i in range(len(strings)) if i == 0 or strings[i] != strings[i - 1]] == heads.tolist()


@pytest.mark.parametrize("run", [suffixes.suffix_dedup, passages.passage_dedup])
def test_odd_rows(odd, nothing, run):
    made = run(odd)
    rows = made.collect()
    assert len(rows) == 11 and "hash" in made.columns
    long = sorted(r.n_removed for r in rows if r.doc_id in (4, 5))
    assert long[0] == 0 and long[1] == long[2] > 50_000
    assert all(r.n_removed == 0 for r in rows if r.doc_id not in (4, 5, None))
    assert all(len(r.kept) == 0 for r in rows if r.doc_id in (1, 2))
    assert run(nothing).collect() == []


def near(rng, n, edits):
    words = rng.choices(WORDS, k=n)
    other = list(words)
    for _ in range(edits):
        other[rng.randrange(n)] = f"e{rng.random()}"
    return " ".join(words), " ".join(other)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_of_all_sizes(spark, docs_of, seed):
    rng, texts = random.Random(seed), {}
    for n in [*range(1, 24), 30, 40, 55, 61, 70, 90, 150, 300]:
        for edits in (0, 1, 2, 3, 5):
            a, b = near(rng, n, edits)
            texts[len(texts) * 3 + 1] = a
            texts[len(texts) * 3 + 1] = b.upper()
    common = " ".join(rng.choices(WORDS, k=60))
    for _ in range(60):  # unlike texts that share a passage
        texts[len(texts) * 3 + 1] = common + " " + " ".join(rng.choices(WORDS, k=rng.randint(10, 90)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(texts)).collect()}
    assert got == jaccard.components_by_brute_force(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_by_another_rule(spark, docs_of, seed):
    rng, texts = random.Random(seed), {}
    for n in [*range(1, 24), 30, 40, 55, 61, 70, 90, 150, 300]:
        words = rng.choices(WORDS, k=n)
        for other in (words, [*words, "more"], ["less", *words, "more"]):
            texts[len(texts) * 3 + 1] = " ".join(other)
        for edits in (1, 2, 3, 5, 7):
            for text in near(rng, n, edits):
                texts[len(texts) * 3 + 1] = text
    rule = jaccard.Rule(5, 80, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(texts), *rule).collect()}
    assert got == jaccard.components_by_brute_force(texts, rule)
    assert any(n == 5 and got[c][0] == 4 for n, c in got.values())  # the smallest sets that link


@pytest.mark.parametrize(("seed", "short"), [(1, 1), (2, 4), (3, 24)])
def test_near_duplicates_in_one_large_group(spark, docs_of, monkeypatch, seed, short):
    """Variants of one text, families of them that share edits, and chains whose ends are far from the first text."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    rng, texts = random.Random(seed), {}
    for n, edits in ((24, (1, 2)), (90, (1, 2, 3, 4, 6)), (160, (2, 4, 7))):
        base = rng.choices(WORDS, k=n)
        for _ in range(5):
            family = list(base)
            for at in rng.sample(range(n), max(edits)):
                family[at] = rng.choice(WORDS)
            for _ in range(9):
                words = list(rng.choice([base, family]))
                for at in rng.sample(range(n), rng.choice(edits)):
                    words[at] = rng.choice(WORDS)
                texts[len(texts) * 7 % 997] = " ".join(words)
            for at in rng.sample(range(n), 8):  # a chain
                family[at] = rng.choice(WORDS)
                texts[len(texts) * 7 % 997] = " ".join(family)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs_of(texts)).collect()}
    assert got == jaccard.components_by_brute_force(texts)


def test_differences_decide_links():
    """least_shared() never asks for more than a linking pair has."""
    rng, rule = random.Random(2), jaccard.Rule(4, 85, 100)
    for _ in range(20_000):
        n = rng.randint(6, 60)
        lead = set(range(n))
        x = lead ^ set(rng.sample(range(n + 12), rng.randint(0, min(n + 12, 40))))
        y = x ^ set(rng.sample(range(n + 12), rng.randint(0, 6)))
        gaps = [(len(s ^ lead), 185 * len(s ^ lead) - 15 * len(s)) for s in (x, y)]
        near = [e <= 15 * n for _, e in gaps]
        if x and y and 100 * len(x & y) >= 85 * len(x | y) and not all(near):
            shared = len((x ^ lead) & (y ^ lead))
            assert all(shared >= jaccard.least_shared(e, len(s), n, c, rule) for s, (_, e), c in zip((x, y), gaps, near, strict=True))
            assert 370 * shared >= gaps[0][1] + gaps[1][1]


def test_near_duplicates_odd_rows(odd, nothing):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (6, 1, 6), (7, 1, 6), (None, 1, None), (9, 1, 9)} <= rows
    assert {c for d, _, c in rows if d in (4, 5)} == {4}
    assert jaccard.near_duplicates(nothing).collect() == []


def test_one_doc_id_with_different_texts(docs_of):
    rng = random.Random(5)
    (a, a2), (b, b2), (c, c2) = (near(rng, n, 1) for n in (90, 80, 12))
    e, g, h = (" ".join(rng.choices(WORDS, k=n)) for n in (30, 50, 70))
    c2 = c + " more"
    rows = [(3, b2), (2, b), (2, a2), (1, a), (4, None), (4, c), (9, c2), (12, ""), (12, None), (20, e), (25, g), (27, e), (27, g), (30, h), (31, h), (31, "  ")]
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in jaccard.near_duplicates(docs_of(rows)).collect()}
    roots = {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 12: 12, 20: 20, 25: 20, 27: 20, 30: 30, 31: 30}
    assert got == {(d, bool((t or "").strip()), roots[d]) for d, t in rows}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(3, 9), (9, 5), (7, 7), (200, 150)]
    found = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {i: 100 for i in range(100, 141)} | {3: 3, 5: 3, 9: 3, 150: 150, 200: 150}


def test_boundary_is_the_cheapest():
    assert 5 <= jaccard.boundary({}) <= jaccard.SMALL_MOST
    assert jaccard.boundary({8: 1000}) >= 8 and jaccard.boundary({60: 1000}) < 51
