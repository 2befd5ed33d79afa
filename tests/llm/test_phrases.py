"""Operator 12 against counting by hand and its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from stepweave.llm import phrases as P


def test_index_counts_every_phrase():
    rng = random.Random(4)
    ids = [0]
    for _ in range(300):
        ids += [rng.randint(1, 6) for _ in range(rng.randint(0, 9))] + [0]
    runs = [[int(c) for c in r.split(",") if c] for r in ",".join(map(str, ids)).split(",0")]
    want = [Counter(tuple(r[i : i + k]) for r in ([x for x in r if x] for r in runs) for i in range(len(r) - k + 1)) for k in range(5)]
    index = P.ShardIndex(np.array(ids), 7)
    word, ahead, behind, n = index.words()
    phrases = [(int(w),) for w in word]
    assert dict(zip(phrases, n.tolist(), strict=True)) == want[1]
    for k, left in ((2, True), (3, False), (4, True)):
        at, other = (ahead, behind) if left else (behind, ahead)
        group, word, at, other, n = index.extend(at, other, n, left)
        ahead, behind = (at, other) if left else (other, at)
        phrases = [(int(w), *phrases[g]) if left else (*phrases[g], int(w)) for g, w in zip(group, word, strict=True)]
        assert dict(zip(phrases, n.tolist(), strict=True)) == want[k]


def test_pieces():
    text = "A b\tC,d;e.f:g!h?i\nj\x0bk\rl  ÉTÉ x"
    want = [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text.replace("A", "a").replace("C", "c").replace("T", "t"))]
    assert [[w.decode() for w in p] for p in P.pieces(text)] == want


def against_sql(made, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    names = sorted(made.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({P.OP12_SQL})").fetchall()
    got = [tuple(r) for r in made.select(*names).collect()]
    assert sorted(got) == sorted(want)
    return got


def test_odd_rows_as_sql(spark):
    rng = random.Random(50)
    words = ["alpha", "Beta", "gamma", "délta", "e-e", "new", "york", " ", "x" * 3000]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None, "und"])) for i in range(400)]
    rows += [(i, "new york city hall" * (i % 3) + " new york is big", "en") for i in range(60)] + [(None, None, "en"), (7, "", None), (8, " \t ", "fr"), (9, "tick tock " * 1000, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'own' AS phrase", "1 AS n", "'own' AS size")
    made = P.collocations(*P.counts(df))
    assert len(against_sql(made, rows)) > 5


def test_empty(spark):
    assert against_sql(P.collocations(*P.counts(spark.createDataFrame([], "doc_id long, text string, lang string"))), []) == []


class _Held:
    def __init__(self, value):
        self.value = value


def test_shards_sum_to_the_whole(monkeypatch):
    """Counts of many small shards of many languages, added, are those of one."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"lang": [f"l{i % 3}" for i in range(200)], "text": texts})
    every = _Held(b"\xff" * (P.FILTER_BITS // 8))

    def counted():
        total, pairs = Counter(), Counter()
        for out in P._phrases_of(every, every)(iter([batch])):
            for row in out.to_pylist():
                lang, phrase = row["key"].split("\t")
                total[lang, phrase, len(phrase.split())] += row["n"]
        for out in P._pairs_of(every)(iter([batch])):
            for row in out.to_pylist():
                n = len(row["blob"]) // 5
                for key, own in zip(np.frombuffer(row["blob"], np.uint32, n), row["blob"][4 * n :], strict=True):
                    pairs[row["group"], int(key)] += own
        return total, pairs

    whole, pairs = counted()
    assert {s for _, _, s in whole} == {0, 1, 2, 3, 4} and sorted(pairs.values()) == sorted(min(n, P.LEAST) for (_, _, s), n in whole.items() if s == 2)
    monkeypatch.setattr(P, "SHARD_WORDS", 50)
    assert counted()[0] == whole


def test_triples_carry_their_quadruples():
    class Every:
        value = bytes([255]) * (P.FILTER_BITS >> 3)

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(30)) for _ in range(20)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    flat = [r for b in P._phrases_of(Every, Every)(iter([batch])) for r in b.to_pylist()]
    carried = [r for b in P._phrases_of(Every, Every, carry=True)(iter([batch])) for r in b.to_pylist()]
    assert len(carried) == sum(r["key"].count(" ") < 3 for r in flat) < len(flat)  # no row of its own for four words
    apart = Counter({r["key"]: r["n"] for r in carried})
    for r in carried:
        lang, tail = r["key"].split("\t")
        for head in filter(None, (r["heads"] or "").split("\t")):
            word, n = head.split(" ")
            apart[f"{lang}\t{word} {tail}"] += int(n)
    assert apart == Counter({r["key"]: r["n"] for r in flat})


def test_words_carry_longer_phrases():
    class Every:
        value = bytes([255]) * (P.FILTER_BITS >> 3)

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "dd", "é"]) for _ in range(30)) for _ in range(20)]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    flat = [r for b in P._phrases_of(Every, Every)(iter([batch])) for r in b.to_pylist()]
    carried = [r for b in P._phrases_of(Every, Every, carry=3)(iter([batch])) for r in b.to_pylist()]
    assert len(carried) == sum(r["key"].count(" ") < 1 for r in flat) < len(flat)  # no row of its own for more than a word
    apart = Counter({r["key"]: r["n"] for r in carried})

    def tell(core, told):
        word, n = told.split(" ") if " " in told else (told, "1")
        phrase = f"{word[1:]} {core}" if word.startswith(":") else f"{core} {word}"
        assert f"en\t{phrase}" not in apart
        apart[f"en\t{phrase}"] = int(n)
        return phrase

    for r in carried:
        for two in filter(None, (r["heads"] or "").split(",")):
            two, *threes = two.split("\n")
            pair = tell(r["key"].split("\t")[1], two)
            for three in threes:
                three, *heads = three.split("\t")
                triple = tell(pair, three)
                for head in heads:
                    tell(triple, ":" + head)
    assert apart == Counter({r["key"]: r["n"] for r in flat})


def test_frequent_short_words_gather_nothing():
    """What is about very frequent words goes in rows of the rarer ones beside them."""
    class Every:
        value = bytes([255]) * (P.FILTER_BITS >> 3)

    texts = [f"of the house{i} of the tree{i % 7}" for i in range(200)]
    rows = [r for b in P._phrases_of(Every, Every, carry=3)(iter([pa.record_batch({"lang": ["en"] * len(texts), "text": texts})])) for r in b.to_pylist()]
    told = {r["key"].split("\t")[1]: r["heads"] or "" for r in rows}
    assert told["of"] == "" and told["the"] == ":of 400" and all(len(told[f"house{i}"]) < 40 for i in range(200)) and ":the\n:of" in told["house3"]
