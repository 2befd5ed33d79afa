"""BPE, media, toxicity, quality, decontamination, licences and sharding: results, fixtures and edge cases."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import bpe, common, decontamination, licenses, media, quality, sharding, toxicity
from stepweave.llm.queries import ORACLE, QUERIES

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def test_bpe_agrees_with_the_library(spark, sf, docs_of, odd, nothing):
    tokenizer = bpe.load(bpe.tokenizer_path())
    strange = ["<|endoftext|>x a<|startoftext|> b <|ENDOFTEXT|>.", "İstanbul é ́x \x1c y it's 'S don't.", "a" * 5000, "x.y.. z., a!. B.", "  　", "Á. É, ß. 12.", None, "", " \n"]
    rng = random.Random(3)
    strange += ["".join(rng.choices("aBé .,'<|>\t\ń s1", k=300)) for _ in range(40)]
    for path in (None, sf):
        docs = docs_of(dict(enumerate(strange))) if path is None else spark.read.parquet(f"{sf}/documents.parquet")
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in bpe.round_trip(docs, bpe.tokenizer_path()).collect():
            ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    byte_level = bpe.tokenizer_path("byte_bpe_50k.json")
    tokenizer = bpe.load(byte_level)
    texts = {i: t or "" for i, t in enumerate(strange)}
    for r in bpe.round_trip(docs_of(texts), byte_level).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(odd, bpe.tokenizer_path()).count() == 11
    assert bpe.encode(nothing, bpe.tokenizer_path()).count() == 0


def across_spaces():
    """A tokenizer of a few merges that cross white space, so that joins of chunks do not agree."""
    from tokenizers import Tokenizer, models

    merges = [("a", " "), ("a ", "b"), (" ", "b"), ("b", "b"), (" b", " "), ("a b", "a b"), ("b", " a"), (" ", "a")]
    names = dict.fromkeys(["a", "b", " ", *[x + y for x, y in merges], " a", "b a"])
    return Tokenizer(models.BPE({n: i for i, n in enumerate(names)}, merges))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", None])
def test_bpe_joins_of_many_short_chunks(name):
    tokenizer = bpe.load(bpe.tokenizer_path(name)) if name else across_spaces()
    rng = random.Random(5)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t ", "the ", " of", ".", "'s", "12", "<|endoftext|>", "\u0301", "        ", "İ", "\xa0", "\x85 ", "\x1c", "ÀŸſ", "<|ENDOFTEXT|>", "a\u0308"] if name else ["a", "b", " "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 400))) for _ in range(200)]
    encoder, repaired = bpe.Encoder(tokenizer, 3, 20_000), []
    whole = encoder.joined
    encoder.joined = lambda *sides: repaired.append(1) or whole(*sides)
    for text, ids in zip(texts, encoder.texts(*common.raw_bytes(pa.array(texts))), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert bool(repaired) == (name is None)


def test_media_round_trip(spark, docs_of, odd, nothing):
    for docs in (docs_of({1: "abc", 2: None, 3: "abc", 4: "é" * 700, 5: "x" * 576}), odd):
        places, folder = media.store_media(docs)
        found = places.join(media.read_media(places, folder), "digest").join(media.media_metadata(places, folder), "digest").collect()
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        assert len(found) == docs.count()
        for r in found:
            raw = texts[r.doc_id]
            payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.n_bytes, r.payload_bytes, r.width, r.height, r.bits) == (len(raw), len(payload), 576, len(payload) // 576, 8)
            assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
            with open(f"{folder.removeprefix('file://')}/{r.shard}", "rb") as f:
                f.seek(r.offset)
                stored = f.read(r.length)
            assert stored == media.png(payload) and (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
            lines = [payload[i : i + 576] for i in range(0, len(payload), 576)]
            bins = [sum(b // 32 == k for b in payload) for k in range(8)]
            assert r.feature == f"576x{len(lines)};sum={sum(payload)};grad={sum(abs(a - b) for x in lines for a, b in zip(x, x[1:], strict=False))};hist={','.join(map(str, bins))}"
    places, folder = media.store_media(nothing)
    assert places.count() == 0 and media.read_media(places, folder).count() == 0


def test_metadata_needs_headers_alone(spark, docs_of):
    """Payloads cut off after their headers still give their metadata."""
    places, folder = media.store_media(docs_of({d: f"{d} " * 400 for d in range(5)}))
    rows = places.collect()
    for shard in {r.shard for r in rows}:
        path = f"{folder.removeprefix('file://')}/{shard}"
        raw = bytearray(open(path, "rb").read())
        for r in rows:
            if r.shard == shard:
                raw[r.offset + 33 : r.offset + r.length] = bytes(r.length - 33)
        open(path, "wb").write(raw)
    assert {(r.width, r.height > 0, r.bits) for r in media.media_metadata(places, folder).collect()} == {(576, True, 8)}


def test_media_refuses_damage():
    raw = bytearray(media.png(b"a" * 576))
    raw[45] ^= 1
    with pytest.raises(ValueError):
        media.png_samples(bytes(raw))


def test_levenshtein_automaton_against_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [last := i, *[last := min(row[j] + 1, last + 1, row[j - 1] + (x != y)) for j, y in enumerate(b, 1)]]
        return row[-1]

    lexicon = ["idiot", "clown", "worthless", "scum", "abba", "baabaa"]
    automaton = toxicity.LexiconAutomaton({t: toxicity.allowed(t) for t in lexicon}, {"chlla": 0})
    rng = random.Random(1)
    words = {"".join(rng.choices("abclownidt", k=rng.randint(1, 9))) for _ in range(3000)} | {"idiiot", "idot", "id1ot", "wrthles", "scumm", "chllando", "chlla", "chlle"}
    for w in words:
        near = min((distance(w, t), t) for t in lexicon if distance(w, t) <= toxicity.allowed(t)) if any(distance(w, t) <= toxicity.allowed(t) for t in lexicon) else None
        want = (near[1], near[0], False) if near and (not w.startswith("chlla") or not near[0]) else ("chlla", 0, True) if w.startswith("chlla") else None
        assert automaton.match(w) == want, w


def test_quotation_counts_apart():
    hits = {"idiot": ("idiot", 0, False), '"idiot"': ("idiot", 0, False)}
    assert toxicity.counts_in("you are an idiot today".split(), hits, frozenset(["idiot"])) == (1, 0, 0, 0, 0)
    assert toxicity.counts_in("you are an idiot today".split(), hits, frozenset()) == (0, 0, 0, 0, 1)
    assert toxicity.counts_in('the word "idiot" was used'.split(), hits, frozenset(["idiot"])) == (0, 0, 0, 1, 0)


def labelled(docs_of, spark):
    rng = random.Random(5)
    plain = [f"plain{i}" for i in range(300)]
    texts, labels = {}, []
    for d in range(1200):
        words = rng.choices(plain, k=40)
        toxic = d % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["rotter", "blighter", "scoundrel"]))
        texts[d] = " ".join(words)
        labels.append((d, 1, int(toxic)))
    return docs_of(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_finds_misspellings(spark, docs_of, odd, nothing):
    docs, labels = labelled(docs_of, spark)
    model = toxicity.fit(docs, labels)
    assert set(model.words) == {"rotter", "blighter", "scoundrel"}
    scored = toxicity.score(docs, model).join(labels, "doc_id").select("score", "toxic", toxicity.held_out().alias("h")).where("h").collect()
    assert len(scored) > 100 and all((r.score >= 0.5) == (r.toxic == 1) for r in scored)
    fresh = {1: "plain1 you roter plain2", 2: "plain1 plain2", 3: "what a scoundrle he is scoundreel", 4: None}
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(fresh), model).collect()}
    assert got[1] >= 0.5 > got[2] and got[3] >= 0.5 > got[4]
    assert toxicity.score(odd, model).count() == 11 and toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(docs, labels.where("false"))
    assert empty.words == {} and all(r.score < 0.5 for r in toxicity.score(docs_of(fresh), empty).collect())
    assert toxicity.fit(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).words == {}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), model).join(labels, "doc_id").where(toxicity.held_out() & F.col("toxic").isNotNull()).select("toxic", (F.col("score") >= 0.5).alias("said")).collect()
    hits, said, toxic = sum(r.said and r.toxic == 1 for r in got), sum(r.said for r in got), sum(r.toxic == 1 for r in got)
    assert hits >= 0.95 * said and hits >= 0.85 * toxic


def test_prefix_terms_may_be_misspelled():
    automaton = toxicity.LexiconAutomaton({}, {"achlich": 1})
    assert automaton.match("achlichkeit") == ("achlich", 0, True) and automaton.match("achlixhkeit") == ("achlich", 1, True)
    assert automaton.match("axhlixhkeit") is None


def test_quality(spark, docs_of, odd, nothing):
    rng = random.Random(2)
    usual = ["the", "of", "and", "to", "a", *[f"{x}{y}ing" for x in "bcdfg" for y in "aeiou"]]
    texts, bad = {}, set()
    for d in range(900):
        words = rng.choices(usual, k=rng.randint(30, 80))
        if d % 6 == 0:
            bad.add(d)
            words = [f"{w}{rng.choice(['###', '%%%'])}" for w in words] if d % 12 else [w for w in words for _ in range(9)]
        texts[d] = " ".join(words)
    got = {r.doc_id: r.score for r in quality.score_quality(docs_of(texts)).collect()}
    wrong = [d for d in texts if (got[d] < 0.5) != (d in bad)]
    assert len(wrong) < 0.02 * len(texts)
    rows = quality.score_quality(odd).collect()
    assert len(rows) == 11 and all(r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert quality.score_quality(nothing).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    right = np.stack([rng.random(20_000) < a for a in (0.95, 0.9, 0.8)], axis=1)
    votes = np.where(rng.random(right.shape) < 0.2, -1, np.where(right, good[:, None], ~good[:, None])).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, share, acc = quality.expectation_maximisation(patterns, counts.astype(float), 500)
    assert abs(share - 0.8) < 0.05 and np.abs(acc[:, 1, 1] - [0.95, 0.9, 0.8]).max() < 0.05


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_decontamination(spark, docs_of, odd, nothing):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choices(words, k=n)) for n in (5, 9, 15, 30, 64)] + ["rare pair", None, ""]
    texts = {0: "start " + items[2].upper() + " end", 1: items[3], 2: " ".join(items[4].split()[:50]), 3: "x rare pair y", 4: "rare", 5: None, 6: "clean words only", 7: items[0] + "\n" + items[1]}
    damaged = items[4].split()
    damaged[30] = "other"
    texts[8] = " ".join(rng.choices(words, k=3000)) + " " + " ".join(damaged)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(docs_of(texts), items_of(spark, items)).collect()}
    want = set()
    for i, item in enumerate(items):
        w = (item or "").lower().split()
        n = min(5, len(w))
        grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
        for d, t in texts.items():
            x = (t or "").lower().split()
            if grams and 5 * len(grams & {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}) >= 4 * len(grams):
                want.add((d, i))
    assert got == want and (8, 4) in got and (3, 5) in got and (0, 2) in got
    left = {r.doc_id for r in decontamination.decontaminate(docs_of(texts), items_of(spark, items)).collect()}
    assert left == set(texts) - {d for d, _ in want}
    assert decontamination.contaminated_pairs(odd, items_of(spark, ["one two three"])).count() == 0  # its doc_id is null
    assert decontamination.contaminated_pairs(nothing, items_of(spark, items)).count() == 0
    assert decontamination.contaminated_pairs(docs_of(texts), items_of(spark, [])).count() == 0


def test_licenses(spark, docs_of, odd, nothing):
    texts = {
        1: 'Intro.\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nend',
        2: "you may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0.",
        3: "Some text. Released under the MIT License. More text.",
        4: "licensed under cc by-nc 4.0",
        5: "Nothing here.", 6: None,
    }
    got = {(r.doc_id, r.license, r.rule, r.n_sentences) for r in licenses.scan_licenses(docs_of(texts)).collect()}
    assert got == {(1, "Apache-2.0", "apache-notice", 4), (2, "Apache-2.0", "apache-line", 1), (3, "MIT", "mit-line", 1), (4, "CC-BY-NC-4.0", "cc-by-nc-line", 1)}
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(nothing).count() == 0


def test_wrapped_and_decorated_licenses(spark, docs_of):
    import textwrap

    whole = " ".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    bsd = "\n *\n".join("\n".join(f" * {x}" for x in textwrap.wrap(licenses.SENTENCES[k], 60)) for k in ("bsd-head", "bsd-source", "bsd-binary"))
    texts = {1: "MIT License\n\n" + textwrap.fill(whole, 80), 2: "/*\n" + bsd + "\n */\ncode", 3: "*" * 1200 + " Released under the MIT License.", 4: "x\r\n\r\n" + textwrap.fill(whole, 40).replace("\n", "\r\n")}
    docs = docs_of(texts)
    got = {(r.doc_id, r.license, r.rule) for r in licenses.scan_licenses(docs).collect()}
    assert {(1, "MIT", "mit-full"), (2, "BSD-2-Clause", "bsd2-text"), (3, "MIT", "mit-line"), (4, "MIT", "mit-full")} <= got
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by name
    made = licenses.scan_licenses(docs)
    assert sorted(map(tuple, made.collect())) == sorted(duckdb.sql(licenses.OP5_SQL).select(", ".join(made.columns)).fetchall())


def test_a_licence_within_another(spark, docs_of):
    """The whole text of one licence is not taken for another that it holds a part of; foreign sentences part a notice."""
    say = lambda *ids: " ".join(licenses.SENTENCES[k] for k in ids)
    two, three = ("bsd-head", "bsd-source", "bsd-binary"), ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")
    texts = {
        1: say(*two), 2: say(*three), 3: say(*three) + " And then. " + say(*two), 4: "Copyright Acme. All rights reserved.", 5: say("apache-head") + " One more. Another one. " + say("apache-use"),
        6: say("apache-head", "apache-use"), 7: say(*two) + " All rights reserved.",
    }
    docs = docs_of(texts)
    made = licenses.scan_licenses(docs)
    got = {(r.doc_id, r.license, r.rule) for r in made.collect()}
    assert got == {(1, "BSD-2-Clause", "bsd2-text"), (2, "BSD-3-Clause", "bsd3-text"), (3, "BSD-3-Clause", "bsd3-text"), (3, "BSD-2-Clause", "bsd2-text"), (6, "Apache-2.0", "apache-opening"), (7, "BSD-2-Clause", "bsd2-text")}
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by name
    assert sorted(map(tuple, made.collect())) == sorted(duckdb.sql(licenses.OP5_SQL).select(", ".join(made.columns)).fetchall())


def test_native_operators_run_no_python(spark, sf):
    for name in ("op1_decontamination", "op5_licenses"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = sharding.hilbert(grid, 3)
    assert sorted(at) == list(range(512))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, docs_of, odd, nothing):
    texts = {d: f"text {d % 37} " * (d % 37 + 1) for d in range(500)}
    for docs, n in ((docs_of(texts), 500), (odd, 11), (docs_of({1: "a"}), 1)):
        rows = sharding.shard_documents(docs).collect()
        counts = [sum(r.shard == s for r in rows) for s in range(8)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    placed = sharding.shard_documents(docs_of(texts))
    spread = {}
    for r in placed.collect():
        spread.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(v) > 1 for v in spread.values()) <= 7
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_are_pruned(spark):
    rng = random.Random(1)
    for sources in (10, 200):
        rows = [(d, f"{d:04} " + "w " * rng.randint(1, 400), rng.choice(["de", "en", "en", "en", "es", "fr"]), f"src{rng.randrange(sources):03}", 0) for d in range(4000)]
        placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).cache()
        bounds = sharding.shard_bounds(placed).cache()
        for wanted, most in (({"source": "src003"}, 5), ({"lang": "fr"}, 5), ({"lang": "fr", "source": "src003"}, 3), ({"lang": "fr", "source": "src003", "size": 206}, 2)):
            left = {r.shard for r in sharding.prune(bounds, **wanted).collect()}
            rows = placed
            for name, value in wanted.items():
                rows = rows.where(F.col(name) == value)
            assert {r.shard for r in rows.select("shard").distinct().collect()} <= left and len(left) <= most


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.sql(ORACLE[name])
    made = QUERIES[name](spark, sf).select(*result.columns)
    assert sorted(map(str, [tuple(r) for r in made.collect()])) == sorted(map(str, result.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_for_each_document(spark, sf, name):
    """Or for each conversation, where the query is about those."""
    if name in ("op3_suffixes", "op4_passages", "op10_jaccard"):
        pytest.skip("compared with brute force elsewhere")
    source, key = ("conversations", "conv_id") if name == "op11_turns" else ("documents", "doc_id")
    wanted = spark.read.parquet(f"{sf}/{source}.parquet").select(key).distinct().collect()
    assert sorted(r[key] for r in QUERIES[name](spark, sf).collect()) == sorted(r[key] for r in wanted)
