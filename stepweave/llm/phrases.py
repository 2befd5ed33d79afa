"""Phrase collocation mining (operator 12): an FM-index of word ids for each shard, extended in both directions.

A shard is what one task reads of one language, up to SHARD_WORDS words. Its words get dense ids, pieces are parted by id
0, and suffixes are sorted as deep as phrases are long; that order is right for every pattern up to that length. All
intervals of a level are extended at once: the symbols before an interval (Burrows-Wheeler transform) give the left
extensions with their counts, `C` and ranks give their intervals, and the same step keeps the interval of the reversed
index, from which right extensions come in the same way. Words grow to pairs leftward, pairs to triples rightward, triples to
quadruples leftward. Counts of the shards are summed by Spark.

A phrase of 30 occurrences is made of words and pairs of 30 occurrences, so two filters go before: bit maps of fixed size
(FILTER_BITS) in which each frequent word or pair has its bit. Both are counted for that as hashes, in blobs of about five
bytes each. What shares a hash or a bit only lets more through; all results are counted exactly. The bit maps are the
only broadcast data.

Null texts are empty, a null lang is `und`. Repeated rows count again. Ties are settled by count, then phrase. Texts of any
length are read whole. Empty in, empty out; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from stepweave.llm.common import checkpoint, documents, mix, slices

LEAST, LONGEST, BEST, COVER = 30, 4, 2000, (100, 80)
SCALE = 2_000_000
#: Words of a shard's index; ids take 16 bits, so that four of them are one sort key.
SHARD_WORDS, MOST_IDS = 1_000_000, 65_000
FILTER_BITS = 1 << 25
#: Lower case for A-Z, and one sign for all that ends a piece.
_BYTES = bytes(0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A phrase with its language before it, parted by a tab, which no word holds; one column makes short rows.
#: A phrase of three words brings those of four that end in it: their first words and counts, parted by tabs. A phrase of
#: two brings so those of three, parted by line ends, and a word those of two, parted by commas; what stands there is their
#: other word, behind `:` if it comes first. A count of one is left out there.
_CARRIED = "key string, n long, heads string"
_HASHED = "group int, blob binary"
_ARROW = pa.schema([("key", pa.string()), ("n", pa.int64()), ("heads", pa.string())])


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece of a text, lower-cased."""
    for piece in text.encode().translate(_BYTES).split(b"\n"):
        if piece:
            yield piece.split()  # at blanks and tabs; the other signs that it parts at have parted pieces


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The bit of each hash: by the first 44 bits of its hash, which are all that is counted."""
    return ((hashes >> np.uint64(20)) % np.uint64(FILTER_BITS)).astype(np.int64)


class ShardIndex:
    """A bidirectional FM-index over word ids, sorted to a bounded depth; id 0 parts pieces and belongs to no phrase."""

    def __init__(self, ids: np.ndarray, most: int):
        self.text, self.most = ids, most
        self.ahead = self._half(ids)

    @cached_property
    def behind(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._half(self.text[::-1])

    def _half(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one direction: the symbol before each suffix in sorted order, (symbol, row) keys for ranks, and symbols' first rows."""
        n = len(text)
        key = np.zeros(n, np.uint64)
        for k in range(LONGEST):
            key <<= np.uint64(16)
            key[: max(n - k, 0)] |= text[k:].astype(np.uint64)
        order = np.argsort(key)  # no interval parts equal keys, so their order does not matter
        before = text[order - 1]  # the text begins with 0, and so does what is before it
        ranks = np.sort(before.astype(np.int64) * n + np.arange(n))
        firsts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.most))])
        return before, ranks, firsts

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of all single words: ids, first row ahead, first row behind, counts."""
        counts = np.bincount(self.text, minlength=self.most)
        ids = np.flatnonzero(counts)
        ids = ids[ids > 0]
        return ids, self.ahead[2][ids], self.ahead[2][ids], counts[ids]  # single words begin at the same rows in both directions

    def extend(self, at: np.ndarray, other: np.ndarray, counts: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every extension of the intervals by one word: which interval, the word, its first row, the other index's first row, count.

        at and other are the first rows in the index that extends and in the other one.
        """
        before, ranks, firsts = self.ahead if left else self.behind
        group = np.repeat(np.arange(len(at)), counts)
        rows = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at, counts)
        pairs, n = np.unique(group * self.most + before[rows], return_counts=True)
        group, word = pairs // self.most, pairs % self.most
        smaller = np.cumsum(n) - n
        opens = np.searchsorted(group, np.arange(len(at)))
        beside = other[group] + smaller - smaller[opens[group]]  # rows with a smaller word next come first
        low = np.searchsorted(ranks, word * len(self.text) + at[group])
        low -= np.searchsorted(ranks, word * len(self.text))  # rank: so many rows before have the word before them
        good = word > 0
        return group[good], word[good], (firsts[word] + low)[good], beside[good], n[good]


class _Shard:
    """Word ids of one language, until they are indexed."""

    def __init__(self, lang: str, words: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.lang, self.words, self.pairs, self.seed = lang, words, pairs, xxh64_intdigest(lang)
        self.known: dict[bytes, int] = {}
        self.names: list[bytes] = [b""]
        self.hashes: list[int] = [0]
        self.ids: list[int] = [0]
        self.total = 0

    def _learn(self, word: bytes) -> int:
        found = xxh64_intdigest(word, self.seed)
        bit = (found >> 20) % FILTER_BITS
        good = self.words[bit >> 3] >> (bit & 7) & 1
        if good:
            self.names.append(word)
            self.hashes.append(found)
        self.known[word] = found = len(self.names) - 1 if good else 0
        return found

    def add(self, words: list[bytes]) -> None:
        known, learn = self.known, self._learn
        self.ids.extend([known[w] if w in known else learn(w) for w in words])
        self.ids.append(0)
        self.total += len(words)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_WORDS or len(self.names) >= MOST_IDS or len(self.known) >= 4 * SHARD_WORDS

    def _hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        own = np.array(self.hashes, np.uint64)
        return mix(own[first] * np.uint64(0x9E3779B97F4A7C15) + own[second])

    def pair_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shard's phrases of two words, and their counts."""
        index = ShardIndex(np.array(self.ids, np.int64), len(self.names))
        ids, ahead, behind, counts = index.words()
        group, word, _, _, counts = index.extend(ahead, behind, counts, left=True)
        return self._hashes(word, ids[group]), counts

    def counted(self, carry: int = 0) -> Iterator[pa.RecordBatch]:
        """Words and phrases of two to four words with their counts, as far as the words and pairs in them may be frequent; the number of all words as a phrase of none.

        With carry, phrases of four words come in the rows of their last three (heads), else in rows of their own; with a carry of three, those of three and two come in the rows of words likewise.
        """
        index = ShardIndex(np.array(self.ids, np.int64), len(self.names))
        names = self.names
        yield from self._batches([b""], np.array([self.total]))
        ids, ahead, behind, counts = index.words()
        own = counts
        if carry < 3:
            yield from self._batches([names[i] for i in ids], own)
        group, word, ahead, behind, counts = index.extend(ahead, behind, counts, left=True)
        first, second = word, ids[group]
        bits = _bits(self._hashes(first, second))
        good = (self.pairs[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
        first, second, ahead, behind, counts = (v[good] for v in (first, second, ahead, behind, counts))
        if carry < 3:
            yield from self._batches([names[a] + b" " + names[b] for a, b in zip(first, second, strict=True)], counts)
        pair = first, second, counts
        sorted_ = np.argsort(first * index.most + second)
        known = (first * index.most + second)[sorted_]  # pairs of this shard that may be frequent
        group, third, behind, ahead, counts = index.extend(behind, ahead, counts, left=False)
        good = np.isin(second[group] * index.most + third, known)
        group, third, ahead, behind, counts = (v[good] for v in (group, third, ahead, behind, counts))
        start, first, second = group, first[group], second[group]
        group, zeroth, _, _, longer = index.extend(ahead, behind, counts, left=True)
        good = np.isin(zeroth * index.most + first[group], known)
        group, zeroth, longer = group[good], zeroth[good], longer[good]
        edges = np.searchsorted(group, np.arange(len(first) + 1))
        if carry == 3:
            # the part with the longer word, which is rarer as a rule, so that rows of very frequent words do not gather all that is about them
            lengths = np.array([len(x) for x in names])
            right = lengths[third] <= lengths[first]
            at = np.where(right, start, sorted_[np.searchsorted(known, second * index.most + third)] if len(third) else start)
            heads = self._told(zeroth, longer)
            outer = self._told(np.where(right, third, first), counts)
            told = [b"\t".join([w if r else b":" + w, *heads[i:j]]) for w, r, i, j in zip(outer, right.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            triples = _joined(told, at, len(pair[0]), b"\n")
            right = lengths[pair[1]] <= lengths[pair[0]]
            outer = self._told(np.where(right, pair[1], pair[0]), pair[2])
            told = [(w if r else b":" + w) + (b"\n" + t if t else b"") for w, r, t in zip(outer, right.tolist(), triples, strict=True)]
            yield from self._batches([names[i] for i in ids], own, _joined(told, np.searchsorted(ids, np.where(right, *pair[:2])), len(ids), b","))
            return
        triples = [b" ".join((names[a], names[b], names[c])) for a, b, c in zip(first, second, third, strict=True)]
        if not carry:
            yield from self._batches(triples, counts)
            yield from self._batches([names[z] + b" " + triples[g] for z, g in zip(zeroth, group, strict=True)], longer)
            return
        told = [names[z] + b" %d" % n for z, n in zip(zeroth, longer, strict=True)]
        yield from self._batches(triples, counts, [b"\t".join(told[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)])

    def _told(self, words: np.ndarray, counts: np.ndarray) -> list[bytes]:
        names = self.names
        return [names[w] + b" %d" % n if n > 1 else names[w] for w, n in zip(words.tolist(), counts.tolist(), strict=True)]

    def _batches(self, phrases: list[bytes], counts: np.ndarray, heads: list[bytes] | None = None, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        head = self.lang.encode() + b"\t"
        for i in range(0, len(phrases), rows):
            part = pa.array([head + p for p in phrases[i : i + rows]], pa.binary()).cast(pa.string())
            longer = pa.nulls(len(part), pa.string()) if heads is None else pa.array(heads[i : i + rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(counts[i : i + rows], pa.int64()), longer], schema=_ARROW)


def _joined(parts: list[bytes], at: np.ndarray, n: int, sign: bytes) -> list[bytes]:
    """For each of n places, the parts that belong there, joined."""
    by = np.argsort(at, kind="stable")
    parts, edges = [parts[k] for k in by.tolist()], np.searchsorted(at[by], np.arange(n + 1)).tolist()
    return [sign.join(parts[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, blob) of the hashed words of a task's texts; a bounded number of words is held."""
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        size = sum(map(len, held.values()))
        seeds = {lang: xxh64_intdigest(lang) for lang in held}
        yield _packed(np.fromiter((xxh64_intdigest(w, seeds[lang]) for lang, counts in held.items() for w in counts), np.uint64, size), np.fromiter((n for counts in held.values() for n in counts.values()), np.int64, size))
        held.clear()

    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = held.setdefault(lang, Counter())
            for words in pieces(text):
                own.update(words)
        if sum(map(len, held.values())) > SHARD_WORDS // 2:
            yield from out()
    yield from out()


def _packed(hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Hashes and counts as (group, blob): 12 bits of a hash are the group, the next 32 and a count go into the blob.

    Counts stop at LEAST: whether something is frequent is all that is asked of them.
    """
    hashes, n = _summed(hashes >> np.uint64(20), n)
    group = (hashes >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    rest, n = hashes.astype(np.uint32), np.minimum(n, LEAST).astype(np.uint8)
    blobs = [rest[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(group[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["group", "blob"])


def _shards(batches: Iterator[pa.RecordBatch], words: np.ndarray, pairs: np.ndarray | None) -> Iterator[_Shard]:
    """A task's texts as shards of one language each, of a bounded number of words."""
    open_: dict[str, _Shard] = {}
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in open_:
                open_[lang] = _Shard(lang, words, pairs)
            for own in pieces(text):
                open_[lang].add(own)
                if open_[lang].full():
                    yield open_.pop(lang)
                    open_[lang] = _Shard(lang, words, pairs)
        while sum(len(s.ids) + len(s.known) for s in open_.values()) > 2 * SHARD_WORDS:  # many languages in one task
            yield open_.pop(max(open_, key=lambda x: len(open_[x].ids)))
    yield from open_.values()


def _pairs_of(words):
    """A function for mapInArrow: (group, blob) of hashed pairs of words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for shard in _shards(batches, np.frombuffer(words.value, np.uint8), None):
            held.append(shard.pair_hashes())
            if sum(len(h) for h, _ in held) > 4 * SHARD_WORDS:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[firsts], np.add.reduceat(n[order].astype(np.int64), firsts) if len(keys) else n


def _frequent_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bits) of the bit map, from blobs sorted by group."""

    def bits(group: int, blobs: list[bytes]) -> np.ndarray:
        n = [len(b) // 5 for b in blobs]
        keys = np.concatenate([np.frombuffer(b, np.uint32, k) for b, k in zip(blobs, n, strict=True)])
        counts = np.concatenate([np.frombuffer(b, np.uint8, k, 4 * k) for b, k in zip(blobs, n, strict=True)])
        keys, counts = _summed(keys, counts)
        whole = (np.uint64(group) << np.uint64(32)) | keys[counts >= LEAST].astype(np.uint64)
        return _bits(whole << np.uint64(20))

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        return _bit_rows(np.concatenate(found) if found else np.empty(0, np.int64))

    group, blobs, found = None, [], []
    for batch in batches:
        for g, blob in zip(batch.column("group").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if g != group:
                if blobs:
                    found.append(bits(group, blobs))
                group, blobs = g, []
            blobs.append(blob)
        if sum(map(len, found)) > SHARD_WORDS:
            yield out(found)
            found = []
    if blobs:
        found.append(bits(group, blobs))
    yield out(found)


def _bit_rows(bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bits >> 5), pa.array(np.int64(1) << (bits & 31))], names=["word", "bits"])


def _frequent(hashed: DataFrame):
    """A broadcast bit map of FILTER_BITS of what (group, blob) count LEAST times; its size does not depend on the data."""
    rows = hashed.repartition("group").sortWithinPartitions("group").mapInArrow(_frequent_bits, "word long, bits long")
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return hashed.sparkSession.sparkContext.broadcast(out.tobytes())


def _phrases_of(words, pairs, carry: int = 0):
    """A function for mapInArrow: the counted phrases of all shards; the arguments are broadcast bit maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, np.frombuffer(words.value, np.uint8), np.frombuffer(pairs.value, np.uint8)):
            yield from shard.counted(carry)

    return run


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of one to four words that occur LEAST times, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = _frequent(texts.mapInArrow(_words_of, _HASHED))
    pairs = _frequent(texts.mapInArrow(_pairs_of(words), _HASHED))
    # rows travel by their key; longer phrases are taken out of the rows of words behind the shuffle, and need not be shuffled again
    first = lambda name, sign: F.substring_index(name, sign, 1)
    dealt = texts.mapInArrow(_phrases_of(words, pairs, carry=3), _CARRIED).repartition("key")
    twos = dealt.select("key", F.explode(F.split(F.concat_ws(",", F.concat(F.lit(" "), F.col("n").cast("string")), F.nullif("heads", F.lit(""))), ",")).alias("two"))
    threes = twos.select("key", first(first("two", "\n"), " ").alias("beside"), F.posexplode(F.split("two", "\n")).alias("at", "three"))
    apart = threes.select("key", "beside", "at", first(first("three", "\t"), " ").alias("outer"), F.posexplode(F.split("three", "\t")).alias("at4", "one"))
    own = apart.select(
        "key", "beside", F.when(F.col("at") > 0, F.col("outer")).otherwise("").alias("outer"), F.when(F.col("at4") > 0, first("one", " ")).otherwise("").alias("head"),
        F.when(F.contains("one", F.lit(" ")), F.substring_index("one", " ", -1).cast("long")).otherwise(1).alias("n"),
    )
    added = own.groupBy("key", "beside", "outer", "head").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST) | F.endswith("key", F.lit("\t")))
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)")
    before = lambda name: F.when(F.startswith(name, F.lit(":")), F.concat(F.substring(name, 2, 1 << 30), F.lit(" "))).otherwise("")
    behind = lambda name: F.when((F.col(name) != "") & ~F.startswith(name, F.lit(":")), F.concat(F.lit(" "), name)).otherwise("")
    phrase = F.concat(F.when(F.col("head") != "", F.concat("head", F.lit(" "))).otherwise(""), before("outer"), before("beside"), F.substring_index("key", "\t", -1), behind("beside"), behind("outer"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1).cast("int")
    all_ = checkpoint(added.select(lang.alias("lang"), phrase.alias("phrase"), "n").select("lang", "phrase", size.alias("size"), "n"))
    return all_.where("size > 0"), all_.where("size = 0").select("lang", "n")


def _score() -> Column:
    """floor(SCALE * a / (l + r)), exact: decimals of 38 digits hold the product."""
    return F.expr(f"CAST(CAST({SCALE} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) DIV CAST(l + r AS DECIMAL(20,0)) AS LONG)")


def collocations(found: DataFrame, totals: DataFrame, best: int = BEST) -> DataFrame:
    """The best phrases of each language, from the counts of all frequent ones."""
    known = found.select("lang", "phrase", F.col("n").alias("f"))
    candidates = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("head", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score().alias("score"), "k", "l", "r")).alias("cut"))
    # what holds a phrase holds it in a phrase longer by one word, which is at least as frequent
    inner = candidates.where("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    many, share = COVER
    left = scored.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR CAST({many} AS DECIMAL(5,0)) * longer < CAST({share} AS DECIMAL(5,0)) * a")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language of `documents`, from all of its words."""
    return collocations(*counts(documents(spark, sf_dir)))


OP12_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
x AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM x GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
u AS (SELECT c.*, q.k, array_to_string(w[1 : q.k], ' ') AS head, array_to_string(w[q.k + 1 : size], ' ') AS rest FROM c, (SELECT unnest([1, 2, 3]) AS k) q WHERE q.k < size),
s AS (SELECT u.lang, u.phrase, u.a, u.k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (h.f + t.f) AS BIGINT) AS score FROM u JOIN g h ON h.lang = u.lang AND h.phrase = u.head AND h.k = u.k JOIN g t ON t.lang = u.lang AND t.phrase = u.rest AND t.k = u.size - u.k),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
i AS (SELECT lang, array_to_string(w[j : j + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, z, unnest(generate_series(1, size - z + 1)) AS j FROM c, (SELECT unnest([2, 3]) AS z) WHERE z < size) GROUP BY ALL),
r AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE o = 1 AND (longer IS NULL OR 100 * longer < 80 * a))
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
