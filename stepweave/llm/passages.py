"""Substring dedup by repeated-phrase automata: remove every word that a window of 50 words covers which also starts in an earlier document.

Words are runs of anything but ASCII white space, unchanged. recurring.py confirms which seeds (16 words that anchor a
window) recur and brings the stretches of text around them to the shards of their seeds. Stretches that are equal as a
whole are settled by 96 bits of key and hash; of each one stays. A shard compiles the seeds of its recurring passages into
one Aho-Corasick automaton over word numbers, streams every stretch through it to locate each occurrence, and takes the
windows about the occurrences; those with equal seed, place of the seed and words are one window, compared word by word,
and all but those of the smallest document are removed.

Defined results: null texts and texts below 50 words lose nothing. A null doc_id counts as larger than all others. Rows
with the same doc_id are one document for the comparison, and each row keeps or loses its own words. Other columns pass
through; columns with the names of added ones are replaced. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import BYTE_CODE, documents, raw_bytes, rolled, span_hashes, words_of
from stepweave.llm.recurring import HOT, WINDOW, _groups, _take, remove_recurring, removal_mask, smaller_holder

SEED = 16


def compile_seeds(seeds: list[tuple[int, ...]]):
    """An automaton that names every seed that ends at a word."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, seed in enumerate(seeds):
        automaton.add_word(seed, number)
    automaton.make_automaton()
    return automaton


def occurrences(words: np.ndarray, edges: np.ndarray, seeds: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, place and seed of every occurrence of a seed, by streaming all stretches through one automaton."""
    automaton = compile_seeds(seeds)
    found: list[tuple[int, int, int]] = []
    number = words.tolist()
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        found += [(i, a + end - SEED + 1, seed) for end, seed in automaton.iter(tuple(number[a:b]))]
    which, place, seed = np.array(found, np.int64).reshape(-1, 3).T
    return which, place, seed


def _resolve(flat, edge, mine, ids, key48):
    none = np.empty(0, np.int64)
    sizes = edge[mine + 1] - edge[mine]
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, words = np.unique(_take(flat, edge, mine), return_inverse=True)  # words as numbers
    # the recurring phrases: where a stretch's seed has the hash that is its key
    h = rolled(_take(flat, edge, mine), SEED) >> np.uint64(16)
    owner = np.repeat(np.arange(len(mine)), sizes)
    place = np.flatnonzero((h == key48[mine][owner[: len(h)]]) & (owner[: len(h)] == owner[SEED - 1 :][: len(h)]))
    seeds = {tuple(words[p : p + SEED].tolist()) for p in place[_groups(owner[place])].tolist()}
    if not seeds:
        return none, none
    which, place, seed = occurrences(words, at, sorted(seeds))
    # the windows about each occurrence, known by its seed, where the seed stands in them, and all their words
    low = np.maximum(place - (WINDOW - SEED), at[which])
    count = np.maximum(np.minimum(place, at[which + 1] - WINDOW) - low + 1, 0)
    hit = np.repeat(np.arange(len(which)), count)
    window = low[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
    if not len(window):
        return none, none
    offset, whole, doc = place[hit] - window, rolled(words.astype(np.uint64), WINDOW)[window], ids[mine[which[hit]]]
    order = np.lexsort((doc, whole, offset, seed[hit]))
    heads = _groups(seed[hit][order], offset[order], whole[order])
    later = np.flatnonzero(smaller_holder(heads, doc[order]))
    leader = np.repeat(heads, np.diff(np.append(heads, len(order))))[later]
    span = np.arange(WINDOW)
    same = np.zeros(len(later), bool)
    for s in range(0, len(later), 20_000):  # word by word; a hash alone removes nothing
        some = slice(s, s + 20_000)
        same[some] = (words[window[order[later[some]]][:, None] + span] == words[window[order[leader[some]]][:, None] + span]).all(axis=1)
    gone = order[later[same]]
    pairs = np.unique(np.stack([which[hit[gone]], window[gone] - at[which[hit[gone]]]]), axis=1)
    return mine[pairs[0]], pairs[1]


def _units(raw: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = words_of(raw, offsets)
    v = span_hashes(BYTE_CODE[raw], starts, ends)
    return v, v, rows


def _cut(texts: pa.Array, intervals: list) -> list[pa.Array]:
    raw, offsets = raw_bytes(texts)
    data = raw.tobytes()
    n_words, n_removed, kept = [], [], []
    for (starts, sizes), a, b in zip(intervals, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = data[a:b].split()
        n_words.append(len(words))
        if len(starts):
            stay = ~removal_mask(len(words), starts, sizes)
            n_removed.append(int((~stay).sum()))
            words = [words[i] for i in np.flatnonzero(stay).tolist()]
        else:
            n_removed.append(0)
        kept.append(b" ".join(words))
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]


ADDED = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept", "string", pa.string())]


def passage_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed and kept, the words that stay, joined by single spaces."""
    return remove_recurring(docs, _units, _resolve, _cut, ADDED, SEED, hot)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passage_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def kept_by_brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, str]]:
    """What op4 returns, by a table of all windows; for tests on few texts."""
    words = {d: t.split() for d, t in texts.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - WINDOW + 1):
            first.setdefault(tuple(words[d][i : i + WINDOW]), d)
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] < d:
                gone[i : i + WINDOW] = True
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join([x for x, g in zip(w, gone, strict=True) if not g])).hexdigest())
    return out
