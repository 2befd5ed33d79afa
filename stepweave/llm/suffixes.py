"""Suffix-array dedup: remove every byte that a 50-byte string covers which also starts in an earlier document.

Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input. recurring.py brings the slices
that may hold such strings together by anchor. A shard builds the suffix array of the window starts of its slices by
deep-shallow sorting: a multikey quicksort over eight-byte characters down to SHALLOW bytes, then blind tries, which
order the remaining groups with long common prefixes by the first byte in which a member leaves its group's leader.
Neighbours in that order whose common prefix reaches 50 bytes are equal strings; all but those of the smallest
document are removed.

Defined results: null and empty texts, and texts below 50 bytes, lose nothing. A null doc_id counts as larger than all
others. Rows with the same doc_id are one document for the comparison (none is smaller), and each row keeps or loses its
own bytes. Other columns pass through; columns with the names of added ones are replaced. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import BYTE_CODE, documents, raw_bytes
from stepweave.llm.recurring import HOT, WINDOW, _groups, remove_recurring, removal_mask, smaller_holder

#: Bytes of the hashed string that picks anchors, and depth of the multikey quicksort.
SEED, SHALLOW = 24, 16


def wide_characters(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | flat[at + j]
    return out


def multikey_sort(flat: np.ndarray, at: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` by their first `depth` bytes, and the starts of groups that agree in those."""
    order = np.argsort(wide_characters(flat, at), kind="stable")
    character = wide_characters(flat, at[order])
    heads = _groups(character)
    for d in range(8, depth, 8):  # only groups of several suffixes are looked at again
        size = np.diff(np.append(heads, len(order)))
        group = np.repeat(np.arange(len(heads)), size)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        character = np.zeros(len(order), np.uint64)
        character[tied] = wide_characters(flat, at[order[tied]] + d)
        again = tied[np.lexsort((character[tied], group[tied]))]
        order[tied], character[tied] = order[again], character[again]
        heads = _groups(group, character)
    return order, heads


def blind_tries(flat: np.ndarray, at: np.ndarray, order: np.ndarray, heads: np.ndarray, depth: int = SHALLOW, end: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the members of each group by bytes depth to end; starts of groups of equal strings.

    Every round compares the members of a group with its leader. Members that never leave it are settled; the others
    branch off by side, place and byte of the first difference, and are compared with their own leader from there on.
    """
    order = order.copy()
    size = np.diff(np.append(heads, len(order)))
    rank = np.repeat(heads, size)  # the first place of each member's group; equal strings share it in the end
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_):
        leader = np.repeat(_groups(rank[open_]), np.diff(np.append(_groups(rank[open_]), len(open_))))
        mine = order[open_]
        text = flat[at[mine][:, None] + np.arange(depth, end)]
        base = text[leader]
        differs = text != base
        place = np.where(differs.any(axis=1), differs.argmax(axis=1), end)
        rows = np.arange(len(mine))
        inside = np.minimum(place, end - depth - 1)
        byte, other = text[rows, inside].astype(np.int64), base[rows, inside].astype(np.int64)
        side = np.where(place == end, 0, np.where(byte < other, -1, 1))
        branch = side * (end + 1 - place)  # smaller strings leave early first, larger ones late first
        again = np.lexsort((np.where(side == 0, 0, byte), branch, rank[open_]))
        order[open_] = mine[again]
        new_rank, new_side = rank[open_][again], side[again]
        first = _groups(new_rank, branch[again], np.where(new_side == 0, 0, byte[again]))
        count = np.diff(np.append(first, len(open_)))
        rank[open_] = np.repeat(open_[first], count)
        open_ = open_[np.repeat(count > 1, count) & (new_side != 0)]
    return order, _groups(rank)


def suffix_order(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the 50-byte strings at `at`, and the starts of groups of equal ones."""
    return blind_tries(flat, at, *multikey_sort(flat, at))


def _resolve(flat, edge, mine, ids, key48):
    sizes = edge[mine + 1] - edge[mine] - WINDOW + 1
    which = np.repeat(mine, sizes)
    window = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order, heads = suffix_order(flat, edge[which] + window)
    hit = order[smaller_holder(heads, ids[which[order]])]
    return which[hit], window[hit]


def _units(raw: np.ndarray, offsets: np.ndarray):
    return BYTE_CODE[raw], raw, offsets


def _cut(texts: pa.Array, intervals: list) -> list[pa.Array]:
    raw, offsets = raw_bytes(texts)
    data = raw.tobytes()
    n_bytes, n_removed, n_spans, kept = np.diff(offsets), [], [], []
    for (starts, sizes), a, b in zip(intervals, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if len(starts):
            gone = removal_mask(b - a, starts, sizes)
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[a:b][~gone].tobytes())
        else:
            n_removed.append(0)
            n_spans.append(0)
            kept.append(data[a:b])
    return [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]


ADDED = [("n_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_spans", "long", pa.int64()), ("kept", "binary", pa.binary())]


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the bytes that stay."""
    return remove_recurring(docs, _units, _resolve, _cut, ADDED, SEED, hot)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def kept_by_brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, str]]:
    """What op3 returns, by a table of all strings; for tests on few texts."""
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - WINDOW + 1):
            first.setdefault(texts[d][i : i + WINDOW], d)
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - WINDOW + 1):
            if first[t[i : i + WINDOW]] < d:
                gone[i : i + WINDOW] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[d] = (int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out
