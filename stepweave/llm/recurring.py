"""Recurring windows: which runs of 50 units (bytes or words) of a document also start in a document with a smaller id.

The work never compares documents with each other. Every window of 50 units picks an anchor, its smallest hashed k-gram,
so equal windows have equal anchors at equal offsets, and only anchors travel:

1. The stretch of text that the windows of an anchor cover is a slice. For every anchor its key (48 bits) and the hash of
   its slice (48 bits) go to buckets of keys. Equal slices are settled by these: all but the smallest document lose
   theirs. They are merged within a task first, so what a third of all documents hold arrives once for each task.
   Where documents share a key but not the slice, one document for each slice is asked for its text.
2. The documents of a block (doc_id modulo a prime) meet the answers, find the places of settled slices, and send the
   slices that are asked for to the shard of their key.
3. A shard lets the operator's resolver compare the single windows of its slices.
   A key with very many different slices is hot: its windows go out singly instead, each to the shard of its own hash, so
   that nothing but equal windows, merged within each block, meets in one task.
4. The blocks meet the intervals found and cut their texts.

All four steps are one DataFrame plan: the shuffle of texts by block serves steps 2 and 4, and nothing but the total
size of the texts comes to the driver. Payloads are packed arrays, so rows are few and shuffles small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import mix, raw_bytes, rolled, slices, small_batches, span_hashes, trim

WINDOW = 50
#: Text bytes that a block, and a bucket of keys, stand for.
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000
FLUSH_KEYS = 1_000_000
SLICE_BYTES = 1_500_000
BLOCK = "_recurring_block"
NO_ID = np.iinfo(np.int64).max
#: (bytes, offsets) of texts to hashes of their units, the units as they travel, and offsets of the texts into them.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (units, edges of slices, slices grouped by key, ids of slices, keys of slices) to (slice, window) of windows that a smaller document holds.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal rank stand together, so small numbers cost little."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.empty((0, 0), np.uint8)
        parts += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 8].decode().strip()), int.from_bytes(data[at + 8 : at + 16], "little")
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at + 16).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 16 + size
    return out


def doc_ids(col: pa.Array) -> np.ndarray:
    """Ids as int64; a null id counts as larger than all others."""
    return col.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def row_tags(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each (doc_id, text): rows of one doc_id with unlike texts keep their places apart."""
    raw, offsets = raw_bytes(batch.column("text"))
    data, ids = raw.tobytes(), doc_ids(batch.column("doc_id"))
    made = [xxhash.xxh3_64_intdigest(data[a:b], seed=i & 0xFFFFFFFFFFFFFFFF) for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.array(made, np.uint64).view(np.int64)


def anchors(v: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window start, and 48-bit key of each run of windows that share an anchor."""
    n = len(v)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, none.astype(np.uint64)
    bits = np.uint64(max(n.bit_length(), 1))
    h = rolled(v, k)
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size, width = 1, WINDOW - k + 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = (best & low).astype(np.int64)  # of the window that starts at each unit
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + WINDOW <= offsets[1:][row])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at, row = at[starts], row[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = _ends(first, len(at)) - 1
    return row[first], starts[first], starts[last], h[at[first]] >> np.uint64(16)


def _groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows of the sorted arrays."""
    n = len(sorted_keys[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _ends(heads: np.ndarray, n: int) -> np.ndarray:
    """Ends of the runs that start at heads."""
    return np.append(heads, n)[1:] if len(heads) else heads


# ---- step 1: keys that occur in several documents ----


def key_rows(keys: np.ndarray, ids: np.ndarray, buckets: int, task: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload) for some (key, id) pairs: kind 0 one pair for each key, kind 1 pairs already known to recur."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = _groups(keys, ids)
    keys, ids = keys[first], ids[first]
    heads = _groups(keys)
    sizes = np.diff(np.append(heads, len(keys)))
    known = np.ones(len(keys), bool)
    known[heads] = False
    if known.any():
        yield task % buckets, 1, pack(keys[known], ids[known])
    keys, ids, several = keys[heads], ids[heads], sizes > 1
    part = (keys * np.uint64(buckets)) >> np.uint64(48)  # keys have 48 bits; ascending
    edges = np.searchsorted(part, np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        s, e = edges[b], edges[b + 1]
        if e > s:
            yield b, 0, pack(np.diff(keys[s:e], prepend=np.uint64(0)), ids[s:e], several[s:e].astype(np.uint8))


def emitting(made: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], buckets: int, rows_of: Callable = key_rows):
    """A mapInArrow function that sends the arrays (keys first) that `made` finds in its batches to buckets."""

    def flush(held: list, task: int) -> pa.RecordBatch:
        rows = list(rows_of(*[np.concatenate(c) for c in zip(*held, strict=True)], buckets, task))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "payload"])

    def run(batches):
        from pyspark import TaskContext

        held, size, task = [], 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE_BYTES):
            held.append(made(batch))
            size += len(held[-1][0])
            if size > FLUSH_KEYS:
                yield flush(held, task)
                held, size, task = [], 0, task + 7919
                trim()
        if size:
            yield flush(held, task)
        trim()

    return run


def recurring_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (key, id) pairs of one bucket whose keys several documents hold, and how many ids of the key were seen here."""
    out_k, out_i, out_n, keys, ids, several = [], [], [], [], [], []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        parts = unpack(payload)
        if kind:
            out_k.append(parts[0])
            out_i.append(parts[1])
            out_n.append(np.ones(len(parts[0]), np.int64))
        else:
            keys.append(np.cumsum(parts[0], dtype=np.uint64))
            ids.append(parts[1])
            several.append(parts[2])
    if keys:
        k, i, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(several)
        order = np.lexsort((i, k))
        k, i, s = k[order], i[order], s[order]
        heads = _groups(k)
        ends = _ends(heads, len(k))
        many = (i[heads] != i[ends - 1]) | (np.maximum.reduceat(s, heads) > 0)
        keep = np.repeat(many, ends - heads)
        out_k.append(k[keep])
        out_i.append(i[keep])
        out_n.append(np.repeat(ends - heads, ends - heads)[keep])
    none = np.empty(0, np.int64)
    return (np.concatenate(out_k), np.concatenate(out_i), np.concatenate(out_n)) if out_k else (none.astype(np.uint64), none, none)


def by_block(ids: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks and the places of their ids."""
    part = np.where(ids == NO_ID, 0, ids % blocks)
    order = np.argsort(part, kind="stable")
    heads = _groups(part[order])
    for s, e in zip(heads, _ends(heads, len(order)), strict=True):
        yield int(part[order[s]]), order[s:e]


def _binary_rows(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    return pa.table({n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(zip(names, kinds, strict=True))})


# ---- steps 1 to 4 of recurring windows ----

ASKED, GONE, SPREAD = 0, 1, 2
#: Distinct slices of one key beyond which a task, or a bucket, takes it for a hot one.
HOT = 64
MARK = np.uint64((1 << 64) - 1)
#: Settled pairs that go to one bucket at a time; they only pass through it.
PIECE = 20_000


def slice_rows(keys: np.ndarray, contents: np.ndarray, ids: np.ndarray, buckets: int, task: int, hot: int = HOT) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload): kind 0, the smallest id of each (key, content); kind GONE, those with a smaller one in the task.

    A key with more than `hot` contents here sends its bucket a mark alone; its pairs are known to be SPREAD.
    """
    order = np.lexsort((ids, contents, keys))
    keys, contents, ids = keys[order], contents[order], ids[order]
    first = _groups(keys, contents, ids)
    keys, contents, ids = keys[first], contents[first], ids[first]
    heads = _groups(keys, contents)
    gone = np.ones(len(keys), bool)
    gone[heads] = False
    for j, some in enumerate(np.array_split(np.flatnonzero(gone), -(-int(gone.sum()) // PIECE) or 1)):
        if len(some):
            yield (task * 31 + j) % buckets, GONE, pack(keys[some], contents[some], ids[some])
    keys, contents, ids = keys[heads], contents[heads], ids[heads]
    first = _groups(keys)
    size = np.diff(np.append(first, len(keys)))
    many = np.repeat(size > hot, size)
    if many.any():
        for j, some in enumerate(np.array_split(np.flatnonzero(many), -(-int(many.sum()) // PIECE))):
            yield (task * 31 + j) % buckets, SPREAD, pack(keys[some], contents[some], ids[some])
        marked = first[size > hot]
        contents = contents.copy()
        contents[marked] = MARK
        stay = ~many
        stay[marked] = True
        keys, contents, ids = keys[stay], contents[stay], ids[stay]
    edges = np.searchsorted((keys * np.uint64(buckets)) >> np.uint64(48), np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        s, e = edges[b], edges[b + 1]
        if e > s:
            yield b, 0, pack(np.diff(keys[s:e], prepend=np.uint64(0)), contents[s:e], ids[s:e])


def settled_slices(table: pa.Table, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Answers of one bucket: keys, contents, ids and kinds.

    GONE: a smaller id has the slice. ASKED: its text is needed. SPREAD: the key is hot, so its windows go out singly.
    """
    out, heads = [], []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        parts = unpack(payload)
        if kind:
            out.append((*parts, np.full(len(parts[0]), kind, np.uint8)))
        else:
            heads.append((np.cumsum(parts[0], dtype=np.uint64), parts[1], parts[2]))
    if heads:
        k, c, i = (np.concatenate(x) for x in zip(*heads, strict=True))
        order = np.lexsort((i, c, k))
        k, c, i = k[order], c[order], i[order]
        first = _groups(k, c)
        least = np.repeat(i[first], np.diff(np.append(first, len(k))))
        later = (i > least) & (c != MARK)
        out.append((k[later], c[later], i[later], np.full(int(later.sum()), GONE, np.uint8)))
        k, c, i = k[first], c[first], i[first]
        start = _groups(k)
        size = np.diff(np.append(start, len(k)))
        spread = (size > hot) | np.logical_or.reduceat(c == MARK, start)
        several = (size > 1) & (np.minimum.reduceat(i, start) < np.maximum.reduceat(i, start))
        some = np.repeat(several | spread, size) & (c != MARK)
        out.append((k[some], c[some], i[some], np.where(np.repeat(spread, size)[some], SPREAD, ASKED).astype(np.uint8)))
    none = np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(np.int64), none.astype(np.uint8))


def _sliced(units: Units, k: int, batch: pa.RecordBatch):
    """Hashes of units, units that travel, offsets of texts, and row, start, size, key and content of every slice of a batch."""
    v, sent, offsets = units(*raw_bytes(batch.column("text")))
    row, a, b, key48 = anchors(v, offsets, k)
    size = b - a + WINDOW
    return v, sent, offsets, row, a, size, key48, span_hashes(v, a, a + size) >> np.uint64(16)


def _slices_of_block(units: Units, k: int, shards: int):
    """Places of settled slices, and the slices that are asked for. Rows: (shard, block, settled, payload)."""
    names = ["shard", "block", "settled", "payload"]

    def run(key, left, right):
        if not (right.num_rows and left.num_rows):
            return _binary_rows([], names)
        keys, contents, ids, kinds = (np.concatenate(x) for x in zip(*[unpack(p) for p in right.column("payload").to_pylist()], strict=True))
        block = key[0].as_py()
        name = mix(keys) ^ mix(ids.astype(np.uint64) ^ (contents << np.uint64(16)))
        order = np.argsort(name, kind="stable")
        name, kinds = name[order], kinds[order]
        rows, spans, asked, single = [], [], [], []
        texts = left.select(["doc_id", "text"]).filter(pc.is_in(left.column("doc_id").cast(pa.int64()).fill_null(NO_ID), pa.array(np.unique(ids))))
        for batch in slices(iter(texts.combine_chunks().to_batches()), "text", SLICE_BYTES):
            own, tags = doc_ids(batch.column("doc_id")), row_tags(batch)
            v, sent, offsets, row, a, size, key48, content = _sliced(units, k, batch)
            seek = mix(key48) ^ mix(own[row].astype(np.uint64) ^ (content << np.uint64(16)))
            at = np.minimum(np.searchsorted(name, seek), len(name) - 1)
            found = name[at] == seek
            gone = found & (kinds[at] == GONE)
            spans.append((tags[row[gone]], a[gone] - offsets[row[gone]], size[gone].astype(np.int32)))
            spread = np.flatnonzero(found & (kinds[at] == SPREAD))
            if len(spread):
                count = size[spread] - WINDOW + 1
                window = _runs(np.arange(len(v)), a[spread], count)
                owner = np.repeat(row[spread], count)
                single.append((rolled(v, WINDOW)[window], own[owner], window - offsets[owner], tags[owner]))
            want = found & (kinds[at] == ASKED)
            if want.any():
                asked.append((key48[want], content[want], own[row[want]], a[want] - offsets[row[want]], size[want], _runs(sent, a[want], size[want]), tags[row[want]]))
        if single:
            whole, ids, start, tag = (np.concatenate(x) for x in zip(*single, strict=True))
            order = np.lexsort((ids, whole))
            whole, ids, start, tag = whole[order], ids[order], start[order], tag[order]
            later = smaller_holder(_groups(whole), ids)
            spans.append((tag[later], start[later], np.full(int(later.sum()), WINDOW, np.int32)))
            part = ((whole >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(48)
            for p in np.unique(part[~later]):
                mine = ~later & (part == p)
                rows.append((int(p), block, 2, pack(whole[mine], ids[mine], start[mine], tag[mine])))
        if spans and sum(len(x[0]) for x in spans):
            rows.append((-1, block, 1, pack(*[np.concatenate(x) for x in zip(*spans, strict=True)])))
        if asked:
            key48, content, ids, start, size, flat, tag = (np.concatenate(x) for x in zip(*asked, strict=True))
            edge = np.concatenate([[0], np.cumsum(size)])
            order = np.lexsort((start, ids, content, key48))
            # a slice that its document repeats goes once; the later places share the answer
            heads = _groups(key48[order], content[order], ids[order])
            place = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            one = order[heads]
            part = (key48[one] * np.uint64(shards)) >> np.uint64(48)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                here = np.flatnonzero(part[place] == p)
                rows.append((int(p), block, 0, pack(key48[one[mine]], ids[one[mine]], size[one[mine]].astype(np.int32), _take(flat, edge, one[mine]), np.searchsorted(mine, place[here]).astype(np.int32), start[order[here]], tag[order[here]])))
        trim()
        return _binary_rows(rows, names)

    return run


def _runs(v: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """v[start:start + size] of each, end to end."""
    ends = np.cumsum(sizes)
    return v[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _take(flat: np.ndarray, edge: np.ndarray, which: np.ndarray) -> np.ndarray:
    return _runs(flat, edge[which], edge[which + 1] - edge[which])


def _settle_shard(resolve: Resolver):
    """Intervals to remove, by block: (block, payload of rows' tags, starts, sizes)."""

    def run(key, table):
        rows, parts, single = [], [], []
        for b, done, p in zip(table.column("block").to_pylist(), table.column("settled").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if done == 1:
                rows.append((b, p))
            elif done:
                found = unpack(p)
                single.append((*found, np.full(len(found[0]), b)))
            else:
                parts.append((b, unpack(p)))
        if single:
            whole, ids, start, tag, block = (np.concatenate(x) for x in zip(*single, strict=True))
            order = np.lexsort((ids, whole))
            later = order[smaller_holder(_groups(whole[order]), ids[order])]
            for b in np.unique(block[later]):
                mine = later[block[later] == b]
                rows.append((int(b), pack(tag[mine], start[mine], np.full(len(mine), WINDOW, np.int32))))
        if parts:
            key48, ids, size, flat = (np.concatenate([p[j] for _, p in parts]) for j in range(4))
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            hit, begin, long = resolved(resolve, flat, edge, key48, ids, np.argsort(key48, kind="stable"))
            at = 0
            for b, p in parts:  # every place of a slice gets its answers
                n = len(p[0])
                lo, hi = np.searchsorted(hit, [at, at + n])
                first = np.searchsorted(hit[lo:hi], at + p[4])
                count = np.searchsorted(hit[lo:hi], at + p[4], side="right") - first
                place = np.repeat(np.arange(len(p[4])), count)
                answer = lo + np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(place))
                if len(place):
                    rows.append((b, pack(p[6][place], p[5][place] + begin[answer], long[answer].astype(np.int32))))
                at += n
        trim()
        return _binary_rows(rows, ["block", "payload"])

    return run


#: Windows that a resolver sees at a time, if one key has no more.
PORTION = 100_000


def resolved(resolve: Resolver, flat, edge, key48, ids, open_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For slices open_ (grouped by key): slice, first unit and size of every run of windows that a smaller document holds."""
    empty = np.empty(0, np.int64)
    found_slice, found_from = [empty], [empty]
    if len(open_):
        bounds = _groups(key48[open_])
        sizes = edge[open_ + 1] - edge[open_] - WINDOW + 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        s = 0
        while s < len(bounds):  # whole keys, about PORTION windows at a time
            e = max(int(np.searchsorted(total[bounds], total[bounds[s]] + PORTION, side="right")), s + 1)
            mine = open_[bounds[s] : bounds[e] if e < len(bounds) else len(open_)]
            which, window = resolve(flat, edge, mine, ids, key48)
            found_slice.append(which)
            found_from.append(window)
            s = e
    which, window = np.concatenate(found_slice), np.concatenate(found_from)
    order = np.lexsort((window, which))
    which, window = which[order], window[order]
    if not len(which):
        return which, window, window
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = _ends(first, len(which)) - 1
    return which[first], window[first], window[last] - window[first] + WINDOW


def smaller_holder(groups: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For equal windows (starts of runs in sorted order) and their ids in that order: whether a smaller id holds it too."""
    if not len(ids):
        return np.empty(0, bool)
    least = np.minimum.reduceat(ids, groups)
    return ids > np.repeat(least, np.diff(np.append(groups, len(ids))))


def removal_mask(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:-1]) > 0


def _cutting(cut: Callable, names: list[str], schema: pa.Schema):
    def run(key, left, right):
        if right.num_rows:
            parts = [unpack(p) for p in right.column("payload").to_pylist()]
            tags, starts, sizes = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.argsort(tags, kind="stable")
            tags, starts, sizes = tags[order], starts[order], sizes[order].astype(np.int64)
        else:
            tags = starts = sizes = np.empty(0, np.int64)
        out = []
        for batch in left.combine_chunks().to_batches(max_chunksize=500):
            own = row_tags(batch)
            s, e = np.searchsorted(tags, own), np.searchsorted(tags, own, side="right")
            values = cut(batch.column("text"), [(starts[a:b], sizes[a:b]) for a, b in zip(s, e, strict=True)])
            kept = [batch.column(c) for c in names]
            out.append(pa.RecordBatch.from_arrays([*kept, *values], schema=schema))
        trim()
        return pa.Table.from_batches(out, schema=schema)

    return run


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_recurring(docs: DataFrame, units: Units, resolve: Resolver, cut: Callable, added: list[tuple[str, str, pa.DataType]], k: int, hot: int = HOT) -> DataFrame:
    """docs with columns added by cut(texts, intervals): one (starts, sizes) of removed stretches, in units, for each row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    docs = docs.drop(BLOCK, *[n for n, _, _ in added])
    names = docs.columns
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16 + total // BUCKET_BYTES
    blocks = _prime(17 + total // BLOCK_BYTES)

    def made(batch):
        _, _, _, row, _, _, key48, content = _sliced(units, k, batch)
        return key48, content, doc_ids(batch.column("doc_id"))[row]

    def to_blocks(key, table):
        answers = settled_slices(table, hot)
        trim()
        return _binary_rows([(b, pack(*[x[w] for x in answers])) for b, w in by_block(answers[2], blocks)], ["block", "payload"])

    placed = docs.withColumn(BLOCK, F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(blocks)), F.lit(0)).cast("long"))
    keys = docs.select("doc_id", "text").mapInArrow(emitting(made, buckets, partial(slice_rows, hot=hot)), "bucket long, kind int, payload binary")
    replies = keys.groupBy("bucket").applyInArrow(to_blocks, "block long, payload binary")
    sent = placed.groupBy(BLOCK).cogroup(replies.groupBy("block")).applyInArrow(_slices_of_block(units, k, buckets), "shard long, block long, settled long, payload binary")
    # what a block has settled needs no shard; it is dealt by block
    dealt = sent.withColumn("shard", F.when(F.col("settled") == 1, F.col("block") % buckets).otherwise(F.col("shard")))
    gone = dealt.groupBy("shard").applyInArrow(_settle_shard(resolve), "block long, payload binary")
    fields = ", ".join(f"`{n}` {t}" for n, t, _ in added)
    schema = pa.schema([*to_arrow_schema(docs.schema), *[pa.field(n, t) for n, _, t in added]])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return placed.groupBy(BLOCK).cogroup(gone.groupBy("block")).applyInArrow(_cutting(cut, names, schema), f"{ddl}, {fields}")
