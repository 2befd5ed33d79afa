"""N-gram Jaccard join by a size-aware heavy-light scheme.

A document's set holds its distinct shingles of so many lower-cased words as the rule says (op10: four). Documents with equal sets are one node. Every
set is put in one global order, frequent shingles last (a sketch of fixed size, counted over all documents, tells which
are frequent); two sets that link must share shingles within prefixes of that order.

* Small sets enumerate fixed-size subsets: all pairs of shingles of a prefix that must share two.
* Large sets are found by the inverted lists of the single shingles of a prefix that must share c of them.

The size that parts small from large is the one with the least cost, from the exact histogram of set sizes. Sets just
above it enumerate subsets too, so no pair falls between.

Candidates are never all pairs of a group. First each set is checked against one other only, the most central set of
most of its lists; linked sets are joined to components. Only lists that hold several components are looked at again:

* In a short list (SHORT sets at most) the pairs of different components meet that share as many keys as their sizes demand.
* A long list gets a representative, and all its sets are compared with that alone. What is left over of each, its
  difference from the representative, decides the rest: two sets link only if their differences are short together (then both
  link with the representative already) or share so many shingles. So the differences' prefixes are new lists, below
  the representative, of sets that differ from it alike; these are treated in the same way, round by round.

Of the pairs that are left, each set's most promising one is checked first, and what a link joins needs no more checks;
in the end all are checked, so no link between components is lost. Every check compares whole sets.

Defined results: a null text, or one without words, has an empty set (0 shingles) and is a component of its own. Fewer
words than a shingle has are one shingle. Rows with the same doc_id belong to one component and get a row each; where their
texts differ, each set counts. A null doc_id has
component null. Other columns are not read; empty tables give empty tables. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.llm.common import BYTE_CODE, checkpoint, documents, gathered, mix, raw_bytes, rolled, slices, small_batches, span_hashes, trim, words_of
from stepweave.llm.components import components
from stepweave.llm.recurring import BLOCK_BYTES, BUCKET_BYTES, SLICE_BYTES, _groups, _prime, emitting, pack, recurring_pairs, unpack



class Rule(NamedTuple):
    """Words of a shingle; links need part * common >= share * union."""

    words: int
    share: int
    part: int

    @property
    def alone(self) -> int:
        """Sets of so many shingles or fewer link with none but equal sets: n / (n + 1) is too little."""
        return (self.share - 1) // (self.part - self.share)


#: The rule of op10.
RULE = Rule(4, 85, 100)
SKETCH_BITS, SKETCH_PARTS = 20, 64
#: Cost of a key of an inverted list against one of a subset: lists of single shingles bring more candidates to check.
LIST_COST = 2.5
SMALL_MOST = 60
#: Sets of a list that may meet pairwise, and rounds of representatives for longer ones (what is long after them meets all the same).
SHORT, LEADS = 24, 2
#: Keys of a set that its rows may carry.
BAG_KEYS = 64
#: Ids (numbers) that may be broadcast; beyond them all texts are shuffled.
BROADCAST_IDS = 500_000
BLOCK = "_jaccard_block"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and n + 1 offsets."""
    low = _LOWER[raw]
    starts, ends, rows = words_of(raw, offsets)
    v = span_hashes(BYTE_CODE[low], starts, ends)
    n = len(offsets) - 1
    count = np.diff(rows)
    owner = np.repeat(np.arange(n), count)
    h = rolled(v, words)
    whole = owner[: len(h)] == owner[words - 1 :][: len(h)] if len(h) else np.empty(0, bool)
    hashes, owners = [h[whole]], [owner[: len(h)][whole]]
    for c in range(1, words):  # texts with fewer words: the whole sequence
        few = np.flatnonzero(count == c)
        hashes.append(span_hashes(v, rows[few], rows[few] + c))
        owners.append(few)
    hashes, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = _groups(owner, hashes)
    hashes, owner = hashes[first], owner[first]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def set_ids(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One number (positive, 63 bits) for each set, from the sums of two mixes of its members."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
    one, two = (t[edge[1:]] - t[edge[:-1]] for t in sums)
    return (mix(one ^ mix(two + np.diff(edge).astype(np.uint64))) >> np.uint64(1)).astype(np.int64)


def least_common(n, rule: Rule):
    """The fewest shingles that a set of n must share with any that it links with."""
    return -(-rule.share * n // rule.part)


def needed(n):
    """How many keys large sets share within their prefixes, at least, if they link."""
    return 1 + n // 40


def common_keys(n_x: Column, n_y: Column, small: int, rule: Rule) -> Column:
    """How many keys two sets that link share at least.

    Of the two prefixes, the one that ends first in the global order shares with the other set only what it shares with
    its prefix; the rest of that set is n - prefix = least_common(n) - needed(n) shingles. Small sets share one subset.
    """
    both = F.ceil(F.lit(rule.share) * (n_x + n_y) / F.lit(float(rule.part + rule.share)) - 1e-9)
    by_one = [both - F.ceil(rule.share * n / F.lit(float(rule.part)) - 1e-9) + 1 + F.floor(n / 40) for n in (n_x, n_y)]
    return F.when(F.least(n_x, n_y) > small, F.least(*by_one)).otherwise(1)


def boundary(histogram: dict[int, int], rule: Rule = RULE) -> int:
    """The largest size of sets that enumerate subsets: least total cost of keys."""
    def subsets(n):
        p = n - least_common(n, rule) + 2
        return p * (p - 1) // 2

    def lists(n):
        return LIST_COST * (n - least_common(n, rule) + needed(n))

    return min(range(rule.alone, SMALL_MOST + 1), key=lambda b: sum(f * ((subsets(n) if rule.part * b >= rule.share * n else 0) + (lists(n) if n > b else 0)) for n, f in histogram.items() if n > rule.alone))


def set_keys(hashes: np.ndarray, edge: np.ndarray, weight: np.ndarray, small: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """48-bit keys of each set, and the set's place; weight: the sketch's class of frequency of each slot."""
    size = np.diff(edge)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((hashes, weight[hashes >> np.uint64(64 - SKETCH_BITS)], owner))
    hashes = hashes[order]
    place = np.arange(len(hashes)) - edge[owner]
    n = size[owner]
    single = (n > max(small, rule.alone)) & (place < n - least_common(n, rule) + needed(n))
    keys, owners = [mix(hashes[single]) >> np.uint64(16)], [owner[single]]
    for i in np.flatnonzero((size > rule.alone) & (rule.part * small >= rule.share * size)):
        h = hashes[edge[i] : edge[i] + size[i] - least_common(size[i], rule) + 2]
        a, b = np.triu_indices(len(h), 1)
        x, y = np.minimum(h[a], h[b]), np.maximum(h[a], h[b])
        keys.append(mix(x * np.uint64(0x9E3779B97F4A7C15) + y) >> np.uint64(16))
        owners.append(np.full(len(a), i))
    return np.concatenate(keys), np.concatenate(owners)


def _profiling(batches, words: int):
    """Rows (kind, part, payload): 0, ids with sizes and set ids; 1, counts of one part of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in slices(batches, "text", SLICE_BYTES):
        hashes, edge = shingle_sets(*raw_bytes(batch.column("text")), words)
        np.add.at(sketch, (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        ids = batch.column("doc_id").cast(pa.int64())
        payload = pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(edge).astype(np.int64), set_ids(hashes, edge))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([payload], pa.binary())], ["kind", "part", "payload"])
    rows = [(1, p, pack(c)) for p, c in enumerate(np.split(sketch, SKETCH_PARTS)) if c.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "part", "payload"])


def _sets(batches):
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            ids, known, n, sid = unpack(payload)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(n), pa.array(sid)], ["doc_id", "n_shingles", "sid"])


def _adding(key, table):
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([pack(sum(unpack(p)[0] for p in table.column("payload").to_pylist()))], pa.binary())})


def _placed(docs: DataFrame, blocks: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").withColumn(BLOCK, F.pmod("doc_id", F.lit(blocks)))


def _wanted_sets(left, ids, words: int):
    """(doc_id, hashes) of some documents of a block, once for each set that rows of a doc_id have."""
    seen = set()
    rows = left.filter(pc.is_in(left.column("doc_id"), pa.array(ids)))
    for batch in slices(iter(rows.combine_chunks().to_batches()), "text", SLICE_BYTES):
        hashes, edge = shingle_sets(*raw_bytes(batch.column("text")), words)
        for d, s, e in zip(batch.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if (known := (d, hash(hashes[s:e].tobytes()))) not in seen:
                seen.add(known)
                yield d, hashes[s:e]


def _shipping(key, left, right, rule: Rule):
    """Sets asked for, packed for each block that asks."""
    asked: dict[int, list[int]] = {}
    for b, target in zip(right.column("b").to_pylist(), right.column("target").to_pylist(), strict=True):
        asked.setdefault(b, []).append(target)
    out: dict[int, list] = {}
    if asked:
        for d, h in _wanted_sets(left, list(asked), rule.words):
            for target in asked[d]:
                out.setdefault(target, []).append((d, h))
    trim()
    rows = [(t, pack(np.array([d for d, _ in x]), np.array([len(h) for _, h in x]), np.diff(np.concatenate([h for _, h in x]), prepend=np.uint64(0)))) for t, x in out.items()]
    return pa.table({BLOCK: pa.array([r[0] for r in rows], pa.int64()), "a": pa.array([None] * len(rows), pa.int64()), "b": pa.array([None] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _brought_together(left, right, words: int):
    """(a, b, a's set, b's set) of the pairs of a block of a, for every set that rows of either doc_id have."""
    pairs: dict[int, list[int]] = {}
    others: dict[int, list[np.ndarray]] = {}
    for a, b, payload in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), right.column("payload").to_pylist(), strict=True):
        if payload is None:
            pairs.setdefault(a, []).append(b)
        else:
            ids, sizes, deltas = unpack(payload)
            flat, edge = np.cumsum(deltas, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])
            for d, s, e in zip(ids.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                others.setdefault(d, []).append(flat[s:e])
    if pairs:
        for a, mine in _wanted_sets(left, list(pairs), words):
            for b in pairs[a]:
                for other in others.get(b, ()):
                    if len(other) and len(mine):
                        yield a, b, mine, other


def _holds(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the values stand in the ascending array `of`."""
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _checking(key, left, right, rule: Rule):
    """Of the pairs (a, b) of a block of a, those that link."""
    found = set()
    for a, b, mine, other in _brought_together(left, right, rule.words):
        common = int(_holds(other, mine).sum())
        if rule.part * common >= rule.share * (len(mine) + len(other) - common):
            found.add((a, b))
    found = sorted(found)
    trim()
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def least_shared(excess: int, n: int, n_lead: int, near: bool, rule: Rule) -> int:
    """How many shingles a set's difference from a representative shares at least with that of any set that it links with.

    Of sets x and y with differences X and Y, the symmetric difference has |X| + |Y| - 2 |X and Y| members, and they link if
    that is at most r (|x| + |y|), r = (part - share) / (part + share). So |X and Y| must reach half of the sum of their
    excesses |X| - r |x| and |Y| - r |y|. The representative of n_lead shingles has the least excess that there is,
    -r n_lead; a set links with it if its own is r n_lead or less. At least one of two sets in different components does not.
    And |Y| is |X| - r (|x| + |y|) at least, so y's excess is x's less 2 r |y| at least, where |y| is n part / share at most.
    The excess is given times part + share, a whole number.
    """
    both, reach = rule.part + rule.share, (rule.part - rule.share) * n_lead
    by_lead = -(-(excess + (reach + 1 if near else -reach)) // (2 * both))
    by_size = -(-(excess * rule.share - (rule.part - rule.share) * n * rule.part) // (both * rule.share))
    return max(1, by_lead, by_size)


def _differing(key, left, right, rule: Rule, weight: np.ndarray):
    """(a, b, n, gap, excess, near, keys): how set a differs from its representative b.

    keys: the prefix of its difference; shingles that the representative lacks first (those that it has are lacking in most
    of the sets that are unlike it), rare ones before frequent ones.
    """
    rows = []
    for a, b, mine, other in _brought_together(left, right, rule.words):
        gone, new = other[~_holds(other, mine)], mine[~_holds(mine, other)]
        gone, new = (part[np.lexsort((part, weight[part >> np.uint64(64 - SKETCH_BITS)]))] for part in (gone, new))
        differs = np.concatenate([new, gone])
        excess = (rule.part + rule.share) * len(differs) - (rule.part - rule.share) * len(mine)
        near = excess <= (rule.part - rule.share) * len(other)
        keep = max(0, len(differs) - least_shared(excess, len(mine), len(other), near, rule) + 1)
        rows.append((a, b, len(mine), len(differs), excess, near, (mix(differs[:keep] ^ mix(np.full(1, b, np.uint64)))).astype(np.int64)))
    trim()
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]
    return pa.table({name: pa.array([r[j] for r in rows], kind) for j, (name, kind) in enumerate(zip(("a", "b", "n", "gap", "excess", "near", "keys"), kinds, strict=True))})


def _compared(docs: DataFrame, pairs: DataFrame, blocks: int, rule: Rule, compare, returns: str) -> DataFrame:
    """compare(block of a, sets of b and pairs) of pairs (a, b) of doc_ids; b's set travels once to each block of a.

    Documents in no pair are left out before the shuffle where a count has shown the ids of the others to be few.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    placed = _placed(docs, blocks)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        placed = placed.join(F.broadcast(ids), "doc_id", "left_semi")
    own = pairs.withColumn(BLOCK, F.pmod("a", F.lit(blocks)))
    asked = own.select("b", F.col(BLOCK).alias("target")).distinct().withColumn(BLOCK, F.pmod("b", F.lit(blocks)))
    kinds = f"`{BLOCK}` long, a long, b long, payload binary"
    sent = placed.groupBy(BLOCK).cogroup(asked.groupBy(BLOCK)).applyInArrow(lambda key, left, right: _shipping(key, left, right, rule), kinds)
    work = sent.unionByName(own.select(BLOCK, "a", "b", F.lit(None).cast("binary").alias("payload")))
    return placed.groupBy(BLOCK).cogroup(work.groupBy(BLOCK)).applyInArrow(compare, returns)


def linked(docs: DataFrame, pairs: DataFrame, blocks: int, rule: Rule) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link, by comparing whole sets."""
    return _compared(docs, pairs, blocks, rule, lambda key, left, right: _checking(key, left, right, rule), "a long, b long")


def differences(docs: DataFrame, pairs: DataFrame, blocks: int, rule: Rule, weight) -> DataFrame:
    """How set a of each pair differs from its representative b."""
    return _compared(docs, pairs, blocks, rule, lambda key, left, right: _differing(key, left, right, rule, weight.value), "a long, b long, n long, gap long, excess long, near boolean, keys array<long>")


def _mixed(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of lists that hold several components, with the component c and the size of the list."""
    known = lists.join(joined.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = known.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("long")).where("low < high").select("key", "long")
    return known.join(mixed, "key")


def _by_size(rows: DataFrame, rule: Rule) -> DataFrame:
    """Each list as one of each two neighbouring bands of size; sets that link are in one band or in neighbouring ones."""
    band = F.floor(F.ln("n") / float(np.log(rule.part / rule.share)) + 1e-9)
    return rows.withColumn("key", F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band + 1))))


def near_duplicates(docs: DataFrame, words: int = RULE.words, share: int = RULE.share, part: int = RULE.part) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links), one row for each row of docs.

    Sets of shingles of so many words link where part * common >= share * union.
    """
    if not part < 2 * share < 2 * part:  # sets that link must share two shingles at least
        raise ValueError(f"share must be more than half of part and less than part, not {share} of {part}")
    rule = Rule(words, share, part)
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = _prime(17 + total // BLOCK_BYTES), 16 + total // BUCKET_BYTES
    profile = checkpoint(docs.mapInArrow(partial(_profiling, words=words), "kind int, part int, payload binary"))
    sets = profile.where("kind = 0").mapInArrow(_sets, "doc_id long, n_shingles long, sid long")
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in profile.where("kind = 1").groupBy("part").applyInArrow(_adding, "part int, payload binary").collect():  # SKETCH_PARTS rows of fixed size
        counts[r.part] = unpack(r.payload)[0]
    weight = spark.sparkContext.broadcast(np.ceil(np.log2(counts.ravel() + 1)).astype(np.uint8))
    reps = sets.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    reps = checkpoint(reps)
    # doc_ids whose rows have different sets
    several = gathered(sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("doc_id"))
    mine = sets.where("n_shingles > 0").join(several, "doc_id").join(reps.select("sid", "rep"), "sid").select("doc_id", "rep").distinct()
    same = mine.join(mine.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    histogram = {r.n: r["count"] for r in reps.where(f"n <= {2 * SMALL_MOST}").groupBy("n").count().collect()}
    small = boundary(histogram, rule)

    def pairs(batch):
        hashes, edge = shingle_sets(*raw_bytes(batch.column("text")), words)
        keys, owner = set_keys(hashes, edge, weight.value, small, rule)
        return keys, set_ids(hashes, edge)[owner]

    def listing(key, table):
        keys, ids, seen = recurring_pairs(table)
        return pa.table({"key": pa.array(keys.astype(np.int64)), "sid": pa.array(ids), "seen": pa.array(seen)})

    lists = docs.where("doc_id IS NOT NULL").mapInArrow(emitting(pairs, buckets), "bucket long, kind int, payload binary").groupBy("bucket").applyInArrow(listing, "key long, sid long, seen long")
    # sets by the smallest document that has them; a set whose keys many others hold is central
    central = F.sum("seen").over(W.partitionBy("sid"))
    lists = checkpoint(lists.join(reps, "sid").select("key", F.col("rep").alias("node"), "n", central.alias("central")))
    lead = lists.groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("less"), "n")).alias("l")).select("key", (-F.col("l.less")).alias("lead"), F.col("l.n").alias("n_lead"))
    near = f"node <> lead AND {part} * least(n, n_lead) >= {share} * greatest(n, n_lead)"
    tries = lists.join(lead, "key").where(near).groupBy("node", "lead", "n", "n_lead").count().where(F.col("count") >= common_keys(F.col("n"), F.col("n_lead"), small, rule))
    one = gathered(tries.groupBy("node").agg(F.max(F.struct("count", -F.col("lead"))).alias("t")).select(F.col("node").alias("a"), (-F.col("t.col2")).alias("b")))
    links = gathered(linked(docs, one, blocks, rule).unionByName(same))
    joined = components(links)
    rows = gathered(_mixed(lists, joined))
    # sets with few keys bring them along, so that a pair is met once, at its smallest common key of a short list, and only if it shares enough
    bags = lists.join(rows.where(f"long <= {SHORT}").select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
    brief = rows.where(f"long <= {SHORT}").groupBy("node").agg(F.collect_set("key").alias("brief"))
    carried = bags.where(F.size("keys") <= BAG_KEYS).join(brief, "node")
    short = rows.where(f"long <= {SHORT}").join(carried, "node", "left")
    x, y = (short.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "c", "keys", "brief")]) for s in "xy")
    apart = f"node_x < node_y AND c_x <> c_y AND {part} * least(n_x, n_y) >= {share} * greatest(n_x, n_y)"
    both = F.array_intersect("keys_x", "keys_y")
    told = F.col("keys_x").isNotNull() & F.col("keys_y").isNotNull()
    enough = common_keys(F.col("n_x"), F.col("n_y"), small, rule)
    meets = x.join(y, "key").where(apart).where(F.when(told, (F.array_min(F.array_intersect("brief_x", "brief_y")) == F.col("key")) & (F.size(both) >= enough)).otherwise(True))
    left = meets.groupBy(F.col("node_y").alias("a"), F.col("node_x").alias("b"), "n_x", "n_y").agg(F.max(F.when(told, F.size(both))).cast("long").alias("common"))
    # sets with many keys have met at any of them; their keys are compared now, once for each pair
    whole = left.where("common IS NULL").join(bags.select(F.col("node").alias("a"), F.col("keys").alias("keys_x")), "a").join(bags.select(F.col("node").alias("b"), F.col("keys").alias("keys_y")), "b")
    whole = whole.withColumn("common", F.size(both).cast("long")).where(F.col("common") >= enough)
    left = left.where("common IS NOT NULL").select("a", "b", "common").unionByName(whole.select("a", "b", "common"))
    # pairs that have met in no short list share as many keys of long ones as their sizes demand at least
    long = rows.where(f"long > {SHORT}").select("key", "node", "n", "central")
    able = long.groupBy("node", "n").count().where(F.col("count") >= F.when(F.floor(share * F.col("n") / F.lit(part)) > small, 1 + F.floor(F.col("n") / 40)).otherwise(1))
    rows = gathered(_mixed(_by_size(long.join(able.select("node", "n"), ["node", "n"]), rule), joined))
    for round_ in range(LEADS):
        if rows.isEmpty():
            break
        # a list's representative: its most central set; in later rounds all sets of a list differ from the last one alike
        lead = rows.groupBy("key").agg(F.max(F.struct("central", -F.col("node"))).alias("l")).select("key", (-F.col("l.col2")).alias("b"))
        asked = gathered(rows.join(lead, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
        found = gathered(differences(docs, asked, blocks, rule, weight), 20_000)
        links = gathered(links.unionByName(found.where("near").select("a", "b")).distinct())
        joined = components(links)
        central = rows.groupBy(F.col("node").alias("a")).agg(F.max("central").alias("central"))
        spread = found.join(central, "a").select(F.col("a").alias("node"), "n", "gap", "excess", "near", "central", F.posexplode("keys").alias("place", "key"))
        rows = gathered(_mixed(spread, joined))
        last = round_ + 1 == LEADS
        x, y = ((rows if last else rows.where(f"long <= {SHORT}")).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "c", "gap", "excess", "near", "place")]) for s in "xy")
        shared = f"ceil((excess_x + excess_y) / {2.0 * (part + share)} - 1e-9)"
        meets = x.join(y, "key").where(apart).where(f"NOT (near_x AND near_y) AND least(gap_x - place_x, gap_y - place_y) >= {shared}")
        left = left.unionByName(meets.select(F.col("node_y").alias("a"), F.col("node_x").alias("b")).distinct().withColumn("common", F.lit(1).cast("long")))
        rows = rows.where(f"long > {SHORT}").select("key", "node", "n", "c", "central").distinct()
    left = gathered(left.groupBy("a", "b").agg(F.max("common").alias("common")).join(one, ["a", "b"], "left_anti"))
    # the most promising pair of each set first: what it joins needs no more checks
    best = gathered(left.groupBy("a").agg(F.max(F.struct("common", "b")).alias("t")).select("a", "t.b"))
    if not best.isEmpty():
        links = gathered(links.unionByName(linked(docs, best, blocks, rule)))
        joined = components(links)
        own = lambda side, name: F.coalesce(F.col(name), F.col(side))
        left = left.join(best, ["a", "b"], "left_anti").join(joined.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(joined.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        left = gathered(left.where(own("a", "ca") != own("b", "cb")).select("a", "b"))
    final = components(gathered(links.unionByName(linked(docs, left.select("a", "b"), blocks, rule))))
    nodes = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    found = sets.join(nodes, "sid", "left")
    if not several.isEmpty():  # a row without words goes with the others of its doc_id
        found = found.join(found.where("n_shingles > 0").join(several, "doc_id").groupBy("doc_id").agg(F.min("component").alias("shared")), "doc_id", "left")
        own = F.coalesce("shared", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
        return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def components_by_brute_force(texts: dict[int, str], rule: Rule = RULE) -> dict[int, tuple[int, int]]:
    """What near_duplicates returns, by comparing all pairs; for tests on few texts."""
    sets = {}
    for d, t in texts.items():
        words = [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        sets[d] = {tuple(words[i : i + rule.words]) for i in range(len(words) - rule.words + 1)} if len(words) >= rule.words else {tuple(words)} if words else set()
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(d for d in texts if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if rule.part * small >= rule.share * large:
                common = len(sets[a] & sets[b])
                if rule.part * common >= rule.share * (small + large - common):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {d: (len(sets[d]), top(d)) for d in texts}
