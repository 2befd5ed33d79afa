"""Benchmark decontamination by MinHash containment search with exact verification, in DataFrame operations only.

Test items are short and documents long, so the search is for containment of an item's shingles (five lower-cased words)
in a document, not for similarity. Items are partitioned by size into powers of two; an item's sketch is the bottom k of
its hashed shingles with k = floor((1 - threshold) * upper size of its partition) + 1. A document that holds the share
`threshold` of an item's shingles misses fewer than k of them, so it holds one of any k: the search loses nothing. Pairs
found through sketches are verified by the exact shingles of both texts.

Defined results: an item with fewer than five words has its whole word sequence as its one shingle, and documents are
searched for word runs of that length too; items without words match nothing, as do null and empty documents. Repeated
documents (or items) give repeated pairs only once for each doc_id and item_id: their texts are searched each and the
best containment counts. Rows with a null doc_id or item_id take no part (decontaminate() keeps them). Other columns of either table are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import checkpoint, documents, table, with_row_key

WORDS = 5
THRESHOLD = 0.8
#: Pairs of two numbers that may be broadcast, and sketch rows; beyond them joins shuffle.
BROADCAST_ROWS = 100_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, not once for each use within a lambda."""
    return F.transform(F.array(value), body)[0]


def _grams(w: Column, n: int) -> Column:
    """Runs of n words, as text."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1, F.lit(1)), lambda i: F.array_join(F.slice(w, i, n), " "))


def _gram_hashes(h: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - n, F.lit(1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))


def _if_long(w: Column, n: int, made: Column, kind: str) -> Column:
    return F.when(F.size(w) >= n, made).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(text: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of the given lengths."""
    def all_runs(h: Column) -> Column:
        return F.flatten(F.array(*[_if_long(h, n, _gram_hashes(h, n), "bigint") for n in lengths]))

    return _let(F.transform(_words(text), lambda x: F.xxhash64(x)), all_runs)


def shingles(text: Column, n: int) -> Column:
    return _let(_words(text), lambda w: F.array_distinct(_if_long(w, n, _grams(w, n), "string")))


def sketches(items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """item_id, n (words in a shingle), grams (exact shingles) and sketch (bottom k of their hashes)."""
    rows = items.select("item_id", F.col("text").alias("item_text"), F.least(F.size(_words(F.col("text"))), F.lit(words)).alias("n")).where("n > 0")
    hashed = F.flatten(F.array(*[F.when(F.col("n") == k, shingle_hashes(F.col("item_text"), [k])).otherwise(F.array().cast("array<bigint>")) for k in range(1, words + 1)]))
    exact = F.flatten(F.array(*[F.when(F.col("n") == k, shingles(F.col("item_text"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, words + 1)]))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("grams"))))
    k = (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int")
    return rows.select("item_id", "n", exact.alias("grams"), F.array_sort(F.array_distinct(hashed)).alias("hashes")).select("item_id", "n", "grams", F.slice("hashes", 1, k).alias("sketch"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what a count has shown to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared and containment of the pairs at or above the threshold."""
    sketched = checkpoint(sketches(items, threshold))
    lengths = [r.n for r in sketched.select("n").distinct().orderBy("n").collect()] or [WORDS]  # five values at most
    probes = sketched.select("item_id", F.explode("sketch").alias("hash"))
    seen = docs.select("doc_id", F.explode(shingle_hashes(F.col("text"), lengths)).alias("hash"))
    found = checkpoint(seen.join(_small(probes), "hash").select("doc_id", "item_id").distinct())
    pairs = docs.select("doc_id", "text").join(_small(found), "doc_id").join(_small(sketched.select("item_id", "n", "grams")), "item_id")
    same = F.flatten(F.array(*[F.when(F.col("n") == k, shingles(F.col("text"), k)).otherwise(F.array().cast("array<string>")) for k in lengths]))
    counted = pairs.select("doc_id", "item_id", F.size("grams").cast("long").alias("n_item_shingles"), F.size(F.array_intersect(F.col("grams"), same)).cast("long").alias("n_shared"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item_shingles"), "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", F.round(F.col("b.n_shared") / F.col("b.n_item_shingles"), 6).alias("containment")).where(F.col("n_shared") >= threshold * F.col("n_item_shingles") - 1e-9)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no test item; of rows with one doc_id each is judged by its own text."""
    keyed, key = with_row_key(docs)
    hit = contaminated_pairs(keyed.select(F.col(key).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(_small(checkpoint(hit)), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, string_split_regex(t, '[\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM documents) WHERE t <> ''),
iw AS (SELECT item_id, string_split_regex(t, '[\x20\x09-\x0D]+') AS w FROM (SELECT item_id, regexp_replace(lower(coalesce(text, '')), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM benchmark) WHERE t <> ''),
items AS (SELECT item_id, least(len(w), 5) AS n, w FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, g FROM (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items))),
size AS (SELECT item_id, count(*) AS n_item_shingles FROM ig GROUP BY item_id),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM items))),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (n, g) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, round(n_shared / n_item_shingles, 6) AS containment
FROM hit JOIN size USING (item_id) WHERE 5 * n_shared >= 4 * n_item_shingles
"""
