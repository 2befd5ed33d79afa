"""Quality scores from a weak-label model.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on every whole text. Expectation maximisation estimates each
labeller's accuracies, and the share of good documents, from the counts of vote patterns over all documents (there are
at most 3 ** labellers patterns, however many documents). The posterior of a document's pattern is its soft label, and
the labels of at most SAMPLE_ROWS documents (those with the smallest hashes of doc_id) train a linear scorer over
hashed word shapes, words and endings. The scorer then reads every whole text; its score decides.

No label of the table `labels` is read: it only serves to measure the result.

Defined results: null and empty texts, and texts without words, are bad with score 0. Equal texts get equal values and
repeated rows equal rows. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import BYTE_CODE, checkpoint, documents, mix, raw_bytes, slices, span_hashes, words_of

SAMPLE_ROWS = 4_000
HASH_BITS = 15
ROUNDS = 80
LABELLERS = ("symbols", "word_length", "digits", "repeated_lines", "repeated_pairs", "twins", "short_words", "bare_symbols", "size")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_USUAL = _LETTER | _DIGIT | np.isin(np.arange(256), list(b" \t\n\r.,;:!?'\"()-"))
_SHAPE = np.where(_LETTER, ord("a"), np.where(_DIGIT, ord("0"), np.arange(256))).astype(np.uint8)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each owner's hashes, how many are not the first of their value."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=n)[:n]


def _two_sided(value: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Good on one side of `good`, bad on the other side of `bad`, no vote between them."""
    up = good > bad
    return np.where((value >= good) if up else (value <= good), 1, np.where((value <= bad) if up else (value >= bad), 0, -1)).astype(np.int8)


def _twins(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words equal the word before them in their text."""
    twin = np.zeros(len(words), bool)
    twin[1:] = words[1:] == words[:-1]
    twin[rows[:-1][rows[:-1] < len(words)]] = False
    return twin


def votes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of votes for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, rows = words_of(raw, offsets)
    n_words = np.diff(rows)
    some = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(n), n_words)
    code = BYTE_CODE[raw]
    words = span_hashes(code, starts, ends)
    length = ends - starts
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    bare = (letters[ends] - letters[starts]) == 0
    newline = np.flatnonzero(raw == 10)
    line_ends = np.sort(np.concatenate([newline, offsets[1:]]))
    line_starts = np.sort(np.concatenate([newline + 1, offsets[:-1]]))
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.maximum(np.bincount(line_owner, minlength=n)[:n], 1)
    pairs = words[:-1] * np.uint64(3) + words[1:]
    same = owner[:-1] == owner[1:]
    pair_share = _repeats(pairs[same], owner[:-1][same], n) / some
    twin_share = _sums(_twins(words, rows), rows) / some
    enough = n_words >= 20
    out = np.stack([
        _two_sided(_sums(~_USUAL[raw], offsets) / size, 0.01, 0.05),
        np.where(n_words == 0, 0, _two_sided(np.abs(np.bincount(owner, length, minlength=n)[:n] / some - 6), 2.5, 6)),
        _two_sided(_sums(_DIGIT[raw], offsets) / size, 0.02, 0.4),
        _two_sided(_repeats(span_hashes(code, line_starts, line_ends), line_owner, n) / lines, 0.1, 0.4),
        _two_sided(pair_share, 0.2, 0.6),
        _two_sided(twin_share, 0.05, 0.15),
        np.where(enough, _two_sided(np.bincount(owner[length <= 3], minlength=n)[:n] / some, 0.15, 0.03), -1),
        _two_sided(np.bincount(owner[bare], minlength=n)[:n] / some, 0.01, 0.1),
        np.where(n_words == 0, 0, np.where(enough, 1, -1)).astype(np.int8),
    ], axis=1)
    return out.astype(np.int8)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text's words, end to end, and n + 1 offsets: shape, word, last two bytes and whether it repeats the word before."""
    starts, ends, rows = words_of(raw, offsets)
    mask = np.uint64((1 << HASH_BITS) - 1)
    code = BYTE_CODE[raw]
    words = span_hashes(code, starts, ends)
    twins = mix(_twins(words, rows).astype(np.uint64) + np.uint64(11))
    kinds = (span_hashes(BYTE_CODE[_SHAPE[raw]], starts, ends), words * np.uint64(5), span_hashes(BYTE_CODE[_SHAPE[raw]], np.maximum(ends - 2, starts), ends) * np.uint64(7), twins)
    flat = np.stack([(k >> np.uint64(40)) & mask for k in kinds], axis=1).astype(np.int32).ravel()
    return flat, rows * 4


def _mean(weights: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 without any."""
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    return (total[rows[1:]] - total[rows[:-1]]) / np.maximum(np.diff(rows), 1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Patterns (p by labellers) and their counts to the posteriors of `good`, its share, and accuracies.

    accuracies[l, c, v] is the chance that labeller l, when it votes, votes v on a document of class c; that it
    abstains tells nothing. Smoothing counts keep every chance above 0. It begins from the majority vote, with any bad
    vote counting double, so that `good` keeps its meaning.
    """
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    for_good, for_bad = good.sum(axis=1), 2 * bad.sum(axis=1)
    post = np.where(for_good + for_bad > 0, np.clip(for_good / np.maximum(for_good + for_bad, 1), 0.05, 0.95), 0.5)
    post = np.where(for_bad > 0, np.minimum(post, 0.5), post)
    acc = np.zeros((patterns.shape[1], 2, 2))
    share = 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        share = float(np.clip(weight[1].sum() / max(counts.sum(), 1), 0.01, 0.99))
        acc = np.stack([bad.T @ weight.T, good.T @ weight.T], axis=2) + 0.5
        acc /= acc.sum(axis=2, keepdims=True)
        log = np.log([[1 - share], [share]]) + np.log(acc[:, :, 0]).T @ bad.T + np.log(acc[:, :, 1]).T @ good.T
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if not len(new) or np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, share, acc


def train(flat: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """A logistic scorer on mean weights, by full-batch steps scaled to each feature (Adagrad)."""
    n = max(len(y), 1)
    w, bias, seen, seen_bias = np.zeros(1 << HASH_BITS), 0.0, np.full(1 << HASH_BITS, 1e-8), 1e-8
    lengths = np.diff(rows)
    share = np.repeat(1 / np.maximum(lengths, 1), lengths)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(20 * _mean(w, flat, rows) + bias, -30, 30)))
        grad = np.bincount(flat, np.repeat((p - y) / n, lengths) * share, minlength=len(w)) + 1e-7 * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
        g = float(np.mean(p - y)) if len(y) else 0.0
        seen_bias += g * g
        bias -= rate * g / np.sqrt(seen_bias)
    return w, bias


def _voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        cast = votes(*raw_bytes(batch.column("text"))).astype(np.int64) + 1
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((cast * 3 ** np.arange(cast.shape[1])).sum(axis=1))], ["doc_id", "pattern"])


def _sampling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        flat, rows = features(*raw_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([flat[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary()), batch.column("posterior")], ["features", "posterior"])


def _scoring(w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, rows = features(*raw_bytes(batch.column("text")))
            score = 1 / (1 + np.exp(-np.clip(20 * _mean(w, flat, rows) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(np.diff(rows) > 0, score, 0.0))], ["doc_id", "score"])

    return run


def labeller_votes(docs: DataFrame) -> DataFrame:
    """doc_id and pattern: the votes as digits of base 3 (0 none, 1 bad, 2 good), first labeller lowest."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_voting, "doc_id long, pattern long")


def weak_labels(cast: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """pattern and posterior of every pattern that occurs, and the accuracies."""
    found = cast.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** labellers rows at most
    codes = np.array([r["pattern"] for r in found], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1
    post, _, acc = expectation_maximisation(patterns, np.array([r["count"] for r in found], float))
    rows = [(int(c), float(p)) for c, p in zip(codes, post, strict=True)] or [(-1, 0.5)]
    return cast.sparkSession.createDataFrame(rows, "pattern long, posterior double"), acc


def score_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, posterior (of the labellers' votes) and score (of the trained scorer), one row for each row of docs."""
    cast = checkpoint(labeller_votes(docs))
    posterior, _ = weak_labels(cast)
    labelled = cast.join(F.broadcast(posterior), "pattern").select("doc_id", "posterior")
    chosen = labelled.groupBy("doc_id").agg(F.max("posterior").alias("posterior")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("text", "posterior").mapInArrow(_sampling, "features binary, posterior double")
    rows = sample.collect()  # of sample_rows documents
    parts = [np.frombuffer(r.features, np.int32) for r in rows]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    w, bias = train(np.concatenate(parts) if parts else np.empty(0, np.int32), ends, np.array([r.posterior for r in rows]))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scoring(w, bias), "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir)).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("keep"))
