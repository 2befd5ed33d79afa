"""Toxicity scores from Levenshtein automata intersected with a lexicon trie.

Labelled rows are dealt into two parts by a hash of doc_id. Candidate terms come from the first: words, and beginnings of
words, that its toxic documents hold far more often than its clean ones, after different words (so that a text with many
copies does not make its rare words terms). The second part must confirm them, and says how many edits each term may
take: a distance at which clean documents hold its misspellings too often is out of reach. The weights are fitted on the
second part.

The lexicon's trie is intersected with a Levenshtein automaton, determinised as words are read, so that a word walks
the product letter by letter and leaves it early; accepted words are lexicon terms or begin with one, exact or misspelled.
Each hit is weighed by the window of words around it: quotation marks about it, or words of speech and mention near it,
make it a quotation, which has a weight of its own. A logistic model over the few damped counts gives the score; where
the labels say little, its weights stay near PRIOR.

Training reads at most SAMPLE_ROWS labelled rows (those with the smallest hashes of doc_id) whose crc32(doc_id) mod 5 is
not 0; terms and harmless words are bounded by what these hold. Scoring reads every whole text and no other column.

Defined results: null and empty texts get the score of a text without hits. A doc_id labelled more than once counts as
toxic if any label says so; a null label is none. Without usable labels of both kinds the lexicon is empty and every score
is that of PRIOR's bias alone, 0.01.
Repeated rows get equal rows. Columns other than doc_id and text (and doc_id and toxic of labels) are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import checkpoint, documents, slices, table

SAMPLE_ROWS = 8_000
#: A candidate: toxic documents and contexts of the first part, and its share of the rates among toxic and clean documents.
LEAST_TOXIC, LEAST_CONTEXTS, LEAST_SHARE = 3, 3, 0.95
#: What the second part must show: toxic documents, the share at each distance, and the part of all toxic documents
#: that a term must be in before its misspellings count.
CONFIRMED_TOXIC, CONFIRMED_SHARE, COMMON = 2, 0.95, 0.05
#: What each further hit adds less.
DAMP = 0.25
#: Weights of bias and of hits of common terms, what misspelling adds, and of begun, quoted and rarer (of other terms) hits before any label is seen, and how strongly they are held.
PRIOR, RIDGE = (-4.6, 8.0, -0.5, 6.0, 0.0, 5.0), 0.05
PREFIXES = (4, 5, 6)
WINDOW = 6
EDGES = ".,;:!?\"'()[]{}<>«»“”„‘’-–—*_"
QUOTES = frozenset("\"“”„«»‘’")
MENTIONS = frozenset("said says say wrote writes quote quoted quotes called word words term terms slur reported dijo palabra sagte wort dit mot".split())
STATES = 50_000


def allowed(term: str) -> int:
    """Misspellings of a term: edits that may count at most."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """The lexicon's trie times a Levenshtein automaton; states are made as words need them. Terms come with their edits."""

    def __init__(self, words: dict[str, int], prefixes: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str] = [""]
        self.prefix: list[str] = [""]
        self.most: list[int] = [0]
        self.words, self.prefixes = words, prefixes
        for terms, mark in ((words, self.word), (prefixes, self.prefix)):
            for term, edits in terms.items():
                node = 0
                self.most[0] = max(self.most[0], edits)
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.word.append("")
                        self.prefix.append("")
                        self.most.append(0)
                    node = self.children[node][c]
                    self.most[node] = max(self.most[node], edits)
                mark[node] = term
        self.reset()

    def reset(self) -> None:
        self.ids, self.sets, self.moves, self.ends = {}, [], [], []
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (trie node, edits so far), closed under letters left out; -1 if it is empty."""
        todo = list(nodes.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.most[child] and edits + 1 < nodes.get(child, 99):
                    nodes[child] = edits + 1
                    todo.append((child, edits + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            whole = min(((e, self.word[n]) for n, e in nodes.items() if self.word[n] and e <= self.words[self.word[n]]), default=None)
            begun = min(((e, self.prefix[n]) for n, e in nodes.items() if self.prefix[n] and e <= self.prefixes[self.prefix[n]]), default=None)
            self.ends.append((whole, begun))
        return self.ids[key]

    def move(self, at: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, edits in self.sets[at].items():
            if edits + 1 <= self.most[node]:
                after[node] = min(after.get(node, 99), edits + 1)
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.most[child]:
                    after[child] = min(after.get(child, 99), cost)
        to = self.moves[at][c] = self.state(after)
        return to

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, is_prefix) of the best term that the word spells or misspells, or that begins it."""
        if len(self.sets) > STATES:
            self.reset()
        at, begun = self.start, self.ends[self.start][1] if self.start >= 0 else None
        for c in word:
            to = self.moves[at].get(c)
            at = self.move(at, c) if to is None else to
            if at < 0:
                break
            if (found := self.ends[at][1]) and (begun is None or found < begun):
                begun = found
        whole = self.ends[at][0] if at >= 0 else None
        if whole and (begun is None or whole[0] <= begun[0]):
            return whole[1], whole[0], False
        return begun and (begun[1], begun[0], True)


@dataclass
class Model:
    """A fitted lexicon (terms with their edits, and which of them are common) and the weights as in PRIOR."""

    words: dict[str, int] = field(default_factory=dict)
    prefixes: dict[str, int] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    harmless: frozenset[str] = frozenset()
    weights: tuple[float, ...] = PRIOR


def tokens(text: str) -> list[str]:
    return text.lower().split()


def counts_in(words: list[str], hits: dict[str, tuple[str, int, bool]], common: frozenset[str]) -> tuple[int, int, int, int, int]:
    """How many hits, misspelled, begun, quoted and rarer hits a list of words holds; misspelled ones count as hits too."""
    exact = wrong = begun = quoted = rarer = 0
    for i, w in enumerate(words):
        hit = hits.get(w)
        if hit is None:
            continue
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        opened = w[0] in QUOTES or any(x[0] in QUOTES and x[-1] not in QUOTES for x in before)
        closed = w[-1] in QUOTES or w.rstrip(".,;:!?")[-1:] in QUOTES or any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in after)
        mention = any(x.strip(EDGES) in MENTIONS for x in (*before, *after))
        if opened and closed or mention and (opened or closed):
            quoted += 1
        elif hit[1]:
            exact += not hit[2]
            begun += hit[2]
            wrong += 1
        elif hit[2]:
            begun += 1
        elif hit[0] in common:
            exact += 1
        else:
            rarer += 1
    return exact, wrong, begun, quoted, rarer


def _features(model: Model, texts: list[str | None], automaton: LexiconAutomaton) -> np.ndarray:
    """The model's inputs for each text: 1 and the damped counts of the kinds of hits."""
    split = [tokens(t or "") for t in texts]
    hits = {}
    for w in set().union(*split):
        bare = w.strip(EDGES)
        if bare and bare not in model.harmless and (hit := automaton.match(bare)):
            hits[w] = hit
    keys = hits.keys()
    out = np.zeros((len(texts), len(PRIOR)))
    out[:, 0] = 1
    for i, words in enumerate(split):
        if not keys.isdisjoint(words):
            out[i, 1:] = 1 - DAMP ** np.array(counts_in(words, hits, model.common))
    return out


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document counts of words and beginnings, by label."""
    for batch in slices(batches, "text", 16_000_000):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.strip(EDGES) for w in tokens(text or "")} - {""}
            seen[toxic].update({f"={w}" for w in words} | {f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n})
        terms = [t for t in seen[1]]
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "n_toxic", "n_clean"])
        rest = [t for t, n in seen[0].items() if t not in seen[1]]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(np.zeros(len(rest), np.int64)), pa.array([seen[0][t] for t in rest], pa.int64())], ["term", "n_toxic", "n_clean"])


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = RIDGE) -> np.ndarray:
    """Weights by Newton steps, each halved until it lowers the loss, held near PRIOR."""
    prior = np.array(PRIOR)

    def loss(w):
        return (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + ridge / 2 * ((w - prior) ** 2).sum()

    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _contexts(terms: frozenset[str]):
    """Distinct (term, word before it) in toxic documents."""

    def run(batches):
        for batch in slices(batches, "text", 2_000_000):
            found = set()
            for text in batch.column("text").to_pylist():
                before = ""
                for w in tokens(text or ""):
                    w = w.strip(EDGES)
                    for t in (f"={w}", *[f"^{w[:n]}" for n in PREFIXES if len(w) > n]):
                        if t in terms:
                            found.add((t, before))
                    before = w
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], ["term", "context"])

    return run


def _beginnings(counts: dict[str, int], words: dict[str, int]) -> list[str]:
    """Beginnings that are no words themselves, each grown while nearly all its evidence stays, none within another."""
    found: list[str] = []
    for p in sorted(counts, key=lambda p: (len(p), p)):
        if p in words or any(p.startswith(q) or q.startswith(p) for q in found):
            continue
        while longer := [q for q in counts if len(q) == len(p) + 1 and q.startswith(p) and counts[q] >= 0.9 * counts[p]]:
            p = longer[0]
        if not any(counts[p] < 1.5 * n for w, n in words.items() if w.startswith(p)):
            found.append(p)
    return found


def _confirming(words: dict[str, int], prefixes: dict[str, int]):
    """Partial counts of documents by term, distance and label."""

    def run(batches):
        automaton = LexiconAutomaton(words, prefixes)
        for batch in slices(batches, "text", 2_000_000):
            found: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                bare = {w.strip(EDGES) for w in tokens(text or "")} - {""}
                found.update({(f"{'=^'[hit[2]]}{hit[0]}", hit[1], toxic) for w in bare if (hit := automaton.match(w))})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), *[pa.array([k[j] for k in found], pa.int32()) for j in (1, 2)], pa.array(list(found.values()), pa.int64())], ["term", "edits", "toxic", "n"])

    return run


def confirmed(counts: dict[tuple[str, int], list[int]], terms: dict[str, int], kind: str, n_toxic: int, n_clean: int) -> dict[str, int]:
    """Terms that the second part bears out, with the edits that they may take. counts: of (term, edits), clean and toxic documents."""

    def holds(clean: int, toxic: int) -> bool:
        return not clean or toxic / n_toxic >= CONFIRMED_SHARE * (toxic / n_toxic + clean / n_clean)

    found = {}
    for term, most in terms.items():
        clean, toxic = counts.get((kind + term, 0), (0, 0))
        if toxic >= CONFIRMED_TOXIC and holds(clean, toxic):
            edits = 0
            while edits < most and toxic >= COMMON * n_toxic and holds(*counts.get((kind + term, edits + 1), (0, 0))):
                edits += 1
            found[term] = edits
    return found


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from at most sample_rows labelled rows outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    size = {(r.part, r.toxic): r["count"] for r in chosen.groupBy("part", "toxic").count().collect()}
    if len(size) < 4:
        return Model()
    sample = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(16))  # sample_rows rows
    first, second = sample.where("part = 0"), sample.where("part = 1")
    counted = first.select("text", "toxic").mapInArrow(_counting, "term string, n_toxic long, n_clean long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    rate, clean_rate = F.col("n_toxic") / size[0, 1], F.col("n_clean") / size[0, 0]
    strong = {r.term: r.n_toxic for r in counted.where((F.col("n_toxic") >= LEAST_TOXIC) & (rate >= LEAST_SHARE * (rate + clean_rate))).collect()}  # of the sample's words
    varied = first.where("toxic = 1").select("text").mapInArrow(_contexts(frozenset(strong)), "term string, context string").groupBy("term").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    known = {r.term for r in varied.collect()}
    by_kind = {k: {t[1:]: n for t, n in strong.items() if t[0] == k and t in known} for k in "=^"}
    prefixes = {p: allowed(p) for p in sorted(_beginnings(by_kind["^"], by_kind["="]))}
    words = {w: allowed(w) for w in sorted(by_kind["="]) if len(w) > 3 and not any(w.startswith(p) for p in prefixes)}
    counts: dict[tuple[str, int], list[int]] = {}
    for r in second.select("text", "toxic").mapInArrow(_confirming(words, prefixes), "term string, edits int, toxic int, n long").groupBy("term", "edits", "toxic").agg(F.sum("n").alias("n")).collect():
        counts.setdefault((r.term, r.edits), [0, 0])[r.toxic] = r.n
    model = Model(confirmed(counts, words, "=", size[1, 1], size[1, 0]), confirmed(counts, prefixes, "^", size[1, 1], size[1, 0]))
    model.common = frozenset(w for w in model.words if counts["=" + w, 0][1] >= COMMON * size[1, 1])
    # misspellings that clean documents of the first part hold are ordinary words; the weights learn on the other part what is left
    model.harmless = frozenset(_harmless(first, model))
    rows = second.select("text", "toxic").mapInArrow(_training(model), "x array<double>, toxic int").collect()
    model.weights = tuple(_fit_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)))
    model.harmless |= frozenset(_harmless(second, model))
    return model


def _harmless(sample: DataFrame, model: Model) -> list[str]:
    """Words within the automaton's reach of a lexicon word, but not in it, that occur in clean documents of the sample."""

    def run(batches):
        automaton = LexiconAutomaton(model.words, model.prefixes)
        for batch in slices(batches, "text", 2_000_000):
            words = {w.strip(EDGES) for t in batch.column("text").to_pylist() for w in tokens(t or "")} - {""}
            near = [w for w in words if (hit := automaton.match(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    return [r.word for r in sample.where("toxic = 0").select("text").mapInArrow(run, "word string").distinct().collect()]  # words of the sample


def _training(model: Model):
    def run(batches):
        automaton = LexiconAutomaton(model.words, model.prefixes)
        for batch in slices(batches, "text", 2_000_000):
            x = _features(model, batch.column("text").to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, named: str = "score") -> DataFrame:
    """doc_id (or the columns named by keep, but for one called as `named`) and the score, called `named`, of every row of docs."""
    weights = np.array(model.weights)
    kept = docs.select(*[F.col(f"`{c}`") for c in (keep or ["doc_id"]) if c not in ("text", named)], "text")
    names = kept.columns if keep and "text" in keep else kept.columns[:-1]

    def run(batches):
        automaton = LexiconAutomaton(model.words, model.prefixes)
        for batch in slices(batches, "text", 2_000_000):
            x = _features(model, batch.column("text").to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -40, 40))))], [*names, named])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*[F.col(f"`{n}`") for n in names]).schema)
    return kept.mapInArrow(run, f"{schema}, `{named}` double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
