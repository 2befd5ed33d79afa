"""Personal data (operator 13): a character-level bidirectional LSTM with CRF transitions beside four exact patterns.

Patterns find emails, IP addresses, card numbers and phone numbers; each is scanned in time linear in the text. Their spans in a
bounded sample (SAMPLE documents) train the tagger in numpy on the driver: windows around spans, some of them with the
spans written in other ways (phone numbers without their plus, letters with accents in an email), and windows without any. Every text is then cut
into overlapping windows that cover all of it; both directions run over all windows of a batch at once, Viterbi decodes
each window (a window whose margins prove that no label but O can win needs no search), and where windows overlap each character takes
the label of the window that sees more around it. Labelled runs become spans of the whole text. A span that the tagger adds has to pass
its kind's own test (Luhn, parts of an address, numbers of digits), stand free of letters and digits, and touch no span of a pattern, but for
an email that the pattern saw only a part of.

The gates are piecewise linear (clipped lines), which costs a third of the time of sigmoids and trains as well here.

Null texts are empty and have no spans. Very long texts are windows like others. Repeated rows give repeated rows. Where
no document of the table has a span, nothing is trained and nothing added. Empty in, empty out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import documents, slices

KINDS = ("email", "ip", "card", "phone")
#: Labels: none, then one for each kind.
LABELS = 1 + len(KINDS)
SAMPLE, SAMPLE_WINDOWS = 1500, 6
WINDOW, OVERLAP, STEP = 160, 32, 16
HIDDEN, BATCH, ROUNDS, TRAIN_WIDTH = 8, 128, 300, 64

_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")

# Fixed: signs with a class of their own; digits, small and capital letters, white space and all else share theirs.
_SIGNS = "@.-+()_%:/,=\"'#"
CLASSES = 8 + len(_SIGNS)
_CLASS = np.full(128, 6, np.intp)
_CLASS[:33] = 5
_CLASS[[ord(c) for c in "0123456789"]] = 4
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[32] = 7
for _i, _c in enumerate(_SIGNS):
    _CLASS[ord(_c)] = 8 + _i

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns by kind, then start; matches that fail their kind's test are dropped without a retry."""
    out: list[Span] = []
    at, since = text.find("@"), 0
    while at >= 0:  # the match of an @ begins where the run of signs before it does, but not within the last match
        start = at
        while start > since and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
        since = found.end() if found else at + 1
        at = text.find("@", since)
    if "." in text:
        for run in _DOTTED.finditer(text):
            parts = list(_DIGITS.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):  # four numbers at a time, from the left
                if all(len(p := m.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for m in parts[i : i + 4]):
                    out.append((1, parts[i].start(), parts[i + 3].end()))
    for run in _CARD.finditer(text):
        if run.end() - run.start() >= 13 and 13 <= len(d := _digits(run.group())) <= 19 and luhn(d):
            out.append((2, run.start(), run.end()))
    if "+" in text:
        for run in _PHONE.finditer(text):
            if 9 <= len(_digits(run.group())) <= 15:
                out.append((3, run.start(), run.end()))
    return out


def classes_of(text: str) -> np.ndarray:
    """A class for each code point; 0 is kept for padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 1)


# --- the tagger -----------------------------------------------------------------------------------------------------


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (4 * HIDDEN, CLASSES))
        p[f"x{d}"][HIDDEN : 2 * HIDDEN] += 1  # remember by default
        p[f"h{d}"] = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN))
        p[f"o{d}"] = rng.normal(0, 0.3, (LABELS, HIDDEN))
    p["bias"], p["moves"] = np.zeros((LABELS, 1)), np.zeros((LABELS, LABELS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, unit, window) of one direction over classes (time, window); keep gathers what the gradient needs."""
    steps, n = x.shape
    h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
    out = np.empty((steps, HIDDEN, n), np.float32)
    z, r = np.empty((4 * HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32)
    i, f, o, g = (slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(4))
    # gates are clip(z / 4 + 1 / 2, 0, 1), the candidate is clip(z, -1, 1)
    scale = np.repeat(np.float32([0.25, 0.25, 0.25, 1]), HIDDEN)[:, None]
    shift = np.repeat(np.float32([0.5, 0.5, 0.5, 0]), HIDDEN)[:, None]
    wx, wh = np.ascontiguousarray(wx * scale + shift), wh * scale
    gates, low = slice(0, 3 * HIDDEN), np.float32(-1)
    for t in range(steps):
        np.take(wx, x[t], axis=1, out=z, mode="clip")
        np.matmul(wh, h, out=r)
        z += r
        np.clip(z[gates], 0, 1, out=z[gates])
        np.clip(z[g], low, 1, out=z[g])
        before = c
        c = z[f] * c
        c += z[i] * z[g]
        h = out[t]
        np.clip(c, low, 1, out=h)
        if keep is not None:
            keep.append((z.copy(), before, c, h.copy()))
        h *= z[o]
    return out


def emissions(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Scores (time, label, window)."""
    e = np.matmul(p["of"], _run(x, p["xf"], p["hf"]))
    e += np.matmul(p["ob"], _run(x[::-1], p["xb"], p["hb"]))[::-1]
    e += p["bias"]
    return e


def viterbi(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (time, window)."""
    steps, k, n = e.shape
    best, back = e[0].copy(), np.empty((steps, k, n), np.int8)
    for t in range(1, steps):
        ways = best[:, None, :] + moves[:, :, None]  # from, to, window
        back[t] = ways.argmax(0)
        best = ways.max(0) + e[t]
    out = np.empty((steps, n), np.int8)
    out[-1] = best.argmax(0)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = np.take_along_axis(back[t], out[t][None, :].astype(np.int64), 0)[0]
    return out


def decode(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a label other than O, and the labels (time, window) of those."""
    e = emissions(x, p)
    # a label other than O at m places changes at most 2m moves: beyond this margin everywhere, O wins for certain
    bound = 2 * max(0.0, float((p["moves"] - p["moves"][0, 0]).max()))
    near = np.flatnonzero((e[:, :1] - e[:, 1:]).min((0, 1)) <= bound)
    if not len(near):
        return near, np.empty((len(x), 0), np.int8)
    labels = viterbi(np.ascontiguousarray(e[:, :, near]), p["moves"])
    some = labels.any(0)
    return near[some], labels[:, some]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def _gradients(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of labels y (time, window) and its gradients, by forward-backward and back-propagation."""
    steps, n = x.shape
    kept = {"f": [], "b": []}
    states = {"f": _run(x, p["xf"], p["hf"], kept["f"]), "b": _run(x[::-1], p["xb"], p["hb"], kept["b"])}
    e = np.matmul(p["of"], states["f"]) + np.matmul(p["ob"], states["b"])[::-1] + p["bias"]
    moves = p["moves"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, None] + moves[:, :, None], 0) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(moves[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    total = _log_sum(alpha[-1], 0)
    d = np.exp(alpha + beta - total)
    pairs = np.zeros_like(moves)
    for t in range(1, steps):
        pairs += np.exp(alpha[t - 1][:, None] + moves[:, :, None] + (e[t] + beta[t] - total)[None]).sum(2)
    one = np.eye(LABELS, dtype=np.float32)[:, y].transpose(1, 0, 2)
    told = (e * one).sum() + moves[y[:-1], y[1:]].sum()
    loss = float(total.sum() - told) / n
    d = (d - one) / n
    np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
    out = {"moves": pairs / n, "bias": d.sum((0, 2))[:, None]}
    i, f, o, g = (slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(4))
    for name, xs, de in (("f", x, d), ("b", x[::-1], d[::-1])):
        hs, w, wh = states[name], p[f"o{name}"], p[f"h{name}"]
        out[f"o{name}"] = np.einsum("tkn,thn->kh", de, hs)
        dx, dwh = np.zeros_like(p[f"x{name}"]), np.zeros_like(wh)
        dh, dc = np.zeros_like(hs[0]), np.zeros_like(hs[0])
        for t in range(steps - 1, -1, -1):
            z, before, c, squashed = kept[name][t]
            dh = dh + w.T @ de[t]
            dc = dc + dh * z[o] * (np.abs(c) < 1)
            dz = np.concatenate([dc * z[g], dc * before, dh * squashed, dc * z[i]])
            dz[: 3 * HIDDEN] *= 0.25 * ((z[: 3 * HIDDEN] > 0) & (z[: 3 * HIDDEN] < 1))
            dz[g] *= np.abs(z[g]) < 1
            dc = dc * z[f]
            if t:
                dwh += dz @ hs[t - 1].T
            np.add.at(dx.T, xs[t], dz.T)
            dh = wh.T @ dz
        out[f"x{name}"], out[f"h{name}"] = dx, dwh
    return loss, out


def train(windows: list[tuple[np.ndarray, np.ndarray]], seed: int = 13, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights fitted by Adam to windows of (classes, labels), each TRAIN_WIDTH long."""
    rng = np.random.default_rng(seed)
    p = _fresh(rng)
    x, y = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows])
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        some = rng.integers(0, len(x), BATCH)
        _, grad = _gradients(np.ascontiguousarray(x[some].T), np.ascontiguousarray(y[some].T), p)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.03 * min(1, step / 20) * (0.1 ** (step / rounds))
        for k, g in grad.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def examples(text: str, spans: list[Span], seed: int, most: int = SAMPLE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Windows of a text with their spans: around spans, the same ones written otherwise, and one without any."""
    rng = np.random.default_rng(seed)
    out = []
    for kind, start, end in spans[: most - 1]:
        if end - start > TRAIN_WIDTH - 8:
            continue
        a = max(0, start - int(rng.integers(0, TRAIN_WIDTH - (end - start))))
        piece = text[a : a + TRAIN_WIDTH]
        inside = [(k, s - a, e - a) for k, s, e in spans if s >= a and e <= a + TRAIN_WIDTH]
        if any(s < a < e or s < a + TRAIN_WIDTH < e for _, s, e in spans):
            continue
        out.append((piece, inside))
        if len(inside) == 1 and kind in (0, 3):
            own = text[start:end]
            if kind == 3:
                other = ("00" if rng.random() < 0.3 else "") + own.lstrip("+")
                other = other.replace(" ", str(rng.choice(["-", ".", " ", "/"])))
            else:
                at = int(rng.integers(0, max(1, own.index("@"))))
                other = own[:at] + str(rng.choice(list("éüñß"))) + own[at + 1 :]
            left = inside[0][1]
            again = (piece[:left] + other + piece[inside[0][2] :])[:TRAIN_WIDTH]
            if left + len(other) <= TRAIN_WIDTH:
                out.append((again, [(kind, left, left + len(other))]))
    if len(text) > 2 * TRAIN_WIDTH:
        a = int(rng.integers(0, len(text) - TRAIN_WIDTH))
        if not any(s < a + TRAIN_WIDTH and e > a for _, s, e in spans):
            out.append((text[a : a + TRAIN_WIDTH], []))
    return out


def labelled(piece: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and labels of a training window, padded to TRAIN_WIDTH."""
    x, y = np.zeros(TRAIN_WIDTH, np.intp), np.zeros(TRAIN_WIDTH, np.intp)
    own = classes_of(piece)[:TRAIN_WIDTH]
    x[: len(own)] = own
    for kind, start, end in spans:
        y[start:end] = kind + 1
    return x, y


_EXAMPLE = "rank long, piece string, kinds array<int>, starts array<int>, ends array<int>"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            spans = sorted(base_spans(text), key=lambda s: s[1])
            if spans:
                rank = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=7).digest(), "big")
                for piece, inside in examples(text, spans, rank % 2**32):
                    rows.append({"rank": rank, "piece": piece, "kinds": [s[0] for s in inside], "starts": [s[1] for s in inside], "ends": [s[2] for s in inside]})
        whole = pa.list_(pa.int32())
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("rank", pa.int64()), ("piece", pa.string()), ("kinds", whole), ("starts", whole), ("ends", whole)]))


def fit(docs: DataFrame, most: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """A tagger trained on windows of at most `most` documents with spans, those whose texts' hashes are least; None if there are none.

    A text gives 2 * SAMPLE_WINDOWS windows at most. A count of texts with spans first sets a bound on the hash that about 3 * most of
    them keep, so that tasks send a bounded number of short windows to the driver, however many tasks there are.
    """
    found = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_sampled, _EXAMPLE)
    texts = found.agg(F.approx_count_distinct("rank")).first()[0]
    bound = 2**56 if texts <= 3 * most else 2**56 * 3 * most // texts
    rows = found.where(F.col("rank") < bound).distinct().orderBy("rank", "piece").limit(most * SAMPLE_WINDOWS).collect()
    if not rows:
        return None
    return train([labelled(r.piece, list(zip(r.kinds, r.starts, r.ends, strict=True))) for r in rows])


# --- spans of whole texts -------------------------------------------------------------------------------------------


def _windows(n: int) -> Iterator[tuple[int, int]]:
    """Start and length of the windows that cover n characters."""
    start = 0
    while True:
        yield start, min(WINDOW, n - start)
        if start + WINDOW >= n:
            return
        start += WINDOW - OVERLAP


def tagged(texts: list[str], p: dict[str, np.ndarray], wide: int = 2048) -> list[list[Span]]:
    """Labelled runs of each text, in order: windows of equal (rounded) length are decoded together, then reconciled."""
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    coded = []
    for d, text in enumerate(texts):
        coded.append(classes_of(text))
        if text:
            for start, n in _windows(len(text)):
                by_length.setdefault(-(-n // STEP) * STEP, []).append((d, start, n))
    found: list[dict[int, np.ndarray]] = [{} for _ in texts]
    for length, windows in by_length.items():
        for k in range(0, len(windows), wide):
            some = windows[k : k + wide]
            x = np.zeros((len(some), length), np.intp)
            for row, (d, start, n) in enumerate(some):
                x[row, :n] = coded[d][start : start + n]
            hit, labels = decode(np.ascontiguousarray(x.T), p)
            for j, w in enumerate(hit):
                d, start, n = some[w]
                found[d][start] = labels[:n, j]
    return [_reconciled(len(text), own) for text, own in zip(texts, found, strict=True)]


def _reconciled(n: int, windows: dict[int, np.ndarray]) -> list[Span]:
    """Runs over a text: of an overlap each half goes with the window that reaches farther beyond it."""
    out: list[Span] = []
    for start in sorted(windows):
        labels = windows[start]
        lo = OVERLAP // 2 if start else 0
        hi = len(labels) if start + len(labels) >= n else len(labels) - OVERLAP // 2
        edges = np.flatnonzero(np.diff(np.concatenate([[0], labels[lo:hi], [0]])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            kind = int(labels[lo + a]) - 1
            if kind >= 0:
                s, e = start + lo + int(a), start + lo + int(b)
                if out and out[-1][0] == kind and out[-1][2] == s:
                    out[-1] = (kind, out[-1][1], e)
                else:
                    out.append((kind, s, e))
    return out


def _plausible(kind: int, own: str) -> bool:
    digits = _digits(own)
    if kind == 0:
        left, at, right = own.partition("@")
        return bool(at and left.strip() and "." in right.strip(".") and not re.search(r"\s|@", right) and not re.search(r"\s", left))
    if kind == 1:
        parts = _DIGITS.findall(own)
        return len(parts) == 4 and all(len(q) <= 3 and int(q) <= 255 for q in parts) and len(own) == sum(map(len, parts)) + 3
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(own) and not re.search(r"[^\W\d_]|\d{9}", own)


def added_spans(text: str, runs: list[Span], base: list[Span]) -> list[Span]:
    """The runs that are spans of their own: trimmed, plausible, free-standing and clear of the patterns' spans.

    Only an email may hold one that the patterns saw a part of, as where its local part has letters with accents.
    """
    out = []
    taken = sorted((s, e, k) for k, s, e in base)
    at = 0
    for kind, start, end in runs:
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        over = [(s, e, k) for s, e, k in taken[at : at + 8] if s < end and e > start]
        if over and not (kind == 0 and len(over) == 1 and over[0][2] == 0 and start < over[0][0] and over[0][1] <= end):
            continue
        free = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
        if end > start and free and _plausible(kind, text[start:end]):
            out.append((kind, start, end))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_spans(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """For each row its id, base counts and digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            runs = tagged(texts, model) if model else [[] for _ in texts]
            more = [added_spans(*row) for row in zip(texts, runs, base, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(written(own).encode()).hexdigest() for own in base]
            spans = [written(b + m) for b, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _FOUND)


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its personal data."""
    docs = documents(spark, sf_dir)
    return personal_spans(docs, fit(docs))
