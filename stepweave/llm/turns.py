"""Conversation structure repair (operator 11): turns are aligned with strings of the alternating grammar.

The role initials of a whole conversation are `(s?(ua)+)?`. Wagner-Fischer tables align its turns with every feasible
length of such a string at once: they are anchored at the string's end, so that one table holds all lengths. A band
(Ukkonen) bounds how far rows and signs may part at the cost of the incumbent; where nothing is found within it, the
incumbent is doubled. Of the cheapest lengths the least backtraced audit counts.

Rows are sorted over the cluster by conversation and turn, so that a conversation of any length is dealt to many tasks. Short
conversations end where they lie. Of the others (and of those at the edge of a partition) blocks of at most BLOCK_ROWS
rows travel on: costs from each state of the grammar to each other are chained forward, then the cheapest path is read
backward, both as sorted streams of blocks with a state of four numbers.

Nulls in any column are one space. Rows of one turn follow each other by role, then text; equal rows are one row and
its duplicates. A role without a first character can be given a role or deleted, not kept. A text of white space alone, '' too, is
blank. A conversation that loses all rows has zeros and an empty audit. Empty in, empty out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import checkpoint, small_batches, table

#: Rows and bytes of the longest block that one table aligns.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000
#: States of the grammar: nothing yet, after s, after u, after a; and the sign that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ROLE = {"u": "user", "a": "assistant"}
_FAR = 1 << 28
_LAST_SIGN = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z")
_LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_BLOCKS = ", seg long, pattern string, roles array<string>, texts array<string>, blanks long, doubles long, cuts long, bad long, turns long, first_turn long, last_turn long, first_sign string, last_sign string"


def damage(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): rows of `conversations`, damaged by crc32 of `conv_id:turn` modulo 20; nulls are one space.

    A dropped row stays with no copies, so that its conversation is known.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))), F.lit(20))
    gone = F.col("fault") == 0
    text = F.when(gone | (F.col("fault") == 1), "").when(F.col("fault") == 2, F.translate("own", ".!?", "")).otherwise(F.col("own"))
    rows = turns.select(as_text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("was"), as_text("text").alias("own"), fault.alias("fault"))
    return rows.select(
        "conv", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("fault") == 4, "user").otherwise(F.col("was")).alias("role"), text.alias("text"),
        F.when(gone, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _tables(pattern: str, last: str, final: bool, most: int) -> np.ndarray:
    """B[i, m]: least cost of giving rows i.. the last m signs of a string that ends with `last`, within the band of cost `most`.

    Inserts stand before a row; after the last one only if the block ends the conversation.
    """
    n = len(pattern)
    more, less = most // 2, most // 3
    width = n + more + 1
    b = np.full((n + 1, width), _FAR, np.int32)
    b[n, 0] = 0
    if final:
        b[n, : more + 1] = 2 * np.arange(more + 1)
    other = "a" if last == "u" else "u"
    steps = 2 * np.arange(width, dtype=np.int32)
    for i in range(n - 1, -1, -1):
        left = n - i
        lo, hi = max(0, left - less), min(width, left + more + 1)
        row, below, sign = b[i], b[i + 1], pattern[i]
        best = below[lo:hi] + 3
        if sign != "-":
            low, extra = sign.lower(), int(sign.isupper())
            a = max(lo, 1)
            paid = below[a - 1 : hi - 1] + extra
            odd = (a + 1) % 2  # index of the first m with m odd, that is of sign `last`
            paid[odd::2] += 0 if low == last else 2
            paid[1 - odd :: 2] += 0 if low == other else 2
            best[a - lo :] = np.minimum(best[a - lo :], paid)
        row[lo:hi] = np.minimum.accumulate(best - steps[lo:hi]) + steps[lo:hi]
    return b


def _trace(b: np.ndarray, pattern: str, i: int, m: int, last: str, final: bool) -> str:
    """The ASCII-least audit of B[i, m]: D before I before K or R."""
    out, n = [], len(pattern)
    while i < n or m:
        now = b[i, m]
        if i < n and b[i + 1, m] + 3 == now:
            out.append("D")
            i += 1
        elif m and (i < n or final) and b[i, m - 1] + 2 == now:
            out.append("I")
            m -= 1
        else:
            sign = last if m % 2 else ("a" if last == "u" else "u")
            out.append("K" if pattern[i].lower() == sign else "R")
            i, m = i + 1, m - 1
    return "".join(out)


def _incumbent(pattern: str) -> int:
    """A cost that a plain repair reaches: every row takes the role that is due, the last one is answered."""
    due, cost = "u", 2
    for sign in pattern:
        if sign == "-":
            cost += 3
        else:
            cost += (0 if sign.lower() == due else 2) + sign.isupper()
            due = "a" if due == "u" else "u"
    return cost


def paths(pattern: str, entries: tuple[int, ...], final: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest cost and its least audit from each entry state to each exit state that a block can reach.

    pattern: a sign for each row: its role's initial (x: another), a capital if it is truncated, - if it has to go.
    """
    n, out = len(pattern), {}
    wanted = [(p, q) for p in entries for q in ((START, ASSISTANT) if final else (START, SYSTEM, USER, ASSISTANT)) if q >= p or (p, q) == (ASSISTANT, USER)]
    most = _incumbent(pattern)
    while wanted:
        made: dict[str, np.ndarray] = {}
        limit = 5 * n + 12
        for p, q in wanted:
            last = "u" if q == USER else "a"
            if last not in made:
                made[last] = _tables(pattern, last, final, most)
            b = made[last]
            options = []  # cost, rows before a kept s (-1: none), signs
            if p == q:
                options.append((int(b[0, 0]), -1, 0))
            if q in (USER, ASSISTANT):
                first = 1 if (_NEXT[p] == last) else 2
                lengths = np.arange(first, b.shape[1], 2)
                if len(lengths):
                    costs = b[0, lengths]
                    low = int(costs.min())
                    options += [(low, -1, int(m)) for m in lengths[costs == low]]
            if p == START and q != START:
                for t, sign in enumerate(pattern):
                    if 3 * t > most:
                        break
                    if sign in "sS":
                        lengths = np.arange(1 if last == "u" else 2, b.shape[1], 2) if q != SYSTEM else np.array([0])
                        if len(lengths):
                            costs = b[t + 1, lengths]
                            low = int(costs.min())
                            options += [(low + 3 * t + (sign == "S"), t, int(m)) for m in lengths[costs == low]]
            low = min((o[0] for o in options), default=_FAR)
            if low <= most or (most >= limit and low < _FAR // 2):
                audits = (("D" * t + "K" if t >= 0 else "") + _trace(b, pattern, t + 1 if t >= 0 else 0, m, last, final) for cost, t, m in options if cost == low)
                out[p, q] = (low, min(audits))
        if most >= limit:
            break
        wanted = [w for w in wanted if w not in out]
        most = min(2 * most + 2, limit)
    return out


@lru_cache(maxsize=50_000)
def _short(pattern: str) -> tuple[int, str]:
    return min(paths(pattern, (START,), True).values())


def whole(pattern: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _short(pattern) if len(pattern) <= 64 else min(paths(pattern, (START,), True).values())


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """The lines `role:text` that an audit leaves, from a state of the grammar on."""
    at = 0
    for edit in audit:
        sign = _NEXT[state]
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            yield f"{_ROLE[sign]}:"
        else:
            if edit == "K":
                sign = roles[at][:1]
            yield f"{roles[at] if edit == 'K' else _ROLE[sign]}:{texts[at]}"
            at += 1
        state = _AFTER[sign]


class _Block:
    """Rows of one conversation in order, with what they count."""

    def __init__(self, conv: str):
        self.conv, self.signs, self.roles, self.texts = conv, [], [], []
        self.blanks = self.doubles = self.cuts = self.bad = self.turns = self.bytes = 0
        self.first_turn = self.last_turn = self.first_sign = self.last_sign = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        initial, last = role[:1], _LAST_SIGN.search(text)
        if last is None:
            self.blanks += 1
            sign = "-"
        elif seen:
            self.doubles += 1
            sign = "-"
        else:
            sign = initial if initial and initial in "sua" else "x"
            if text[last.start()] not in ".!?":
                self.cuts += 1
                sign = sign.upper()
        if self.signs:
            self.bad += self.last_sign + initial not in _LEGAL
        else:
            self.first_sign = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        self.last_sign = initial
        self.signs.append(sign)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def result(self) -> dict:
        cost, audit = whole("".join(self.signs))
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        lines = "\n".join(repaired(audit, self.roles, self.texts, START))
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.blanks, "duplicate": self.doubles, "truncated": self.cuts, "illegal": self.bad, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}

    def piece(self, seg: int) -> dict:
        return {
            "conv_id": self.conv, "seg": seg, "pattern": "".join(self.signs), "roles": self.roles, "texts": self.texts, "blanks": self.blanks, "doubles": self.doubles, "cuts": self.cuts, "bad": self.bad,
            "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn, "first_sign": self.first_sign, "last_sign": self.last_sign,
        }


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batched(rows: Iterator[dict], schema: pa.Schema, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most 5,000 rows and about `most` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("audit") or "") + sum(map(len, row.get("texts") or ()))
        if len(held) >= 5000 or size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie wholly within a sorted partition are solved; blocks of the others go on."""

    def rows() -> Iterator[dict]:
        block, number, pid, cut = None, 0, TaskContext.get().partitionId(), True
        for batch in batches:
            for conv, turn, role, text, copies, seen in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "seen")), strict=True):
                if block is not None and conv != block.conv:
                    yield block.piece((pid << 32) + number) if cut else block.result()
                    block, cut = _Block(conv), False
                elif block is None:
                    block = _Block(conv)
                for i in range(copies):
                    if len(block.signs) >= BLOCK_ROWS or block.bytes >= BLOCK_BYTES:
                        yield block.piece((pid << 32) + number)
                        block, number, cut = _Block(conv), number + 1, True
                    block.add(turn, role, text, seen or i > 0)
        if block is not None:
            yield block.piece((pid << 32) + number)

    yield from _batched(rows(), _arrow(RESULT + _BLOCKS))


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None]]:
    """Rows with the conversation of the row after them; one row is held back."""
    held = None
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if held is not None:
                yield held, row["conv_id"]
            held = row
    if held is not None:
        yield held, None


_FORWARD = RESULT + _BLOCKS + ", back array<long>, way long"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order: for each state after a block, the state before it on the cheapest path, least audits first."""

    def rows() -> Iterator[dict]:
        live = {START: (0, 0)}
        for row, after in _with_next(batches):
            final = after != row["conv_id"]
            found = paths(row["pattern"], tuple(live), final)
            best: dict[int, tuple] = {}
            for (p, q), (cost, audit) in found.items():
                way = (live[p][0] + cost, live[p][1], audit, p)
                if q not in best or way < best[q]:
                    best[q] = way
            order = sorted(best, key=lambda q: best[q][1:3])
            row["back"] = [best[q][3] if q in best else -1 for q in range(4)]
            row["way"] = min(best, key=lambda q: (best[q][0], order.index(q))) if final else -1
            live = {START: (0, 0)} if final else {q: (best[q][0], order.index(q)) for q in best}
            yield row

    yield from _batched(rows(), _arrow(_FORWARD))


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first: the states before and after each on the chosen path, with its audit and cost."""

    def rows() -> Iterator[dict]:
        q = -1
        for row, _ in _with_next(batches):
            final = row["way"] >= 0
            q = row["way"] if final else q
            p = row["back"][q]
            row["cost"], row["audit"] = paths(row["pattern"], (p,), final)[p, q]
            row["way"] = p
            yield row
            q = p

    yield from _batched(rows(), _arrow(_FORWARD))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order: their counts added, their audits joined, their lines hashed."""

    def rows() -> Iterator[dict]:
        total = None
        for row, after in _with_next(batches):
            if total is None:
                total = {"conv_id": row["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
                audits, digest, empty, sign, first, last, turns = [], hashlib.sha256(), True, None, None, None, 0
            for name, own in (("blank", "blanks"), ("duplicate", "doubles"), ("truncated", "cuts"), ("illegal", "bad"), ("cost", "cost")):
                total[name] += row[own]
            if row["pattern"]:
                total["illegal"] += sign is not None and sign + row["first_sign"] not in _LEGAL
                sign = row["last_sign"]
            if row["first_turn"] is not None:
                turns += row["turns"] - (row["first_turn"] == last)
                first, last = row["first_turn"] if first is None else first, row["last_turn"]
            audits.append(row["audit"])
            for line in repaired(row["audit"], row["roles"], row["texts"], row["way"]):
                digest.update(line.encode() if empty else b"\n" + line.encode())
                empty = False
            if after != row["conv_id"]:
                yield total | {"gaps": 0 if first is None else last - first + 1 - turns, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
                total = None

    yield from _batched(rows(), _arrow(RESULT))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of (conv, turn, role, text, copies): counts of faults, cost, audit and digest of the repair."""
    spark = rows.sparkSession
    small_batches(spark)
    told = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = told.withColumn("sha", F.sha2("text", 256))
    # of texts that come at several turns, the first turn; few conversations have any
    first = F.when(F.count("turn") == F.count("*"), F.min("turn"))
    again = keyed.where("copies > 0").groupBy("conv", "role", "sha").agg(F.count("*").alias("times"), first.alias("first_turn")).where("times > 1")
    seen = F.col("times").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    marked = keyed.join(again, ["conv", "role", "sha"], "left").select("conv", "turn", "role", "text", "copies", seen.alias("seen"))
    order = ("conv", "turn", "role", "text")
    solved = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_solve, RESULT + _BLOCKS)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    solved = checkpoint(solved)
    blocks = solved.where("seg IS NOT NULL").repartition("conv_id")
    ahead = blocks.sortWithinPartitions("conv_id", "seg").mapInArrow(_forward, _FORWARD)
    back = ahead.sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(_backward, _FORWARD)
    ended = back.sortWithinPartitions("conv_id", "seg").mapInArrow(_finish, RESULT)
    return solved.where("seg IS NULL").select(*names).unionByName(ended.select(*names))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `conversations`, damaged as the contract says and repaired."""
    kind = table(spark, sf_dir, "conversations").schema["conv_id"].dataType
    made = repair(damage(table(spark, sf_dir, "conversations")))
    return made.withColumn("conv_id", F.when(F.col("conv_id") != " ", F.col("conv_id")).cast(kind))
