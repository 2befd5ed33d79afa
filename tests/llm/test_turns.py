"""Operator 11 against exhaustive search and a plain rendering of its contract."""

import hashlib
import heapq
import random
import re
import zlib

from stepweave.llm import turns as T

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(roles, must_go, cut):
    """Cheapest cost with its least audit and the repaired roles, by search over all edits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, signs, made = heapq.heappop(heap)
        state = signs[-1:]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and re.fullmatch("(s?(ua)+)?", signs):
            return cost, audit, made
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(heap, (cost + 2, audit + "I", i, signs + due, (*made, (name, None))))
        if i < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, signs, made))
            if not must_go[i]:
                own = roles[i][:1]
                if own and (own == due or (own == "s" and not signs)):
                    heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, signs + own, (*made, (roles[i], i))))
                heapq.heappush(heap, (cost + 2 + cut[i], audit + "R", i + 1, signs + due, (*made, (name, i))))


def plain(rows):
    """The contract, row by row: {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}."""
    text_of = lambda v: " " if v is None else str(v)
    held = {}
    for conv, turn, role, text in rows:
        own = held.setdefault(conv, [])
        fault = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        initials = [r[1][:1] for r in own]
        cost, audit, made = exhaustive([r[1] for r in own], [k in ("blank", "duplicate") for k in kinds], [k == "truncated" for k in kinds])
        lines = "\n".join(f"{name}:{'' if i is None else own[i][2]}" for name, i in made)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def found(spark, df):
    made = T.repair(T.damage(df)).collect()
    keyed = {None if r.conv_id == " " else int(r.conv_id): (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in made}
    assert len(keyed) == len(made)
    return keyed


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    made = {r.conv_id: tuple(r)[1:] for r in T.op11_turns(spark, sf).collect()}
    assert made == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, 2, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, "assistant", " \t\n"), (2, 5, "", "x."), (2, 5, "unknown", "x."), (2, 6, "System", "x"), (3, 2**40, "system", "é" * 70_000 + "?"), (4, 7, "user", None)]
    rows += [(5, t, "user", "same text.") for t in range(40)] + [(6, t, r, f"{t}") for t, r in enumerate(["system", "system", "user", "assistant"] * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("seg", "copies", "conv", "pattern", "seen"):
        df = df.selectExpr("*", f"'own' AS {name}")
    assert found(spark, df) == plain(rows)
    dropped = [(c, 0, "user", "x.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    gone = found(spark, spark.createDataFrame(dropped, SCHEMA))
    assert gone == plain(dropped) and set(gone.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(spark, spark.createDataFrame([], SCHEMA)) == {}


def test_long_conversations_in_blocks(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["fine.", "cut", "", f"text {t}!"])) for c, n in ((1, 150), (2, T.BLOCK_ROWS + 90), (3, 5), (4, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four partitions cut the conversations
    try:
        assert found(spark, df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", blocks)


def test_blocks_chain_as_one():
    rng = random.Random(5)
    for _ in range(300):
        pattern = "".join(rng.choice("suauauSUAxX-") for _ in range(rng.randint(1, 14)))
        live, cut = {T.START: (0, "")}, rng.randint(1, 5)
        parts = [pattern[i : i + cut] for i in range(0, len(pattern), cut)]
        for number, part in enumerate(parts, 1):
            ways = [(q, (live[p][0] + c, live[p][1] + a)) for (p, q), (c, a) in T.paths(part, tuple(live), number == len(parts)).items()]
            live = {q: min(w for s, w in ways if s == q) for q, _ in ways}
        assert min(live[q] for q in live if q in (T.START, T.ASSISTANT)) == T.whole(pattern)
