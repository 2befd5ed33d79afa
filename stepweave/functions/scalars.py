"""Scalar expressions: outcomes, credentials, keys and text cuts, all in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepweave.schema import RESULT_CHARS

# Outcome rules, first match decides. Word edges are spelled out so that every regex engine agrees.
OUTCOME_RULES = (
    (r"(?:^|[^A-Za-z0-9_])[1-9][0-9]* (?:failed|error)", "failure"),
    (r"(?:^|[^A-Za-z0-9_])[0-9]+ passed", "success"),
    (r"(?:^|[^A-Za-z0-9_])All checks passed", "success"),
    (r"(?m)^\[[^ \t\n]+ (?:\(root-commit\) )?[0-9a-f]{7,40}\]", "success"),
)
# Credential shapes by name, first match names a text.
CREDENTIALS = (
    ("aws_access_key_id", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("openai_api_key", r"sk-[A-Za-z0-9]{20,}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]+"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer_token", r"Bearer[ \t\n\r]+[A-Za-z0-9._~+/-]{16,}"),
    ("secret_assignment", r"(?i)(?:^|[^A-Za-z0-9_])(?:api_?key|token|secret|password)[ \t\n\r]*[=:][ \t\n\r]*[^ \t\n\r]{8,}"),
    ("base64_run", r"[A-Za-z0-9+/]{40,}={0,2}"),
)


def first_match(text: Column, rules) -> Column:
    """The name of the first (pattern, name) that the text holds."""
    out = None
    for pattern, name in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def outcome(result: Column, is_error: Column | None = None) -> Column:
    told = F.coalesce(first_match(result, OUTCOME_RULES), F.lit("neutral"))
    return told if is_error is None else F.when(is_error, "failure").otherwise(told)


#: Texts of which every match of a credential shape holds one; looking for them is cheaper than the pattern.
LITERALS = {
    "aws_access_key_id": ("AKIA",), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "openai_api_key": ("sk-",), "slack_token": ("xox",), "private_key": ("-----BEGIN ",), "bearer_token": ("Bearer",),
    "secret_assignment": ("=", ":"),
}
#: Where a long run begins, so that no run is tried again from each of its signs.
RUN_STARTS = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"


def credential(text: Column) -> Column:
    """The first credential shape that a text holds; a pattern is tried only where a text of it stands or a long run begins."""
    out = None
    for name, pattern in CREDENTIALS:
        there = reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in LITERALS[name]]) if name in LITERALS else text.rlike(RUN_STARTS) if name == "base64_run" else F.lit(True)
        hit = there & text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def project_key(folder: Column) -> Column:
    """The first 16 hex digits of sha256 of a normalised folder."""
    return F.substring(F.sha2(folder, 256), 1, 16)


def cut(result: Column) -> Column:
    return F.substring(result, 1, RESULT_CHARS)


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted keys, no white space and only ASCII signs; what is no JSON stays as it is. 1.0 and 1 are one number."""
    plain = F.coalesce(F.to_json(F.try_parse_json(text)), text, F.lit(""))
    point = F.ascii
    escape = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    over = lambda c: point(c) - 0x10000
    pair = lambda c: F.concat(escape(F.lit(0xD800) + F.shiftright(over(c), 10)), escape(F.lit(0xDC00) + over(c).bitwiseAND(0x3FF)))
    signs = F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0))
    ascii_only = F.array_join(F.transform(signs, lambda c: F.when(point(c) < 128, c).when(point(c) < 0x10000, escape(point(c))).otherwise(pair(c))), "")
    return F.when(plain.rlike("[^\\x00-\\x7F]"), ascii_only).otherwise(plain)


def dedup_key(tool_call_id: Column, ordinal: Column, *fallback: Column) -> Column:
    """Call id and ordinal, or where there is no id a digest of the other parts; the ordinal within the action has to be one of them."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in fallback]
    made = F.concat(F.lit("syn-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))
    return F.when(F.coalesce(F.length(tool_call_id), F.lit(0)) > 0, F.concat(tool_call_id, F.lit("#"), ordinal)).otherwise(made)


def event_key(epoch: Column) -> Column:
    """The dedup key of an activity, of its event's columns and its ordinal."""
    names = ("conversation_id", "prompt_id", "agent_id", "ordinal", "tool_name")
    conversation, *others = (F.col(n) for n in names)
    return dedup_key(F.col("tool_call_id"), F.col("ordinal"), conversation, epoch, *others, canonical_json(F.col("tool_call_arguments")))


def excluded(folder: Column, globs: list[str]) -> Column:
    """Whether a normalised folder matches a glob of a deny list; blank lines and # comments do not count."""
    import re
    from fnmatch import translate

    rules = [translate(g.strip()).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") for g in globs if g.strip() and not g.strip().startswith("#")]
    return folder.rlike("(?s)^(?:" + "|".join(rules) + ")$") if rules and all(re.compile(r) for r in rules) else F.lit(False)


def line_of(document: Column, wanted: Column) -> Column:
    """The line, from 1, of a text that a document holds exactly once; else null."""
    first = F.instr(document, wanted)
    again = F.instr(F.substr(document, first + 1), wanted)
    head = F.substr(document, F.lit(1), first - 1)
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1
    return F.when((F.length(F.btrim(wanted)) > 0) & (first > 0) & (again == 0), lines)
