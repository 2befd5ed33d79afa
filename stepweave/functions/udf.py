"""Spark wrappers of the pure-Python kernels: Arrow UDFs, and a batched decoder of command lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.functions import shell, text


def _once(rows: pa.Array, made: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """made() of every text, called once for each that differs; rows come and go as Arrow arrays, without a Python object for each."""
    coded = pc.dictionary_encode(rows)
    return pa.array([made(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)


def template(tokens: Column) -> Column:
    """template() of each row's tokens; equal tokens are looked at once in an Arrow batch."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return _once(rows, lambda t: text.template(json.loads(t)), pa.string())

    return run(F.to_json(tokens))


def normalise_path(raw: Column, project: Column, home: str) -> Column:
    return F.udf(lambda r, p: None if r is None or p is None else text.normalise_path(r, p, home), T.StringType(), useArrow=True)(raw, project)


def normalise_paths(files: Column, project: Column, home: str) -> Column:
    """normalise_path() of every file of an array, one call for each Arrow batch; equal arrays are looked at once."""

    def all_of(told: str) -> list[str]:
        row = json.loads(told)
        return [text.normalise_path(raw, row["p"], home) for raw in row["f"] if raw is not None]

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        return _once(rows, all_of, pa.list_(pa.string()))

    return run(F.to_json(F.struct(F.coalesce(files, F.array().cast("array<string>")).alias("f"), F.coalesce(project, F.lit("")).alias("p"))))


def is_path(token: Column) -> Column:
    """looks_like_path() in built-in functions; the shape is the same text, read by Java with Unicode's word characters."""
    numeric = F.replace(token, F.lit("."), F.lit("")).rlike("(?U)^\\d+$")
    return (F.length(token) >= 3) & ~numeric & ~token.startswith("-") & (token != "/dev/null") & token.rlike(f"(?Ud){shell.PATH_SHAPE}")


def activities(line: Column) -> Column:
    """The activities of each command line as an array of ordinal, activity_class, program, tokens and files; null of null."""
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("activity_class", pa.string()), ("program", pa.string()), ("tokens", pa.list_(pa.string())), ("files", pa.list_(pa.string()))]))

    def all_of(told: str) -> list[dict]:
        return [{"ordinal": n, "activity_class": a.activity_class, "program": a.program, "tokens": list(a.tokens), "files": list(a.files)} for n, a in enumerate(shell.activities(told))]

    @F.arrow_udf("array<struct<ordinal:int,activity_class:string,program:string,tokens:array<string>,files:array<string>>>")
    def run(rows: pa.Array) -> pa.Array:
        return _once(rows, all_of, kind)

    return run(line)


def decompose(commands: DataFrame, line: str = "line") -> DataFrame:
    """Adds ordinal, activity_class, program, tokens and files: a row for each activity of each row's command line."""
    kept = commands.schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [c or "" for c in batch.column(line).to_pylist()]
            told = {c: shell.activities(c) for c in set(lines)}
            found = [(i, n, a) for i, c in enumerate(lines) for n, a in enumerate(told[c])]
            index = pa.array([f[0] for f in found], pa.int64())
            made = [
                pa.array([f[1] for f in found], pa.int32()), pa.array([f[2].activity_class for f in found], pa.string()), pa.array([f[2].program for f in found], pa.string()),
                pa.array([list(f[2].tokens) for f in found], pa.list_(pa.string())), pa.array([list(f[2].files) for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(index) for f in kept], *made], [*[f.name for f in kept], "ordinal", "activity_class", "program", "tokens", "files"])

    return commands.mapInArrow(run, f"{ddl}, ordinal int, activity_class string, program string, tokens array<string>, files array<string>")
