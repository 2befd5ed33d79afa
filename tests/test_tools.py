import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from stepweave import config
from stepweave.functions import symbols
from stepweave.plans import sequences, tools
from stepweave.sources import packs


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 4, "enforce": "yes"}))
    found, origin = config.load(str(tmp_path / "c.json"), {"STEPWEAVE_LEVEL": "class"})
    assert (found.level, found.k, found.h, found.enforce) == ("class", 4, 1, True)
    assert (origin["level"], origin["k"], origin["h"]) == ("env", "file", "default")
    with pytest.raises(ValueError):
        config.load(environment={"STEPWEAVE_LEVEL": "x"})
    with pytest.raises(ValueError):
        config.load(environment={"STEPWEAVE_ENFORCE": "perhaps"})


def test_python_symbols():
    text = "import os\nfrom a.b import c\n\nclass A:\n    def f(self):\n        return 1\n\n\nasync def g():\n    pass\n"
    found, imports = symbols.parse(text, "py")
    assert found == [("A", 4, 6), ("A.f", 5, 6), ("g", 9, 10)] and imports == ["os", "a.b"]
    assert symbols.parse("def (", "py") == ([], []) and symbols.parse("x", "unknown") == ([], [])


def test_other_symbols():
    found, imports = symbols.parse("import x from 'y'\nexport function f() {\n  return 1\n}\nclass B {\n}\n", "js")
    assert found == [("f", 2, 4), ("B", 5, 6)] and imports == ["y"]
    assert symbols.parse("func (a *T) Run() {\n}\ntype T struct {\n}\n", "go")[0] == [("Run", 1, 2), ("T", 3, 4)]


def test_closest():
    assert symbols.closest("Read -> Edit", ["Read -> Edits", "Start -> Read", "Read -> Test"])[0] == "Read -> Edits"


def test_edits_go_to_the_narrowest_symbol(spark):
    sources = spark.createDataFrame([("a.py", "py", "class A:\n    def f(self):\n        x = 1\n\nz = 2\n")], "file string, extension string, text string")
    edits = spark.createDataFrame([(1, "a.py", 3), (2, "a.py", 1), (3, "a.py", 5), (4, "b.py", 1)], "edit_id long, file string, line int")
    got = {r.edit_id: r.symbol for r in tools.attribute_edits(edits, tools.symbols_of(sources)).collect()}
    assert got == {1: "A.f", 2: "A", 3: None, 4: None}


def test_packs(spark, tmp_path):
    good = {"version": 1, "harness": "h", "tools": {"Look": {"class": "Inspection"}, "Run": {"class": None, "decompose": "shell"}}}
    (tmp_path / "v.json").write_text(json.dumps(good))
    tool = packs.vocabulary(spark, str(tmp_path / "v.json"))
    events = spark.createDataFrame([("Look",), ("Run",), ("Odd",)], "tool_name string")
    assert {r.tool_name: r.activity_class for r in packs.classify_tools(events, tool.drop("decompose")).collect()} == {"Look": "Inspection", "Run": None, "Odd": "Unknown"}
    good["tools"]["Bad"] = {"program": "x"}
    (tmp_path / "v2.json").write_text(json.dumps(good))
    with pytest.raises(packs.PackError):
        packs.vocabulary(spark, str(tmp_path / "v2.json"))
    pack = {"version": 1, "concepts": [{"label": "a", "definition": "x"}, {"label": "b", "definition": "y", "parent": "a"}, {"label": "c", "definition": "z", "parent": "b"}], "relations": []}
    (tmp_path / "c.json").write_text(json.dumps(pack))
    own, _ = packs.concepts(spark, str(tmp_path / "c.json"), ("a",))
    assert {(r.label, r.ancestor, r.distance) for r in packs.ancestors(own).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    for broken in ({"label": "a", "definition": "again"}, {"label": "d", "definition": "w", "parent": "nowhere"}):
        (tmp_path / "c2.json").write_text(json.dumps(pack | {"concepts": [*pack["concepts"], broken]}))
        with pytest.raises(packs.PackError):
            packs.concepts(spark, str(tmp_path / "c2.json"))


def test_tool_arguments(spark):
    df = spark.createDataFrame([('{"path": "b", "file_path": "a", "x": 1}',), ('{"path": "b"}',), ("{}",)], "args string")
    got = df.select(packs.tool_path(F.col("args")).alias("p"), packs.tool_tokens(F.lit("Read"), F.col("args")).alias("t")).collect()
    assert [r.p for r in got] == ["a", "b", None] and got[0].t == ["Read", "file_path", "path", "x"] and got[2].t == ["Read"]


def test_narrowest_symbol_like_brute_force(spark):
    """Spans that nest, cross, repeat or are turned round, and lines on their borders."""
    rng = random.Random(5)
    spans = [(f"f{rng.randrange(3)}", f"s{rng.randrange(40)}", b, b + rng.choice((0, 1, 2, 3, 7, 8, 40, 333))) for b in (rng.randrange(0, 400) for _ in range(300))]
    spans += [("f0", "turned", 9, 3), ("f1", "whole", 0, 2**31 - 2), *spans[:20]]
    edits = [(n, f"f{rng.randrange(4)}", rng.randrange(0, 900)) for n in range(500)] + [(500, None, 1), (501, "f1", 2**31 - 3)]
    found = spark.createDataFrame(spans, "file string, symbol string, begins int, ends int")
    got = {r.edit_id: (r.symbol, r.symbol_begins) for r in tools.attribute_edits(spark.createDataFrame(edits, "edit_id long, file string, line int"), found).collect()}
    for n, file, line in edits:
        held = [(e - b, b, s) for f, s, b, e in spans if f == file and b <= line <= e]
        assert got[n] == ((min(held)[2], min(held)[1]) if held else (None, None)), (n, file, line)
    none = tools.attribute_edits(spark.createDataFrame(edits, "edit_id long, file string, line int"), found.limit(0)).collect()
    assert len(none) == len(edits) and all(r.symbol is None for r in none)


def test_enclosing_symbols_do_not_multiply_rows(spark):
    """Lines inside a thousand nested symbols ask one block a level."""
    found = spark.range(1000).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("symbol"), F.col("id").cast("int").alias("begins"), (2999 - F.col("id")).cast("int").alias("ends"))
    edits = spark.range(1000).select(F.col("id").alias("edit_id"), F.lit("f").alias("file"), (F.col("id") + 1000).cast("int").alias("line"))
    assert {r.symbol for r in tools.attribute_edits(edits, found).collect()} == {"999"}
    blocks = found.select(F.explode(tools._blocks("begins", "ends"))).count()
    assert blocks <= 1000 * 2 * 12


def test_touch_chains_join_runs_over_portions(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for file, touches in (("hot", 900), ("one", 300), ("few", 5), ("least", 2)):
        for i in range(touches):
            n += 1
            node = "A" if file == "one" else rng.choice("AAAAAAAAAAAAAAB") if file == "hot" else rng.choice("AB")
            rows.append((n, [file], i // 3, node))
    df = spark.createDataFrame(rows, "step_id long, files array<string>, s long, activity_class string").withColumn("occurred_at", F.timestamp_seconds("s"))
    for portion in (1, 4, 50, 65_536):
        got = {r.file: (r.touches, r.chain) for r in sequences.touch_chains(df, files=3, kept=6, portion=portion).collect()}
        wanted = {}
        for file in ("hot", "one", "few"):
            nodes = [r[3] for r in rows if r[1] == [file]]
            runs = [(k, len(list(g))) for k, g in itertools.groupby(nodes)][:6]
            wanted[file] = (len(nodes), " > ".join(f"{k} x{m}" if m > 1 else k for k, m in runs))
        assert got == wanted, portion
    assert sequences.touch_chains(df.limit(0)).collect() == []
