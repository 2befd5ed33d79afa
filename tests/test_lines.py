import json
import random

import pytest
from pyspark.sql import functions as F

from stepweave.sources import lines, transcript


def as_text(folder):
    """(name, ordinal, line) as reading each file whole gives them."""
    return sorted((p.name, n, line) for p in folder.rglob("*.jsonl") for n, line in enumerate(p.read_text().split("\n")) if line.strip(" "))


def of(df):
    return sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.line) for r in df.collect())


@pytest.mark.parametrize("split", [1, 7, 64, 5000, 1 << 20])
def test_ranges_give_what_whole_files_give(spark, tmp_path, split):
    rng = random.Random(split)
    (tmp_path / "a" / "b").mkdir(parents=True)
    texts = {"one.jsonl": "x", "two.jsonl": "x\n", "none.jsonl": "", "blank.jsonl": "\n\n \ny\n\n", "long.jsonl": "q" * 300 + "\n" + "é" * 40 + "\n\r\n", "a/deep.jsonl": "d\ne", "a/b/more.jsonl": "\n".join("w" * rng.randint(0, 9) for _ in range(50)), "other.txt": "no\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    if split == 1:
        for name in ("long.jsonl", "a/b/more.jsonl"):
            (tmp_path / name).unlink()
    wanted = sorted((n.rsplit("/", 1)[-1], i, line) for n, t in texts.items() if n.endswith(".jsonl") and (tmp_path / n).exists() for i, line in enumerate(t.split("\n")) if line.strip(" "))
    assert of(lines.records(spark, str(tmp_path), split=split)) == wanted


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"n": n, "pad": "p" * (n % 97)}) + "\n" for n in range(4000)))
    found = lines.records(spark, f"file://{tmp_path}/big.jsonl", split=20_000)
    assert of(found) == as_text(tmp_path)
    spread = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 5 and max(r["count"] for r in spread) < 1000
    same = transcript.records(spark, f"file://{tmp_path}/big.jsonl").select("ordinal", "line")
    assert sorted(map(tuple, found.select("ordinal", "line").collect())) == sorted(map(tuple, same.collect()))


def test_bytes_that_are_no_text_and_missing_folders(spark, tmp_path):
    (tmp_path / "odd.jsonl").write_bytes(b"a\xffb\nc\n")
    assert [line for _, _, line in of(lines.records(spark, str(tmp_path)))] == ["a�b", "c"]
    (tmp_path / "empty").mkdir()
    assert of(lines.records(spark, str(tmp_path / "empty"))) == []
    with pytest.raises(Exception, match="nowhere"):
        lines.records(spark, str(tmp_path / "nowhere"))


def test_a_stream_reads_what_was_appended_and_only_whole_lines(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def run():
        found = lines.follow_lines(spark, str(logs), split=16)
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (logs / "a.jsonl").write_text("one\ntwo\nthr")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with open(logs / "a.jsonl", "a") as f:
        f.write("ee\nfour, which is longer than a range\n")
    (logs / "b.jsonl").write_text("five\n")
    whole = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("a.jsonl", 14, "four, which is longer than a range"), ("b.jsonl", 0, "five")]
    assert run() == whole
    assert run() == whole  # nothing new


def test_folders_and_the_deny_list(spark):
    df = spark.createDataFrame([("/work/my.demo",), (None,)], "p string")
    assert [r.f for r in df.select(lines.folder_name(F.col("p")).alias("f")).collect()] == ["-work-my-demo", None]
    rows = [json.dumps({"cwd": c}) for c in ("/work/secret/x", "/work/open", "/other")] + ["torn {", "{}"]
    kept, counted = lines.permitted(spark.createDataFrame([(r,) for r in rows], "line string"), ["# none", "", "/work/secret*", "/other"])
    assert sorted(r.line for r in kept.collect()) == sorted(rows[1:2] + rows[3:]) and [tuple(r) for r in counted.collect()] == [("capture_excluded", 2)]
    assert lines.permitted(spark.createDataFrame([], "line string"), ["x"])[1].first().n == 0


def test_small_ranges_share_tasks():
    pieces = [p for n in range(200) for p in lines._cut(f"f{n:03}", 0, 600_000, 1 << 18)]
    tasks = lines._dealt(iter(pieces), 1 << 18)
    assert [p for t in tasks for p in t.pieces] == pieces and len(tasks) <= lines.TASKS  # of 600 ranges


def test_logs_of_events_are_dealt_out_once(spark, sf):
    from stepweave.plans import logs

    found, _ = logs._transcript(spark, sf)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
