"""Every query with SQL gives the rows that DuckDB gives; the others give a stable schema."""

import math
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from stepweave.functions import shell, text
from stepweave.plans import extra, guidance, logs, studies
from stepweave.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[c]) for c in columns) for r in frame)


@pytest.mark.parametrize("name", sorted(core.ORACLE | extra.ORACLE | logs.ORACLE | guidance.ORACLE | studies.ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    made = (core.QUERIES | extra.QUERIES | logs.QUERIES | guidance.QUERIES | studies.QUERIES)[name](spark, sf)
    result = duck.sql((core.ORACLE | extra.ORACLE | logs.ORACLE | guidance.ORACLE | studies.ORACLE)[name])
    columns = sorted(made.columns)
    assert columns == sorted(result.columns)
    wanted = [dict(zip(result.columns, r, strict=True)) for r in result.fetchall()]
    assert rows([r.asDict() for r in made.collect()], columns) == rows(wanted, columns)


def test_shell_decompose_row_by_row(spark, sf, duck):
    wanted = []
    for conv, turn, line in duck.sql("SELECT conv_id, turn, text FROM conversations").fetchall():
        wanted += [(conv, turn, n, a.activity_class, a.program, len(a.tokens), len(a.files)) for n, a in enumerate(shell.activities(line or ""))]
    assert sorted(map(str, map(tuple, extra.shell_decompose(spark, sf).collect()))) == sorted(map(str, wanted))


def test_template_abstract_row_by_row(spark, sf, duck):
    counted = Counter(text.template(re.split("[ \t\n]+", t)) for (t,) in duck.sql("SELECT text FROM conversations WHERE text IS NOT NULL").fetchall())
    assert {r.template: r.n for r in extra.template_abstract(spark, sf).collect() if r.template is not None} == counted


def test_normalise_path_row_by_row(spark, sf, duck):
    got = {r.page_id: r.path for r in extra.normalise_path(spark, sf).collect()}
    for page, url in duck.sql("SELECT page_id, url FROM pages").fetchall():
        found = re.match("[a-z]+://([^/]+)(/.*)?$", url or "")
        host, path = (found[1], found[2] or "") if found else ("", "")
        assert got[page] == text.normalise_path(f"/srv/{host}{path}", f"/srv/{host}", "/home/user")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(core.QUERIES) | set(extra.QUERIES) | set(logs.QUERIES | guidance.QUERIES | studies.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    for folder, _, names in os.walk(f"{root}/stepweave"):
        if "/llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "stepweave.llm" not in open(f"{folder}/{n}").read(), n
