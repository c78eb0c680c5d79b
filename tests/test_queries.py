"""Queries of the core run on the smallest tables; those with SQL give the same rows in DuckDB, the others the values of their tables."""

import zlib

import pytest

import __spark_entry__ as entry
from graphlens.queries import data, graph, tables
from tests.helpers import SF, database, same_rows

CORE = {name for m in (graph, tables, data) for name in m.queries()}
NAMES = sorted(n for n in CORE if n in entry.oracle_sql())
OTHERS = sorted(CORE - set(NAMES))
#: Queries whose result is empty because that is what they show.
EMPTY = {"impact_nothing"}


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, db, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert same_rows(got, db.execute(entry.oracle_sql()[name]).df()) == ""
    assert len(got) > 0 or name in EMPTY


def test_all_others_are_checked_below():
    assert set(OTHERS) == {"vector_routed", "metrics_exposition", "parse_files", "parsed_functions", "linked_edges", "checksums"}


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_vector_routed(spark, db):
    near = rows(spark, "vector_routed")
    assert len(near) == 10 and near[0].score == pytest.approx(0, abs=1e-6) and [r.score for r in near] == sorted(r.score for r in near)


def test_metrics_exposition(spark, db):
    lines = {r.line.split(" ")[0]: float(r.line.split(" ")[1]) for r in rows(spark, "metrics_exposition")}
    for kind, n, total in db.execute("select event_type, count(*), sum(value) from events group by 1").fetchall():
        assert lines[f'calls_count{{event_type="{kind}"}}'] == n and lines[f'calls_sum{{event_type="{kind}"}}'] == pytest.approx(total)


def test_parsed_python(spark, db):
    """Against the interpreter's parser, called on the same texts here."""
    import ast

    texts = dict(db.execute("select file_path, text from documents where kind = 'source' and file_path like '%.py'").fetchall())
    want, bad = set(), set()
    for path, text in texts.items():
        try:
            tree = ast.parse(text.lstrip("\ufeff"))
        except (SyntaxError, ValueError):
            bad.add(path)
            continue
        want |= {(path, n.name, n.lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and not n.name.startswith("test_")}
    assert {(r.file_path, r.name, r.start_line) for r in rows(spark, "parsed_functions")} == want and len(want) > 10
    files = {r.path: r for r in rows(spark, "parse_files")}
    assert set(files) == set(texts) and {p for p, r in files.items() if not r.ok} == bad
    assert all(r.line_count == len(texts[p].splitlines()) for p, r in files.items())
    by = {(r.type, r.by): r.n for r in rows(spark, "linked_edges")}
    assert by["DEFINES", "id"] >= len(want) and sum(by.values()) == sum(r.edges for r in files.values())


def test_checksums(spark, db):
    want = {(i, zlib.crc32((t or "").encode())) for i, t in db.execute("select doc_id, text from documents").fetchall()}
    assert {tuple(r) for r in rows(spark, "checksums")} == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["source_id", "target_id", "type"] and out.count() > 0


def test_a_fault_inside_the_subpackage_is_no_missing_one(monkeypatch):
    """Only a missing subpackage is passed over."""
    import builtins
    import importlib

    real = builtins.__import__

    def broken(name, *args, **kwargs):
        if name == "graphlens.llm":
            raise ModuleNotFoundError("no module", name=missing)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", broken)
    missing = "graphlens.llm"
    assert set(importlib.reload(entry).queries()) == CORE
    missing = "regex"
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)
