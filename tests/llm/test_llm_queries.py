"""Queries of the text operators on the smallest tables: against SQL, each other and what must hold of any result."""

import math

import pytest

import __spark_entry__ as entry
from graphlens.llm import queries
from tests.helpers import SF, database, same_rows


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.fixture(scope="module")
def got(spark):
    known = {}

    def run(name):
        if name not in known:
            known[name] = entry.queries()[name](spark, SF).toPandas()
        return known[name]

    return run


def test_all_are_registered():
    assert set(queries.queries()) <= set(entry.queries()) and len(queries.queries()) == 16


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(got, db, name):
    assert same_rows(got(name), db.execute(queries.oracle_sql()[name]).df()) == ""


def test_not_by_hand(got, db):
    found, why = got("p1_found"), got("p1_reasons")
    assert len(found) > 0 and set(found.file_path) == set(why.file_path) and not found.file_path.duplicated().any()
    assert set(why.by) <= {"declared", "pattern", "content"} and set(why.reason) <= {"generated", "minified", "vendored", "data"}
    lines = got("p1_lines")
    files = db.execute("select count(distinct file_path) from parsed_files").fetchone()[0]
    assert lines.files.sum() == files and lines[lines.reason != "hand-written"].files.sum() == len(found)


def test_validity(got):
    found, rates, causes = got("p2_found"), got("p2_rates"), got("p2_causes")
    assert len(found) > 0 and rates.invalid.sum() == len(found) == causes[causes.first_cause.notna()].files.sum()
    assert all(math.isclose(r.rate, r.invalid / r.files) for r in rates.itertuples())


def test_languages(got):
    found, shares, hidden = got("p3_found"), got("p3_shares"), got("p3_hidden")
    assert len(found) > 0 and not found.duplicated().any() and len(set(found.lang)) > 5
    assert all(math.isclose(x, 1) for x in shares.groupby("file_path").share.sum())
    assert set(hidden.kind) == {"comment", "string"} and hidden.share_of_file.between(0, 1).all() and len(set(hidden.lang)) > 1


def test_documentation(got):
    found, pairs = got("p7_found"), got("p7_pairs")
    assert len(found) > 0 and set(found.node_id) == set(pairs.node_id) and pairs.documentation.str.strip().ne("").all()


def test_tokens(got, db):
    ids = got("p8_ids")
    assert len(ids) == db.execute("select count(*) from documents").fetchone()[0]
    empty = {r[0] for r in db.execute("select doc_id from documents where coalesce(text, '') = ''").fetchall()}
    assert {r.doc_id for r in ids.itertuples() if len(r.ids) == 0} == empty


def test_mixing(got, db):
    drawn, shares = got("p9_sample"), got("p9_shares")
    assert not drawn.duplicated().any() and len(drawn) == shares.copies.sum()
    most = dict(db.execute("select mix, max(max_repeats) from mix_targets group by 1").fetchall())
    assert all(r.copy <= most[r.mix] for r in drawn.itertuples())
    assert all(math.isclose(x, 1) or x == 0 for x in shares.groupby("mix").actual_share.sum())


def test_sentences(got, db):
    rows = got("p10_found").sort_values(["doc_id", "start_char"])
    texts = dict(db.execute("select doc_id, text from documents where kind = 'prose'").fetchall())
    last = {}
    for r in rows.itertuples():
        assert 0 <= r.start_char < r.end_char <= len(texts[r.doc_id]) and r.start_char >= last.get(r.doc_id, 0)
        assert texts[r.doc_id][r.start_char : r.end_char].strip() == texts[r.doc_id][r.start_char : r.end_char]
        last[r.doc_id] = r.end_char
    assert set(last) == {d for d, t in texts.items() if t and t.strip()}
