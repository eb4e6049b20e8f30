"""A foreign SQLite file of facts."""

import sqlite3
from contextlib import closing

import pytest

from lodeweave.operators import graph
from lodeweave.sources import triples as S


def written(path, rows, source="source_file", version=1, columns=S.REQUIRED):
    with closing(sqlite3.connect(path)) as con:
        con.execute(f"CREATE TABLE triples (id INTEGER PRIMARY KEY, {', '.join(f'{c} TEXT' for c in columns)}, {source} TEXT, confidence REAL)")
        con.executemany(f"INSERT INTO triples (id, {', '.join(columns)}, {source}) VALUES ({', '.join('?' * (len(columns) + 2))})", rows)
        con.execute(f"PRAGMA user_version = {version}")
        con.commit()
    return str(path)


ROWS = [
    (1, "Ada", "knows", "Bob", "2024-01-01", None, "a.md"),
    (2, "", "knows", "Bob", None, None, "a.md"),
    (3, "Ada", None, "Bob", None, None, "a.md"),
    (40, "Bob", "lives_in", "Łódź", None, "2025-01-01", None),
    (41, "Bob", "lives_in", "Łódź", None, "2025-01-01", None),
    (90_000, "Cy", "knows", b"\xff\xfe", None, None, ""),
]


@pytest.mark.parametrize(("source", "version"), [("source_file", 1), ("source", 0)])
def test_rows_come_whole_in_ranges(spark, tmp_path, source, version):
    path = written(tmp_path / "k 1.db", ROWS, source, version)
    got = S.triples(spark, path, rows=30_000)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(
        [("Ada", "knows", "Bob", "2024-01-01", None, "a.md"), ("Bob", "lives_in", "Łódź", None, "2025-01-01", None), ("Cy", "knows", "��", None, None, "")], key=str
    )
    assert len(S.Reader(path, 30_000).partitions()) == 3
    assert [r["id"] for r in got.orderBy("id").collect()] == [r["id"] for r in S.triples(spark, path, rows=7_000).orderBy("id").collect()]
    assert graph.match(got, predicate="lives_in", as_of="2024-06-01").count() == 1


def test_what_does_not_fit_raises(spark, tmp_path):
    for name, how, told in (("v", {"version": 7}, "version 7"), ("c", {"source": "origin"}, "source_file"), ("d", {"columns": S.REQUIRED[:3] + ("start", "stop")}, "valid_from, valid_to")):
        path = written(tmp_path / f"{name}.db", ROWS, **how)
        with pytest.raises(S.SchemaMismatch, match=told):
            S.triples(spark, path)
    sqlite3.connect(tmp_path / "e.db").execute("CREATE TABLE other (x)")
    with pytest.raises(S.SchemaMismatch, match="no table"):
        S.triples(spark, str(tmp_path / "e.db"))
    with pytest.raises(sqlite3.OperationalError):
        S.triples(spark, str(tmp_path / "absent.db"))


def test_an_empty_table_has_no_facts(spark, tmp_path):
    assert S.triples(spark, written(tmp_path / "n.db", [])).collect() == []
