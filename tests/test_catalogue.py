"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lektor.plans import catalogue, review

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    return repr(round(float(value), 6)) if isinstance(value, (int, float)) else str(value)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert have == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("code", "WE1 WE2 WE3 WE4 WE5 WE6 WE7 WE8 WE10 WE11 WE12 WE15 WE16 WE19 WE20 WE21 WE22 WE23 WE25 LP5 LPG1 LPG2 LPG3 LPG4 WEG1 WEG2 ASG1 FGG1 FGG2 FG4 FG7 SB1 SB2 SB4 CE4 CE5 PQ".split())
def test_rules_tell_apart(duck, code):
    """The stand-in tables hold cases of more than one verdict."""
    sql = catalogue.oracle_sql()[f"rule_{code.lower()}"].replace("documents", "wide_documents").replace("conversations", "wide_conversations")
    duck.execute("create or replace view wide_documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    duck.execute("create or replace view wide_conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    assert len({r[0] for r in duck.sql(f"select distinct status from ({sql})").fetchall()}) > 1 and review is not None
