from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakeaudit.session import build_session

    session = build_session("tests", "local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


def compare(spark, queries, sqls, name, sf):
    """Rows and columns of a query against its SQL in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = queries[name](spark, sf).toPandas()
    rel = con.sql(sqls[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    day = lambda v: v.removesuffix(".000000").removesuffix(" 00:00:00")
    plain = lambda v: "-" if v is None or v != v else day(str(v)) if hasattr(v, "isoformat") else str(v)
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in rel.fetchall())
    have = sorted(tuple(plain(v) for v in r) for r in got.astype(object).itertuples(index=False))
    number = lambda rows: [tuple(x.removesuffix(".0") for x in r) for r in rows]
    assert sorted(number(have)) == sorted(number(want))
