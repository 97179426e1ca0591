import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strandmill.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(SMALL).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(duck):
    """Asserts that a frame and a SQL text give the same rows, whatever their order."""

    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return x

    def check(df, sql):
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        other = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
        assert mine == other

    return check
