import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from codexlake.session import local_session, ship

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def same():
    """same(query, sql): both give the same rows on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 5)
        return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    def compare(df, sql):
        columns = sorted(df.columns)
        got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select([f"`{c}`" for c in columns]).collect())
        out = con.execute(sql)
        names = [d[0] for d in out.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())

    return compare
