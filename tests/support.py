"""What tests share."""

from pathlib import Path

SF = Path("/root/testdata/sf0.001")


def same(got, con, sql):
    """Rows of a DataFrame equal those of the SQL, whatever their order."""
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert a == b
