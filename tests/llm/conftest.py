import os

import duckdb
import pytest

TABLES = ("documents", "labels", "benchmark", "pages")


@pytest.fixture(scope="session")
def same_as_oracle():
    """Checks rows of a query against DuckDB SQL over the tables of a folder."""

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
        ours, theirs = df.toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        plain = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
        assert plain(ours) == plain(theirs)

    return check
