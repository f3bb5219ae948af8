"""Every query of the session engine against its DuckDB text on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from threadmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame):
    plain = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else (v if isinstance(v, (str, bytes)) else bool(v) if type(v).__name__ in ("bool", "bool_") else float(v))
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        db = duckdb.connect()
        for t in ("conversations", "events", "documents"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)
