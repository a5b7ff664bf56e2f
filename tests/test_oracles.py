"""Every query with SQL gives DuckDB's rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from segmentry.plans import (  # noqa: F401  (they add to the tables of queries)
    absorb_queries,
    cluster_queries,
    graph_queries,
    junction_queries,
    node_queries,
    path_queries,
    realign_queries,
    rescue_queries,
    sequence_queries,
    splice_queries,
)
from segmentry.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    df = df.map(lambda x: str(int(x)) if isinstance(x, float) and x.is_integer() else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows(spark, oracle, name):
    ours, theirs = plans.QUERIES[name](spark, str(DATA)).toPandas(), oracle.execute(plans.ORACLES[name]).df()
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))
