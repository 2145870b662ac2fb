"""Every query of the library beside its SQL twin on the small tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomspark.plans import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, (bool, np.bool_, str)):
            return str(x)
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(name, spark, duck):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["fuzzy_block_dedup", "fuzzy_match_log", "fuzzy_threshold_sweep", "fuzzy_cross_split", "fuzzy_cross_split_wide"])
def test_fuzzy_equals_sql_on_near_copies(name, spark, tmp_path):
    """Texts of the same words in other orders, which the small tables lack."""
    import random

    rng, own = random.Random(8), ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj", "kk", "ll"]
    rows = []
    for k in range(36):
        words = own[: rng.choice([11, 12])]
        for _ in range(rng.choice([0, 1, 2])):
            i = rng.randrange(len(words) - 1)
            words[i], words[i + 1] = words[i + 1], words[i]
        rows.append((k, " ".join(words), "en", "s", 1))
    rows += [(50, None, "en", "s", 0), (51, " ", "en", "s", 1), (60, "far off", "en", "s", 7), (61, "far off", "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, rng.choice([0, None]), rng.choice([1, None])) for k in range(0, 36, 2)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want) and len(got) > 0


rows_of = rows
