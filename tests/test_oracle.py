"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from rasterlake.operators import learn as M
from rasterlake.plans import catalog

DATA = "/root/testdata/sf0.001"
SLOW = {"ink_components", "ink_clean", "ink_size_kinds", "ink_largest_share", "component_features", "glyph_top", "glyph_lines"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(5).fillna(-9)
        else:
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    got, want = normal(catalog.queries()[name](spark, DATA).toPandas()), normal(con.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_equals_sql_on_a_few_images(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{DATA}/embeddings.parquet' ORDER BY vec_id LIMIT 25) TO '{tmp_path}/embeddings.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = normal(catalog.queries()[name](spark, str(tmp_path)).toPandas()), normal(con.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_cross_validation_fits_the_whole_grid(spark):
    cv = catalog.queries()["samples_cross_validation"](spark, DATA).toPandas()
    assert len(cv) == 450 and sorted(cv["lam"].unique()) == M.LAMBDAS
    assert set(cv["repeat"]) == set(range(10)) and set(cv["out"]) == set(range(5))
    assert (cv.groupby(["lam", "repeat"])["n"].sum() == catalog.V.samples(spark, DATA).count()).all()


#: Rasters whose ink is as far from their paper as their light is, but for the last bit of a percentile.
EVEN = [
    [127, 135, 137, 152, 135, 134, 99, 126, 133, 119, 113, 128, 147, 124, 117, 121, 156, 101, 135, 141, 130, 118, 129, 142, 141, 107, 135, 143, 116, 147, 122, 90, 108, 123, 115, 104, 109, 141, 151, 127, 120, 109, 162, 113, 125, 124, 135, 133, 128, 118, 127, 154, 120, 139, 112, 140, 107, 109, 129, 161, 98, 126, 125, 153],
    [119, 131, 116, 122, 142, 121, 103, 136, 126, 136, 139, 93, 133, 112, 122, 127, 124, 172, 113, 139, 99, 114, 121, 88, 123, 122, 157, 127, 140, 138, 128, 127, 122, 122, 123, 121, 132, 115, 106, 168, 136, 126, 131, 145, 136, 137, 153, 140, 139, 107, 130, 130, 169, 119, 117, 126, 102, 112, 119, 123, 122, 124, 119, 132],
]


@pytest.mark.parametrize("name", ["raster_polarity", "raster_bright_ink"])
@pytest.mark.parametrize("even", EVEN)
def test_even_polarity_breaks_as_in_sql(spark, tmp_path, name, even):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT 1::BIGINT AS vec_id, {[(v + 0.5) / 127.5 - 1 for v in even]}::FLOAT[] AS embedding) TO '{tmp_path}/embeddings.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = normal(catalog.queries()[name](spark, str(tmp_path)).toPandas()), normal(con.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
