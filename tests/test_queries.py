"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

from skyframe import queries

from .conftest import DATA, canonical

NAMES = [n for n in queries.ORACLES if not n.endswith("_any")]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    got, want = canonical(queries.QUERIES[name](spark, DATA_FOR(name)).toPandas()), canonical(duck_for(duck, name).sql(queries.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


# the SQL closure is quadratic in the one large component that the smallest set has
SLOW_AT_SMALLEST = {"labels", "labels_mosaic", "measurements_mosaic", "components", "detections", "detection_summary", "top10_snr", "iso_flux_centroid", "moments_axes", "kron_radius", "kron_flux", "edge_flags", "measurements", "measurements_tile", "top15_flux", "flux_stats", "csv_rows", "ellipse_points", "viewport_filter", "nearest_source", "single_table", "sql_detect", "sql_views", "run_overlap", "forms_compared", "csv_single", "fits_file", "csv_file", "run_files", "file_errors"}
LARGER = "/root/testdata/sf0.01"
_cons = {}


def DATA_FOR(name):
    return LARGER if name in SLOW_AT_SMALLEST else DATA


def duck_for(duck, name):
    if name not in SLOW_AT_SMALLEST:
        return duck
    if not _cons:
        import glob
        import os

        import duckdb

        con = _cons["c"] = duckdb.connect()
        for p in glob.glob(f"{LARGER}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return _cons["c"]


def test_published_counts(spark):
    found = queries.QUERIES["detections"](spark, LARGER)
    assert found.count() == 88
    assert queries.QUERIES["dedup_removed"](spark, LARGER).count() == 175
    assert queries.QUERIES["dedup_removed_any"](spark, LARGER).count() == 244
