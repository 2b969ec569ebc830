"""Every registered raster query against its SQL."""

import os

import duckdb
import pytest

from rasterloom.plans import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{name}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in clean.itertuples(index=False))


FEW = ["sobel", "gaussian_smooth", "top3_cascade", "cleanup_max", "weighted_fuse", "fuse_max", "warp_bilinear", "halo_exchange", "area_resize", "knn_ratio_match", "cleanup_pixels", "multiband_accumulate", "focus_band_frames", "tile_seams", "alignment_accept", "normal_equations", "seam_max", "run_totals", "arriving_frames", "best_hypothesis", "transform_overlap", "size_texts", "halo_widths", "settings_rules", "file_headers", "file_pixels", "file_windows", "file_grey", "run_of_equal_frames", "aligned_frames", "hash_texture", "pixel_tenengrad", "block_pyr_down", "tiff_roundtrip"]


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stacked_files(spark, sf_dir):
    assert queries.QUERIES["stacked_files"](spark, sf_dir).count() == 70 * 90
