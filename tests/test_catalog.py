"""Registered queries against their DuckDB text, at the smallest scale.

The default run takes a few queries per family; PLUMBLINE_ALL=1 takes all.
"""

import os

import duckdb
import pytest

from plumbline.catalog import all_entries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
FEW = (
    "calibration_summary evaluate_condition_splits scores_long ranking_by_region ranking_metrics_ranged near_dup_candidates connected_components "
    "exclusions grouped_split select_balanced_split validate_protocol region_calibration bilinear_upsample apply_condition fit_scopes "
    "paired_bootstrap quality_summary duplicate_consistency calibration_stream phash_bits"
).split()
CHECKED = {n: e for n, e in all_entries().items() if e[1] is not None}
NAMES = sorted(CHECKED) if os.environ.get("PLUMBLINE_ALL") else FEW


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def text(value):
    return f"{value:.6f}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, sf_dir, name):
    build, sql = CHECKED[name]
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    got = [[r[c] for c in columns] for r in df.collect()]
    assert sorted([text(v) for v in row] for row in got) == sorted([text(v) for v in row] for row in want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 7
