"""The derived panel: what its stored table holds, and the exchanges that its readers need."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelyard.contract import HORIZONS, SERIES
from panelyard.operators import cross_section
from panelyard.operators.group_sizes import GroupSizes
from panelyard.operators.series import series_window
from panelyard.sources import star_panel


@pytest.fixture(scope="module")
def small_sf(spark, tmp_path_factory):
    """240 line items of 5 suppliers and of none, two on the same day now and then; one supplier
    comes twice, one has no nation."""
    folder = str(tmp_path_factory.mktemp("star"))
    first = datetime.datetime(1995, 1, 1)
    items = [
        (
            None if i % 40 == 39 else i % 5, "ANR"[i % 3] if i % 17 else None, i % 4 + 1, float(i % 50), 900.0 + i * 7 % 113,
            i % 11 / 100, first + datetime.timedelta(days=i // 12 * 9),
        )
        for i in range(240)
    ]
    schema = (
        "l_suppkey long, l_returnflag string, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_shipdate timestamp_ntz"
    )
    spark.createDataFrame(items, schema).write.parquet(f"{folder}/lineitem.parquet")
    suppliers = [(0, 3), (1, 4), (2, 4), (3, None), (4, 5), (4, 5), (None, 6), (9, 1)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    return folder


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(repr, df.select(*columns).collect()))


def hashed(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_panel_has_a_row_per_day_and_gives_one_per_horizon(spark, small_sf):
    panel = star_panel.panel_table(spark, small_sf)
    stored = spark.table(star_panel._tables[spark.sparkContext.applicationId, small_sf])
    assert panel.count() == stored.count() * len(HORIZONS) > 0
    assert rows(panel) == rows(star_panel.panel(spark, small_sf))


def test_series_windows_over_the_panel_need_no_exchange(spark, small_sf):
    panel = star_panel.panel_table(spark, small_sf)
    assert hashed(panel.select(*SERIES, F.lag("feature_al").over(series_window()).alias("past"))) == 0


def test_panel_is_dealt_once_and_combined_first_for_a_hot_supplier(spark, small_sf):
    plain = star_panel.daily_targets(spark, small_sf, 3, False)
    combined = star_panel.daily_targets(spark, small_sf, 3, True)
    assert hashed(plain) == 1 and hashed(combined) == 2
    assert rows(plain) == rows(combined)


def test_partitions_grow_with_the_rows(spark, small_sf, monkeypatch):
    assert star_panel._dealing(spark, small_sf) == (spark.sparkContext.defaultParallelism, False)
    monkeypatch.setattr(star_panel, "BUCKET_ITEMS", 10)
    monkeypatch.setattr(star_panel, "GROUP_ROW_LIMIT", 40)
    assert star_panel._dealing(spark, small_sf) == (24, True)
    monkeypatch.setattr(cross_section, "SECTION_TASK_ROWS", 10)
    panel = star_panel.panel_table(spark, small_sf)
    sizes = GroupSizes(1, 1, rows=200)
    dealt = cross_section.section_values(panel, ["feature_al"], sizes, ranks=True)
    assert dealt.rdd.getNumPartitions() == 20
    assert rows(dealt) == rows(cross_section.section_values(panel, ["feature_al"], GroupSizes(1, 1), ranks=True))
