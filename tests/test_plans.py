"""The plans that matter at scale."""

import pytest

from catalograph.plans.catalogue import QUERIES

CHECKED = [k for k in QUERIES if k[0] in "rgdc"]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("key", CHECKED)
def test_no_cross_products(spark, sf, key):
    text = plan(QUERIES[key](spark, sf))
    physical = text[text.index("== Physical Plan =="):]
    assert "CartesianProduct" not in physical, key
    assert "BroadcastNestedLoopJoin" not in physical, key


def test_search_is_one_gated_top_k(spark, sf):
    text = plan(QUERIES["v2_hybrid_search"](spark, sf))
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text


def test_patterns_prune_partitions(spark, sf):
    text = plan(QUERIES["g1_pattern"](spark, sf))
    assert "PartitionFilters: [isnotnull(p" in text and "ReadSchema: struct<store:string,s:string,o:string>" in text


def test_work_list_uses_anti_joins_and_no_sort_of_everything(spark, sf):
    text = plan(QUERIES["r5_pending"](spark, sf))
    assert "LeftAnti" in text and "TakeOrderedAndProject" in text


def test_inventory_scan_reads_no_content(spark, tmp_path):
    from catalograph.sources.files import scan_media

    (tmp_path / "x.png").write_bytes(b"x")
    assert "content" not in plan(scan_media(spark, str(tmp_path))).split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_top_per_key_limits_before_the_shuffle(spark, sf):
    from pyspark.sql import functions as F

    from catalograph.operators.vectors import top_per_key

    df = spark.read.parquet(f"{sf}/events.parquet")
    assert "WindowGroupLimit" in plan(top_per_key(df, ["user_id"], [F.desc("value")], 3))
