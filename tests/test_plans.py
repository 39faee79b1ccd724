"""What the plans look like: filters at the scan, columns pruned, no Cartesian product."""

import pytest

from quern.plans import registry
from quern.staging import shared_folder, staged

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark):
    text = plan(registry.queries()["filter_expression"](spark, SMALL))
    assert "PushedFilters" in text and "In(file_extension, [.py,.ts])" in text and "content" not in text.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["cache_misses", "snapshot_diff", "catalog_latest_state", "grep_lines", "weighted_fusion", "parent_index", "reindex_delta", "tool_counts"])
def test_no_product_of_tables(spark, name):
    assert "CartesianProduct" not in plan(registry.queries()[name](spark, SMALL))


def test_scan_reads_only_what_is_asked_for(spark):
    text = plan(registry.queries()["token_totals"](spark, SMALL))
    assert "props" not in text and "ts:timestamp" not in text and "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in text


def test_ranking_sees_no_contents(spark):
    text = plan(registry.queries()["bm25_topk"](spark, SMALL))
    assert "content" not in text and "PushedFilters: [In(term, [" in text


def test_only_rows_that_come_again_are_shuffled(spark):
    text = plan(registry.queries()["language_map"](spark, SMALL))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text and "LeftSemi" in text


def test_staged_tables_lie_in_the_shared_folder(spark):
    df = staged(spark.range(5).selectExpr("id", "array(id) as a"))
    assert df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_folder(spark).split(":", 1)[-1].lstrip("/"))
    assert [f.name for f in df.schema.fields] == ["id", "a"] and df.count() == 5


def test_every_core_query_with_sql_has_both():
    assert set(registry.oracle_sql()) <= set(registry.queries())
