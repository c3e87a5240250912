"""Plan shapes: no pair joins, no one-task windows, no row-wise Python."""

import pytest

from tablewright.plans import load

QUERIES = load()[0]
# One matrix product per Arrow batch.
ARROW = {"vector_topk", "vector_topk_l2"}


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, small, name):
    execution = QUERIES[name](spark, small)._jdf.queryExecution()
    text = execution.executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups"):
        assert bad not in text, f"{bad} in the plan"
    if name not in ARROW:
        assert "MapInArrow" not in text and "MapInPandas" not in text
    for node in nodes(execution.optimizedPlan()):
        if node.nodeName() == "Window":
            assert not node.partitionSpec().isEmpty(), "a window without a partition runs in one task"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(tables):
    from tablewright.operators import filters
    from tablewright.operators.paging import scan_page

    df = tables.orders.where(filters.filter_rule("o_totalprice", "between", 1.0, 2.0)).select("o_orderkey")
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in plan_of(df)
    assert "o_orderdate" not in plan_of(df).split("ReadSchema")[1]
    page = scan_page(tables.orders, ["o_orderkey"], "o_orderstatus = 'F'", ["o_orderkey"], 10)
    assert "EqualTo(o_orderstatus,F)" in plan_of(page) and "TakeOrderedAndProject" in plan_of(page)


def test_keyset_page_bounds_the_scan(tables):
    from tablewright.operators.paging import page_keyset

    page = page_keyset(tables.lineitem, ["l_orderkey", "l_linenumber"], [700, 3], 10)
    assert "GreaterThanOrEqual(l_orderkey,700)" in plan_of(page)


def test_diff_is_one_join_reading_each_side_once(tables):
    from tablewright.operators.diff import diff_rows
    from tablewright.plans.diffing import perturbed

    text = plan_of(diff_rows(tables.orders, perturbed(tables.orders), ["o_orderkey"], checked=False))
    assert text.count("FullOuter") == 1
    # The source once, the target's two parts once each.
    assert text.count("FileScan") == 3


def test_top_per_group_limits_before_the_shuffle(tables):
    from tablewright.operators.windows import last_n_samples

    text = plan_of(last_n_samples(tables.events, ["event_type"], ["ts", "event_id"]))
    assert "WindowGroupLimit" in text and "Partial" in text
