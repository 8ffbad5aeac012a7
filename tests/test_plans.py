"""Scale smoke: in the physical plans of the registered queries, every
single-partition exchange receives aggregated (bounded) rows - block
totals, one-row scalars, per-category tables, top-k - never a row-level
scan.  Plans do not depend on the data size, so sf0.001 suffices."""

import re

import pytest

import panelkit.plans  # noqa: F401
from panelkit.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY_MODELS = {"svm_grid", "leaderboard", "svm_metrics", "nn_metrics", "nn_confusion", "gam_terms",
                    "gam_grid", "gam_eval", "ols_coef_ci"}
BOUNDED = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject",
           "LocalTableScan", "panelkit_tables")


def _single_partition_inputs(plan: str):
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        indent = len(line) - len(line.lstrip(" :+-"))
        below = []
        for nxt in lines[i + 1:]:
            ind = len(nxt) - len(nxt.lstrip(" :+-"))
            if ind <= indent:
                break
            below.append(nxt)
        # first operator below that is not a projection/filter/exchange decides
        head = next((b.strip(" :+-") for b in below
                     if not re.match(r"^[\s:+-]*(Project|Filter|Exchange|AQEShuffleRead|ColumnarToRow|"
                                     r"WholeStageCodegen|\*\(|Sort |InputAdapter)", b)), "")
        out.append((head, below))
    return out


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY_MODELS))
def test_no_row_level_single_partition(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for head, below in _single_partition_inputs(plan):
        text = "\n".join(below)
        assert any(b in head for b in BOUNDED) or "panelkit_tables" in text.split("Exchange")[0], \
            f"{name}: single-partition exchange over {head[:120]}"
