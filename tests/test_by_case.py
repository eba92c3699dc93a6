"""Judgments are dealt by case once; what follows makes no other exchange of them."""

import re

import pytest

from claimweave.plans import registry


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("name", ["secondary_score", "secondary_shortlist", "secondary_risk", "safe_shortlist"])
def test_secondary_scores_deal_rows_once(spark, sf_dir, name):
    found = exchanges(registry.QUERIES[name](spark, sf_dir))
    assert len(found) == 3 and all(x.split(", ")[:-1] == ["case_id"] for x in found)


def test_claims_are_parsed_once(spark, sf_dir):
    plan = registry.QUERIES["claim_elements"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 20
    assert not [x for x in plan.splitlines() if "Filter" in x and "elements" in x]


def test_responses_are_checked_once_for_all_levels(spark, sf_dir):
    plan = registry.QUERIES["response_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # of the items and the responses that have none
