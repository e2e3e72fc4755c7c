"""Decisions about calls: what is protected, what is steered, and that nothing is denied without confirmed capabilities."""

from turnledger.operators import policy

CALLS = [
    (1, "edit", None, True, True, 100, 10, True), (2, "read", True, True, True, 100, 10, True), (3, "read", False, True, True, 100, 10, True), (4, "read", False, True, True, 100, 200, True), (5, "read", False, True, True, 100, None, False), (6, "read", False, True, True, 0, 900, False),
    (7, "search", False, False, True, 50, None, False), (8, "read", False, False, True, 50, None, True), (9, "execution", False, False, True, 50, None, True), (10, None, None, None, None, None, None, None), (11, "read", False, True, False, 5, None, True),
]


def decided(spark, *args):
    calls = spark.createDataFrame(CALLS, "id long, kind string, is_edit_target boolean, is_source boolean, semantic_available boolean, token_est long, bundle_tokens long, reducible boolean")
    return {r["id"]: r for r in policy.decide(calls, *args).collect()}


def test_decisions(spark):
    got = {k: (r["action"], r["reason"], r["confidence"], r["fail_open"], r["saved_est"]) for k, r in decided(spark).items()}
    protected, steered = ("pass_through", "edit_precondition_protected", "high", True, None), "source_read_has_semantic_equivalent"
    assert got == {
        1: protected, 2: protected, 3: ("recommend_semantic", steered, "high", False, 90), 4: ("pass_through", "semantic_bundle_not_smaller", "medium", False, None), 5: ("recommend_semantic", steered, "medium", False, None), 6: ("recommend_semantic", steered, "high", False, 0),
        7: ("recommend_semantic", "search_has_semantic_equivalent", "medium", False, None), 8: ("reduce_output", "non_source_output_reducible", "medium", False, None), 9: ("pass_through", "kind_execution_not_steerable", "high", False, None), 10: ("pass_through", "kind_unknown_not_steerable", "high", True, None), 11: ("pass_through", "no_semantic_equivalent", "high", False, None),
    }


def test_denial_needs_confirmed_capabilities(spark):
    confirmed = dict.fromkeys(policy.NEEDED, "yes")
    assert {r["action"] for r in decided(spark, "enforce", confirmed).values()} == {"pass_through", "deny_nudge", "reduce_output"}
    for capabilities in (None, {}, confirmed | {policy.NEEDED[1]: "?"}):
        got = decided(spark, "enforce", capabilities).values()
        assert not any(r["enforced"] for r in got) and {r["mode_effective"] for r in got} == {"advisory"}
    enforced = decided(spark, "enforce", confirmed)
    assert enforced[1]["action"] == enforced[2]["action"] == "pass_through" and enforced[3]["enforced"] and not enforced[8]["enforced"]
