"""What to do about a pending call, as one expression over its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions, modes, and the capabilities that a host must have confirmed before a call can be denied.
ACTIONS, ADVISORY, ENFORCE = ("pass_through", "recommend_semantic", "reduce_output", "deny_nudge"), "advisory", "enforce"
NEEDED = ("pre_tool_use_hook", "edit_read_tracker_satisfied_by_mcp")


def decide(calls: DataFrame, mode: str = ADVISORY, capabilities: dict[str, str] | None = None) -> DataFrame:
    """(id, action, reason, confidence, mode_effective, enforced, fail_open, saved_est) of calls (id, kind, is_edit_target, is_source,
    semantic_available, token_est, bundle_tokens, reducible); nulls mean that nothing is known and lead to passing the call on.

    Edits and reads that an edit needs always pass. A read of indexed source, and a search of it, is better served by symbols, unless these would
    cost more (bundle_tokens, null: unknown). Other output that can be reduced is. Calls are denied only in mode enforce on a host with all
    ``NEEDED`` capabilities confirmed ("yes"); otherwise the mode is advisory, whatever was asked for.
    """
    enforce = mode == ENFORCE and all((capabilities or {}).get(c) == "yes" for c in NEEDED)
    effective, steer = (ENFORCE, ACTIONS[3]) if enforce else (ADVISORY, ACTIONS[1])
    flag = lambda c: F.coalesce(c, F.lit(False))
    kind, tokens, bundle = F.coalesce("kind", F.lit("unknown")), F.coalesce("token_est", F.lit(0)), F.col("bundle_tokens")
    fits = bundle.isNull() | (tokens == 0) | (bundle <= tokens)

    def answer(action, reason, confidence, fail_open=False, mode=ADVISORY, enforced=False, saved=None):
        literal = lambda x: x if not isinstance(x, (str, bool)) else F.lit(x)
        parts = {"action": action, "reason": reason, "confidence": confidence, "mode_effective": mode, "enforced": enforced, "fail_open": fail_open}
        return F.struct(*[literal(v).alias(k) for k, v in parts.items()], (F.lit(None) if saved is None else saved).cast("bigint").alias("saved_est"))

    semantic = flag("semantic_available")
    source = (kind == "read") & flag("is_source") & semantic
    d = (
        F.when((kind == "edit") | flag("is_edit_target"), answer(ACTIONS[0], "edit_precondition_protected", "high", fail_open=True))
        .when(source & fits, answer(steer, "source_read_has_semantic_equivalent", F.when(bundle.isNull(), "medium").otherwise("high"), mode=effective, enforced=enforce, saved=F.greatest(F.lit(0), tokens - bundle) + bundle * 0))
        .when(source, answer(ACTIONS[0], "semantic_bundle_not_smaller", "medium"))
        .when((kind == "search") & semantic, answer(steer, "search_has_semantic_equivalent", "medium", mode=effective, enforced=enforce))
        .when((kind == "read") & flag("reducible") & ~flag("is_source"), answer(ACTIONS[2], "non_source_output_reducible", "medium"))
        .otherwise(answer(ACTIONS[0], F.when(kind == "read", "no_semantic_equivalent").otherwise(F.concat(F.lit("kind_"), kind, F.lit("_not_steerable"))), "high", fail_open=kind.isin("unknown", "")))
    )
    return calls.select("id", d.alias("d")).select("id", "d.*")


def gated(integrity: DataFrame, provenance: DataFrame, schema_version: str) -> DataFrame:
    """``totals.admission``'s checks and those of where a session's journal comes from (provenance: session, hook_schema_version, client_version,
    runtime_commit, canonical_windows): the expected schema, both versions known, the locked set of windows, and valid by steps. A session
    without provenance fails them. ``canonical_admissible`` is all of them together."""
    p = integrity.join(provenance.dropDuplicates(["session"]), "session", "left")
    known = F.col("client_version").isNotNull() & F.col("runtime_commit").isNotNull()
    canonical = F.coalesce("canonical_windows", F.lit(False))
    checks = {
        "pre_equals_batch": F.col("seen_calls") == F.col("resolved_calls"), "zero_errors": F.col("errors") == 0, "zero_pending": F.col("pending") == 0, "hook_schema_expected": F.coalesce(F.col("hook_schema_version") == schema_version, F.lit(False)),
        "canonical_report": canonical, "canonical_validity": canonical & (F.col("missing_steps") == 0), "provenance_complete": known,
    }
    every = F.lit(True)
    for c in checks.values():
        every &= c
    return p.select("session", *[c.alias(k) for k, c in checks.items()], every.alias("canonical_admissible"), (F.col("unknown_shell") == 0).alias("bash_coverage_clean"))


def find_symbols(symbols: DataFrame, wanted: list[str], top: int = 10) -> DataFrame:
    """(query, rank, kind, id) of each wanted name (a short list, given by the caller) among symbols (id, qualified, path): whole names (0), last
    parts of names (1), parts of names (2), parts of paths (3); of one kind short names first. A symbol gives rows only for the names it fits."""
    fits = lambda q: F.contains("qualified", q) | F.contains(F.coalesce("path", F.lit("")), q)
    s = symbols.select("id", "qualified", F.explode(F.filter(F.array(*map(F.lit, wanted)), fits)).alias("query"))
    kind = F.when(F.col("qualified") == F.col("query"), 0).when(F.endswith("qualified", F.concat(F.lit("."), "query")), 1).when(F.contains("qualified", F.col("query")), 2).otherwise(3)
    w = Window.partitionBy("query").orderBy("kind", F.length("qualified"), "qualified", "id")  # Spark keeps the first of each task before it deals them out
    return s.withColumn("kind", kind.cast("bigint")).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top).select("query", "rank", "kind", "id")
