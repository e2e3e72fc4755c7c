"""Queries on decisions about calls, admission by provenance and symbols by name or path, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators import policy, totals
from turnledger.plans.resolving import SYMBOLS, symbols
from turnledger.plans.totals import CAPTURED, captured
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}
CONFIRMED = {c: "yes" for c in policy.NEEDED}
WANTED = ["f12", "m7", "p3.py", "m5.C1.f40", "C2", "none"]


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def pending(s: SparkSession, d: str) -> DataFrame:
    """Order lines as pending calls of all kinds; some lack what is not known."""
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    kinds = F.element_at(F.array(*map(F.lit, ("read", "search", "edit", "execution", "read"))), (p % 5 + 1).cast("int"))
    return V.table(s, d, "lineitem").select(
        (o * 10 + n).alias("id"), F.when(o % 11 != 0, kinds).alias("kind"), (o % 13 == 0).alias("is_edit_target"), F.when(p % 7 != 0, n % 2 == 0).alias("is_source"), (o % 3 != 0).alias("semantic_available"), F.when(p % 9 != 0, p % 400).cast("bigint").alias("token_est"),
        F.when(p % 4 != 0, F.col("l_suppkey") % 300).cast("bigint").alias("bundle_tokens"), (n % 3 == 0).alias("reducible"),
    )


def decided(mode: str, effective: str, steer: str) -> str:
    enforced = effective == "enforce"
    return f"""with c as (select l_orderkey * 10 + l_linenumber as id, coalesce(case when l_orderkey % 11 <> 0 then ['read', 'search', 'edit', 'execution', 'read'][l_partkey % 5 + 1] end, 'unknown') as kind, l_orderkey % 13 = 0 as target, coalesce(case when l_partkey % 7 <> 0 then l_linenumber % 2 = 0 end, false) as source, l_orderkey % 3 <> 0 as semantic,
            coalesce(case when l_partkey % 9 <> 0 then l_partkey % 400 end, 0) as tokens, case when l_partkey % 4 <> 0 then l_suppkey % 300 end as bundle, l_linenumber % 3 = 0 as reducible from lineitem),
        r as (select *, case when kind = 'edit' or target then 1 when kind = 'read' and source and semantic and (bundle is null or tokens = 0 or bundle <= tokens) then 2 when kind = 'read' and source and semantic then 3 when kind = 'search' and semantic then 4 when kind = 'read' and reducible and not source then 5 else 6 end as rule from c)
        select id, case when rule in (2, 4) then '{steer}' when rule = 5 then 'reduce_output' else 'pass_through' end as action, case rule when 1 then 'edit_precondition_protected' when 2 then 'source_read_has_semantic_equivalent' when 3 then 'semantic_bundle_not_smaller' when 4 then 'search_has_semantic_equivalent' when 5 then 'non_source_output_reducible' else case when kind = 'read' then 'no_semantic_equivalent' else 'kind_' || kind || '_not_steerable' end end as reason,
            case when rule in (1, 6) or (rule = 2 and bundle is not null) then 'high' else 'medium' end as confidence, case when rule in (2, 4) then '{effective}' else 'advisory' end as mode_effective, rule in (2, 4) and {str(enforced).lower()} as enforced, rule = 1 or (rule = 6 and kind = 'unknown') as fail_open, case when rule = 2 and bundle is not null then greatest(0, tokens - bundle) end as saved_est from r"""


add("call_decisions", lambda s, d: policy.decide(pending(s, d)), decided("advisory", "advisory", "recommend_semantic"))
add("call_decisions_enforced", lambda s, d: policy.decide(pending(s, d), "enforce", CONFIRMED), decided("enforce", "enforce", "deny_nudge"))
add("call_decisions_unconfirmed", lambda s, d: policy.decide(pending(s, d), "enforce", {policy.NEEDED[0]: "yes"}).groupBy("action", "mode_effective").agg(F.count("*").alias("calls")), f"select action, mode_effective, count(*) as calls from ({decided('enforce', 'advisory', 'recommend_semantic')}) group by all")


def origins(s: SparkSession, d: str) -> DataFrame:
    """Sessions with the schema and versions of their journals; every eighth has none."""
    u = V.table(s, d, "events").select(F.col("user_id").alias("session")).distinct().filter("session % 8 <> 7")
    k = F.col("session") % 5
    return u.select("session", F.when(k == 0, "2").otherwise("3").alias("hook_schema_version"), F.when(k != 1, "c").alias("client_version"), F.when(k != 2, "r").alias("runtime_commit"), (F.col("session") % 9 != 0).alias("canonical_windows"))


add("admission_by_provenance", lambda s, d: policy.gated(totals.integrity(captured(s, d)), origins(s, d), "3"), f"""with {CAPTURED}, o as (select distinct user_id as session, case when user_id % 5 = 0 then '2' else '3' end as v, user_id % 5 not in (1, 2) as complete, user_id % 9 <> 0 as canonical from events where user_id % 8 <> 7),
    a as (select i.session, seen_calls = resolved_calls as pre_equals_batch, errors = 0 as zero_errors, pending = 0 as zero_pending, coalesce(v = '3', false) as hook_schema_expected, coalesce(canonical, false) as canonical_report, coalesce(canonical, false) and missing_steps = 0 as canonical_validity, coalesce(complete, false) as provenance_complete, unknown_shell = 0 as bash_coverage_clean from integrity i left join o on i.session = o.session)
    select *, pre_equals_batch and zero_errors and zero_pending and hook_schema_expected and canonical_report and canonical_validity and provenance_complete as canonical_admissible from a""")
add("find_symbols", lambda s, d: policy.find_symbols(symbols(s, d), WANTED), f"""with {SYMBOLS}, x as (select id, qualified, query, case when qualified = query then 0 when ends_with(qualified, '.' || query) then 1 when contains(qualified, query) then 2 when contains(path, query) then 3 end::bigint as kind from sym, (values {", ".join(f"('{w}')" for w in WANTED)}) q(query)),
    r as (select query, kind, id, row_number() over (partition by query order by kind, length(qualified), qualified, id) as rank from x where kind is not null) select query, rank, kind, id from r where rank <= 10""")
