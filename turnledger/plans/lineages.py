"""Queries on breaks, switches and cost along the lineage of requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators import ledger, lineage, usage
from turnledger.plans.registry import EVENT_ROWS, TTL, W, big
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}
#: A price list over the model names of the test tables, with a default (ord -1) that nobody has verified.
PRICE = "ord int, match string, input_price double, output_price double, cache_read double, cache_write_5m double, cache_write_1h double, verified boolean"
PRICES = [(0, "purch", 15.0, 75.0, 1.5, 18.75, 30.0, True), (1, "click", 3.0, 15.0, 0.3, 3.75, None, True), (-1, "", 1.0, 5.0, 0.1, 1.25, 2.0, False)]
SHARES = (0.5, 0.9, 0.95, 1.0)


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def pairs(s: SparkSession, d: str) -> DataFrame:
    rows = V.lineage_events(s, d)
    return lineage.with_ancestors(rows.filter("usage"), usage.lineage_parent(rows))


def breaks(s: SparkSession, d: str) -> DataFrame:
    return lineage.lineage_breaks(pairs(s, d), TTL)


ROWS = f"""recursive {EVENT_ROWS}, ev as (select event_id as id, event_type in ('click', 'view', 'purchase') as usage, event_type as model, k % 3 as version, ts, cast(floor(value) as bigint) as input, cast(floor(value * 1000) as bigint) as cache_read, k * 500 as cache_write, k as output, case when k % 4 <> 0 then k * 200 end as w5, case when k % 4 > 1 then k * 100 end as w1
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events)), r as (select e.id, session, boundary, parent, ev.* exclude (id) from event_rows e join ev using (id)),
    up(id, cur, crossed) as (select id, parent, false from r union all select up.id, c.parent, up.crossed or c.boundary from up join r c on up.cur = c.id where not c.usage),
    line as (select up.id, up.cur as ancestor, up.crossed from up left join r c on up.cur = c.id where up.cur is null or c.usage),
    own as (select *, lag(id) over (partition by session order by id) as latest from r where usage),
    pairs as (select own.*, p.id as ancestor, line.crossed, p.model as p_model, p.version as p_version, p.cache_read + p.cache_write as established, (epoch_us(own.ts) - epoch_us(p.ts)) / 6e7 as gap, p.id is not null and p.id is distinct from own.latest and own.latest is not null as fork,
        coalesce(p.cache_read + p.cache_write >= 20000 and own.cache_read < (p.cache_read + p.cache_write) * 0.5, false) as broke from own join line on own.id = line.id left join own p on p.id = line.ancestor)"""
BROKEN = f"""{ROWS}, x as (select *, coalesce(gap > {TTL}, false) as late, least(cache_write, greatest(0, established - cache_read)) as recache, list_filter([case when crossed then 'compaction' end, case when fork then 'fork' end, case when model is distinct from p_model then 'model_change' end, case when version is distinct from p_version then 'version_change' end, case when gap > {TTL} then 'ttl_expiration' end], lambda v: v is not null) as found from pairs where broke),
    y as (select *, case when len(found) > 0 then array_to_string(found, '+') else 'unknown' end as signals, coalesce(found[1], 'unknown') as cause from x),
    broken as (select session, id, signals, cause, cache_read < established * 0.15 as hard, cache_write as written, recache, cache_write - recache as fresh, case when cause = 'ttl_expiration' then 'unavoidable_ttl_idle' when cause = 'fork' then 'artifact_or_userfork' when cause in ('model_change', 'version_change') and late then 'unavoidable_ttl_coincident'
        when cause in ('model_change', 'version_change') then 'addressable_config' when cause = 'compaction' then 'compaction' else 'addressable_midwork' end as avoidability from y)"""
add("lineage_breaks", breaks, f"with {BROKEN} select * from broken")
for by in ("cause", "signals", "avoidability"):
    add(f"lineage_breaks_by_{by}", lambda s, d, by=by: lineage.break_summary(breaks(s, d), by), f"with {BROKEN} select {by}, count(*) as breaks, {big('sum(cast(hard as int))')} as hard_breaks, {big('sum(written)')} as written, {big('sum(recache)')} as recache, {big('sum(fresh)')} as fresh from broken group by 1")
add("lineage_gaps", lambda s, d: lineage.gap_shares(pairs(s, d)), f"with {ROWS}, g as (select cast(gap >= 1 as int) + cast(gap >= 5 as int) + cast(gap >= 60 as int) as bucket, count(*) as n from pairs where gap is not null group by 1) select bucket, n, round(100 * n / sum(n) over (), 4) as percent from g")
SWITCHED = f"""{ROWS}, sw as (select session, id, p_model as from_model, model as to_model, established, broke, established >= 20000 and not broke as warm, case when broke then least(cache_write, greatest(0, established - cache_read)) else 0 end as migrated, crossed, cast(gap >= 5 as int) + cast(gap >= 30 as int) + cast(gap >= 60 as int) as bucket from pairs where model <> p_model)"""
add("switch_matrix", lambda s, d: lineage.switch_matrix(lineage.switches(pairs(s, d))), f"""with {SWITCHED} select from_model, to_model, count(*) as switches, count(*) filter (broke) as breaks, count(*) filter (warm) as warm_returns, {big("sum(migrated)")} as migrated, count(*) filter (established >= 100000) as from_100k, count(*) filter (established >= 400000) as from_400k, count(*) filter (crossed) as near_compaction,
    {", ".join(f"count(*) filter (bucket = {k}) as gap_{k}" for k in range(4))}, count(*) filter (bucket is null) as gap_unknown from sw group by all""")
add("switch_percentiles", lambda s, d: lineage.nearest_ranks(lineage.switches(pairs(s, d)), "established", SHARES), f"""with {SWITCHED}, v as (select list(established order by established, id) as l from sw), p as (select unnest([{", ".join(map(str, SHARES))}]::double[]) as share) select share, l[least(len(l) - 1, cast(floor(share * len(l)) as bigint)) + 1] as value from p, v""")
add("costed_ledger", lambda s, d: lineage.costed_ledger(V.lineage_events(s, d).filter("usage"), s.createDataFrame(PRICES, PRICE)), f"""with {ROWS}, g as (select model, count(*) as requests, {", ".join(f"{big(f'sum(coalesce({c}, 0))')} as {n}" for c, n in (("input", "input"), ("cache_read", "cache_read"), ("cache_write", "cache_write"), ("output", "output"), ("w5", "cache_write_5m"), ("w1", "cache_write_1h")))} from own group by 1),
    p as (select *, case when contains(model, 'purch') then [15.0, 75, 1.5, 18.75, 30] when contains(model, 'click') then [3.0, 15, 0.3, 3.75, 3.75] else [1.0, 5, 0.1, 1.25, 2] end::double[] as c, contains(model, 'purch') or contains(model, 'click') as verified from g),
    k as (select *, (input * c[1] + cache_read * c[3] + output * c[2] + cache_write * c[5]) / 1e6 as cost, (input * c[1] + cache_read * c[3] + output * c[2] + cache_write_5m * c[4] + (cache_write - cache_write_5m) * c[5]) / 1e6 as tier_cost from p)
    select model, {", ".join(f"{big(f'sum({c})')} as {c}" for c in ("requests", "input", "cache_read", "cache_write", "output", "cache_write_5m", "cache_write_1h"))}, {big("sum(input + cache_read + cache_write)")} as occupancy, round(sum(cost), 6) as cost, round(sum(tier_cost), 6) as tier_cost, bool_and(verified) as verified, grouping(model) = 1 as overall from k group by grouping sets ((model), ())""")


def compacted(s: SparkSession, d: str) -> DataFrame:
    return ledger.cache_breaks(V.compacted_requests(s, d), ttl_minutes=TTL)


COMPACTED = f"""{W["requests"]}, c0 as (select *, sum(cast(model = 'signup' as int)) over (partition by session order by turn) as seen from requests), c1 as (select *, seen - coalesce(lag(seen) over w, 0) as compactions, lag(cache_read) over w + lag(cache_write) over w as before, lag(model) over w as p_model, lag(version) over w as p_version, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 6e7 as gap_minutes from c0 where model <> 'signup' window w as (partition by session order by turn)),
    broke as (select session, id, turn, before - cache_read as lost, cache_read < before * 0.15 as hard, case when compactions > 0 then 'compaction' when model <> p_model then 'model' when version <> p_version then 'version' when gap_minutes > {TTL} then 'ttl' else 'unknown' end as cause, cache_write from c1 where before >= 20000 and cache_read < before * 0.5)"""
add("compaction_breaks", lambda s, d: compacted(s, d).select("session", "id", "turn", "lost", "hard", "cause"), f"with {COMPACTED} select session, id, turn, lost, hard, cause from broke")
add("compaction_breaks_by_cause", lambda s, d: ledger.breaks_by_cause(compacted(s, d)), f"with {COMPACTED} select cause, count(*) as breaks, {big('sum(cast(hard as int))')} as hard_breaks, {big('sum(lost)')} as lost, {big('sum(cache_write)')} as rewritten from broke group by cause")
