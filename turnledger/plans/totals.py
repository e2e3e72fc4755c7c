"""Queries on totals over sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.functions import commands as S
from turnledger.operators import compaction, evidence, ledger, retirement, totals, usage
from turnledger.plans import calls, code, replay
from turnledger.plans import registry as R
from turnledger.plans.registry import LABELS, LINES, W, big
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def rebuilt(s: SparkSession, d: str) -> DataFrame:
    """Requests with what the request before them held; some follow a compaction or a fork."""
    w = Window.partitionBy("session").orderBy("turn")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 6e7
    return V.requests(s, d).select("*", F.lag(F.col("cache_read") + F.col("cache_write")).over(w).alias("held"), F.lag("model").over(w).alias("p_model"), F.lag("version").over(w).alias("p_version"), gap.alias("gap_minutes"), (F.col("output") % 13 == 0).alias("crossed"), (F.col("output") % 11 == 0).alias("fork"))


add("avoidability", lambda s, d: totals.avoidability(rebuilt(s, d), ttl_minutes=720), f"""with {W["requests"]}, r as (select *, lag(cache_read + cache_write) over w as held, lag(model) over w as p_model, lag(version) over w as p_version, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 6e7 as gap from requests window w as (partition by session order by turn)),
    c as (select *, coalesce(gap > 720, false) as expired, least(cache_write, greatest(0, held - cache_read)) as recached, case when output % 13 = 0 then 'compaction' when output % 11 = 0 then 'fork' when model <> p_model then 'model_change' when version <> p_version then 'version_change' when gap > 720 then 'ttl_expiration' else 'unknown' end as cause from r where held >= 20000 and cache_read < 0.5 * held)
    select cause, case when cause = 'ttl_expiration' then 'unavoidable_ttl_idle' when cause = 'fork' then 'artifact_or_userfork' when cause in ('model_change', 'version_change') then case when expired then 'unavoidable_ttl_coincident' else 'addressable_config' end when cause = 'compaction' then 'compaction' else 'addressable_midwork' end as bucket, count(*) as rebuilds, {big("sum(recached)")} as recached, {big("sum(cache_write - recached)")} as fresh from c group by all""")


def tiers(s: SparkSession, d: str) -> DataFrame:
    base = ledger.match_price(V.requests(s, d), s.createDataFrame(R.PRICES, "ord int, match string, input_price double"))
    return base.select("model", F.col("input_price").alias("input"), (F.col("input_price") * 0.1).alias("cache_read"), (F.col("input_price") * 1.25).alias("cache_write"), (F.col("input_price") * 5).alias("output"))


TIERS = f"""{W["requests"]}, p as (select case when contains(model, 'purch') then 5.0::double when contains(model, 'c') then 3.0::double when contains(model, 'view') then 1.0::double else 2.0::double end as price from requests),
    tiers as (select round(avg(price), 6) as input, round(avg(price * 0.1::double), 6) as cache_read, round(avg(price * 1.25::double), 6) as cache_write, round(avg(price * 5), 6) as output from p)"""
add("tier_prices", lambda s, d: totals.tier_prices(V.requests(s, d), tiers(s, d)), f"with {TIERS} select * from tiers")
add("addressable_cost", lambda s, d: totals.addressable_cost(ledger.duplicate_of(V.tool_outputs(s, d)).withColumn("token_turns", F.col("tokens") * 7), usage.stale_results(V.calls(s, d)), totals.tier_prices(V.requests(s, d), tiers(s, d))), f"""with {R.DUPES}, {TIERS}, {R.STALE}, n as (select *, lead(hash) over w as next_hash, lead(turn) over w as stale_from from calls window w as (partition by session, args order by turn)),
    a as (select {big("coalesce(sum(tokens), 0)")} as repeated, {big("coalesce(sum(tokens * 7), 0)")} as repeated_turns from dupes), b as (select {big("coalesce(sum(tokens * (last_turn - stale_from)), 0)")} as stale_turns from n join lastt using (session) where next_hash <> hash)
    select repeated, repeated_turns, stale_turns, round((repeated * cache_write + greatest(0, repeated_turns - repeated) * cache_read) / 1e6, 6) as repeat_cost, round(stale_turns * cache_read / 1e6, 6) as stale_cost, round((repeated * cache_write + greatest(0, repeated_turns - repeated) * cache_read) / 1e6 + stale_turns * cache_read / 1e6, 6) as addressable_cost from a, b, tiers""")
CLASS = "case doc_id % 4 when 0 then 'shell_test' when 1 then 'shell_file_dump' when 2 then 'search_tool' else 'other' end"
add("result_pools", lambda s, d: totals.result_pools(V.table(s, d, "documents").select(F.expr(CLASS).alias("class"), F.floor(F.length("text") / 4).alias("tokens"), "text", F.col("text").contains("token").alias("failed"))), f"""with x as (select {CLASS} as class, {big("floor(length(text) / 4)")} as tokens, contains(text, 'token') as failed, string_split(text, chr(10)) as ls from documents),
    y as (select case when class = 'shell_test' and tokens > 400 and not failed then 'passing_test_verbosity' when class = 'shell_file_dump' then 'bash_file_dump' when class = 'search_tool' and tokens > 800 then 'oversized_search_dump' end as pool, case when class = 'shell_test' then greatest(0, tokens - {big("floor(length(array_to_string(ls[greatest(len(ls) - 14, 1):], chr(10))) / 4)")}) else tokens end as spare from x)
    select pool, count(*) as results, {big("sum(spare)")} as tokens from y where pool is not null group by 1""")
add("ceiling_summary", lambda s, d: totals.ceiling_summary(R.read_labels(s, d).withColumn("stratum", F.col("session") % 5)), f"""with {LABELS}, r as (select "window", session, session % 5 as stratum, tokens, kind, class = 'exploration' or (kind = 'broad' and reason = 'search_result') as free from labels_, (values ('safe'), ('broad')) k(kind)),
    a as (select "window", kind, session, sum(case when free then tokens else 0 end) / nullif(sum(tokens), 0) as share from r group by all), b as (select "window", kind, stratum, sum(case when free then tokens else 0 end) / nullif(sum(tokens), 0) as share from r group by all),
    m as (select "window", kind, round(sum(case when free then tokens else 0 end) / nullif(sum(tokens), 0), 4) as micro from r group by all), t as (select "window", kind, round(avg(share), 4) as stratum_mean from b group by all),
    s as (select "window", kind, count(share) as sessions, round(avg(share), 4) as macro_mean, round(quantile_cont(share, 0.25), 4) as p25, round(quantile_cont(share, 0.5), 4) as macro_median, round(quantile_cont(share, 0.75), 4) as p75, count(*) filter (share > 0.1) as above_10, count(*) filter (share > 0.2) as above_20 from a group by all)
    select * from m join s using ("window", kind) join t using ("window", kind)""")
add("last_touch_ceiling", lambda s, d: totals.last_touch_ceiling(V.tool_events(s, d)), f"""with {W["tool_events"]}, f as (select session, path, max(tokens) filter (kind = 'read') as size, max(step) as last from tool_events where path is not null group by all), e as (select session, greatest(max(step), 1) as last_step from tool_events group by 1)
    select session, count(*) as files, {big("floor(sum(size * greatest(last_step - last, 0)) * 80 / 100)")} as gross_saving from f join e using (session) where size is not null group by 1""")


def outputs_by_turn(s: SparkSession, d: str) -> DataFrame:
    o = V.context_objects(s, d)
    t = V.table(s, d, "documents").select(F.col("doc_id").alias("pos"), F.regexp_replace("text", "reserved", "3 passed").alias("t"))
    return o.join(t, "pos").select(F.col("pos").alias("id"), "session", "turn", F.max("turn").over(Window.partitionBy("session")).alias("last_turn"), F.col("size").alias("tokens"), S.is_test_like(F.col("t")).alias("test_like"))


add("output_ceiling", lambda s, d: totals.output_ceiling(outputs_by_turn(s, d), compaction.reduce_tests(V.tool_outputs(s, d), "(?i)\\btoken\\b", "(?i)\\b(license|reserved)\\b").select("id", F.floor(F.length("reduced") / 4).alias("small"))), f"""with {W["context_objects"]}, {W["tool_outputs"]}, {LINES}, m as (select *, regexp_matches(line, '(?i)\\btoken\\b') as failed from tlines where regexp_matches(line, '(?i)\\b(token|license|reserved)\\b')),
    b as (select *, row_number() over (partition by id, failed order by pos desc) as back, bool_or(failed) over (partition by id) as any_failed from m), g as (select id, line, min(pos) as rank from b where failed or back <= case when any_failed then 3 else 1 end group by all),
    s as (select id, {big("floor(length(string_agg(line, chr(10) order by rank)) / 4)")} as small from g group by id), o as (select c.session, c.turn, max(c.turn) over (partition by c.session) as last_turn, c.size as tokens, contains(text, 'reserved') as test_like, small from context_objects c join tool_outputs t on c.pos = t.id left join s on s.id = c.pos),
    q as (select *, test_like and tokens >= 200 as fits, coalesce(test_like and tokens >= 200 and small < tokens, false) as fired from o)
    select session, {big("sum(tokens)")} as tokens, {big("sum(case when fits then tokens else 0 end)")} as test_tokens, count(*) filter (fired) as fired, {big("sum(case when fired then (tokens - small) * greatest(last_turn - turn, 0) else 0 end)")} as saving from q group by session""")


def captured(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    e = V.table(s, d, "events").withColumn("k", V.number())
    return e.select(F.col("user_id").alias("session"), (k % 50 != 1).alias("seen"), (k % 50 != 2).alias("resolved"), (k == 3).alias("error"), (k == 4).alias("pending"), (k % 2 == 0).alias("shell"), (k % 10 != 0).alias("known"), F.when(k != 5, k).alias("step"), F.when(k != 6, k).alias("tokens"), F.when(k % 3 == 0, "edit").otherwise("read").alias("kind"))


CAPTURED = f"""cap as (select user_id as session, {calls.K} as k from events), integrity as (select session, count(*) as deliveries, count(*) filter (k = 3) as errors, count(*) filter (k % 50 <> 1) as seen_calls, count(*) filter (k % 50 <> 2) as resolved_calls, count(*) filter (k = 4) as pending, count(*) filter (k % 2 = 0) as shell_calls, count(*) filter (k % 10 = 0) as unknown_shell,
    count(*) filter (k = 5) as missing_steps, count(*) filter (k = 6 and k % 3 <> 0) as unmeasured_reads from cap group by 1)"""
add("integrity", lambda s, d: totals.integrity(captured(s, d)), f"with {CAPTURED} select *, round(1 - errors / deliveries, 4) as delivery_success, round(unknown_shell / nullif(shell_calls, 0), 4) as unknown_share from integrity")
add("admission", lambda s, d: totals.admission(totals.integrity(captured(s, d))), f"""with {CAPTURED}, a as (select session, seen_calls = resolved_calls as pre_equals_batch, errors = 0 as zero_errors, pending = 0 as zero_pending, missing_steps = 0 as steps_complete, unknown_shell = 0 as shell_clean, unmeasured_reads = 0 as token_share_eligible from integrity)
    select *, pre_equals_batch and zero_errors and zero_pending and steps_complete as admissible from a""")
add("edge_report", lambda s, d: totals.edge_report(code.dependencies(s, d)), f"with {code.DEPENDS} select type, match, count(*) as edges, round(avg(confidence), 3) as mean_confidence from dep group by grouping sets ((type, match), (type), ())")
add("session_rollup", lambda s, d: totals.session_rollup(V.requests(s, d).groupBy("session").agg(F.count("*").alias("requests"), F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write")).alias("tokens")).select(F.concat(F.lit("p"), (F.col("session") % 7).cast("string")).alias("project"), F.when(F.col("session") % 3 == 0, "subagent").otherwise("session").alias("kind"), "requests", "tokens")), f"""with {W["requests"]}, g as (select session, count(*) as requests, {big("sum(input + cache_read + cache_write)")} as tokens from requests group by 1)
    select 'p' || (session % 7) as project, case when session % 3 = 0 then 'subagent' else 'session' end as kind, count(*) as sessions, {big("sum(requests)")} as requests, {big("sum(tokens)")} as tokens from g group by grouping sets ((project), (kind), ())""")
add("lag_table", lambda s, d: totals.lag_table(evidence.staleness_safety(V.context_objects(s, d), V.mentions(s, d))), f"""with s as ({R.Q["staleness_safety"][1]}) select lag, count(*) as sessions, {big("sum(n_retired)")} as retired, {big("sum(n_safe)")} as safe, {big("sum(tail_gross)")} as gross, {big("sum(safe_gross)")} as safe_gross, round(sum(n_safe) / sum(n_retired), 4) as safe_share, round(sum(safe_gross) / nullif(sum(tail_gross), 0), 4) as safe_gross_share from s group by lag""")
add("overlap_table", lambda s, d: totals.overlap_table(retirement.deferral(replay.window_reads(s, d), replay.retired(s, d), replay.THRESHOLDS)), f"""with s as ({replay.Q["deferral"][1]}) select threshold, count(*) as crossings, count(*) filter (avoided) as avoided, round(avg(deferral), 4) as mean_deferral from s group by 1""")
add("token_turns_by_kind", lambda s, d: ledger.token_turns(ledger.residency_horizon(calls.transcripts.context_objects(calls.blocks(s, d)).withColumn("kind", C.tool_kind(F.col("tool"))["kind"]), calls.transcripts.context_objects(calls.blocks(s, d)).filter("false").select("session", "turn")), "kind"), f"""with {calls.CALLS}, o as (select *, max(turn) over (partition by session) as last_turn, case when tool = 'Read' then 'source_slice' when tool in ('Grep', 'Glob') then 'search_result' when tool = 'Bash' then 'log' else 'tool_result' end as kind from objects)
    select kind, count(*) as objects, {big("sum(size)")} as tokens, {big("sum(size * greatest(1, last_turn - turn + 1))")} as token_turns from o group by 1""")
add("size_histogram", lambda s, d: V.context_objects(s, d).groupBy(C.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("objects"), F.sum("size").alias("tokens")), f"with {W['context_objects']} select case when size < 250 then '<250' when size < 500 then '250-500' when size < 1000 then '500-1000' when size < 2000 then '1000-2000' else '>=2000' end as bucket, count(*) as objects, {big('sum(size)')} as tokens from context_objects group by 1")
add("merge_sources", lambda s, d: totals.merge_first(V.table(s, d, "documents").filter("doc_id % 2 = 0").groupBy(F.sha1("text").alias("hash")).agg(F.lit("old").alias("batch")), V.table(s, d, "documents").filter("doc_id % 2 = 1").select(F.sha1("text").alias("hash"), F.lit("new").alias("batch")), "hash"), "select sha1(text) as hash, case when bool_or(doc_id % 2 = 0) then 'old' else 'new' end as batch from documents group by 1")
add("merge_requests", lambda s, d: totals.merge_last(V.requests(s, d).select("session", F.col("model").alias("request"), "turn", "input").filter("turn % 2 = 0"), V.requests(s, d).select("session", F.col("model").alias("request"), "turn", "input").filter("turn % 2 = 1"), "turn", "session", "request"), f"with {W['requests']} select session, model as request, max(turn) as turn, max_by(input, turn) as input from requests group by all")
add("eligible_reads", lambda s, d: totals.eligible_reads(V.tool_events(s, d).withColumn("path", F.when(F.col("seq") % 97 != 0, F.col("path")))), f"""with {W["tool_events"]}, e as (select seq, session, kind, case when seq % 97 <> 0 then path end as path from tool_events) select seq, session, path from e where kind = 'read' and path is not null and not exists (select 1 from e x where x.kind = 'edit' and x.session = e.session and (x.path is null or x.path = e.path))""")
add("top_repeats", lambda s, d: totals.top_repeats(V.table(s, d, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("bigint").alias("tokens")), 5), f"""with g as (select l_suppkey as session, l_partkey as item, {big("sum(cast(l_quantity as bigint))")} as tokens from lineitem group by all), r as (select *, row_number() over (partition by session order by tokens desc, item) as rank from g)
    select item, {big("sum(tokens)")} as tokens, count(*) as sessions from r where rank <= 5 group by item order by tokens desc, item limit 12""")
