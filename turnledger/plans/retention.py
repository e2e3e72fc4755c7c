"""Queries on kept contents, relief of retirement and the batch twins of the streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators import compaction, content, retirement
from turnledger.plans.registry import OBSOLETE, SQL_SECRETS, SQL_VALUE, W, big, obsolete
from turnledger.sources import driver_views as V
from turnledger.streaming import events as live

Q: dict[str, tuple] = {}
#: Seconds between the deliveries of the test outputs, most contents and bytes kept in these queries.
SPACING, ROWS, BYTES = 1000, 60, 2000


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def redacted_sql(text: str) -> str:
    for label, pattern in SQL_SECRETS:
        text = f"regexp_replace({text}, '{pattern}', '[REDACTED:{label}]', 'g')"
    return f"regexp_replace({text}, '{SQL_VALUE}', '\\1\\2[REDACTED:env-secret]', 'g')"


def deliveries(s: SparkSession, d: str) -> DataFrame:
    """Documents as outputs that come one after the other; every value after "token = " stands on a line of its own."""
    return V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "token = ", "\ntoken = ").alias("text"), (F.col("doc_id") * SPACING).alias("at"))


def latest(s: SparkSession, d: str) -> int:
    return deliveries(s, d).agg(F.max("at")).first()[0] or 0


def kept(s: SparkSession, d: str) -> DataFrame:
    return content.stored_contents(deliveries(s, d), latest(s, d), most_rows=ROWS, most_bytes=BYTES)


KEPT = f"""sent as (select doc_id as id, regexp_replace(text, 'token = ', chr(10) || 'token = ', 'g') as text, doc_id * {SPACING} as "at" from documents), now as (select max("at") as t from sent), contents as (select substring(sha1(text), 1, 16) as hash, any_value(text) as text, min(id) as first_id, count(*) as holders, max("at") as created_at from sent group by 1),
    fresh as (select contents.*, row_number() over (order by created_at desc, hash) as k from contents, now where created_at >= t - 86400), newest as (select * from fresh where k <= {ROWS}),
    cut as (select *, octet_length(encode(text)) as full_bytes, octet_length(encode(text)) > {BYTES} as truncated, case when octet_length(encode(text)) > {BYTES} then left(text, cast(list_max(list_filter(range({BYTES // 4}, {BYTES} + 1), lambda k: octet_length(encode(left(text, k))) <= {BYTES})) as int)) else text end as head from newest),
    kept as (select 'result://' || hash as handle, hash, first_id, holders, created_at, full_bytes, octet_length(encode({redacted_sql("head")})) as stored_bytes, truncated, {redacted_sql("head")} <> head as redacted, not truncated and {redacted_sql("head")} = text as exact, {redacted_sql("head")} as sample from cut)"""
add("stored_contents", lambda s, d: kept(s, d).withColumn("sample", F.sha2("sample", 256)), f"with {KEPT} select * replace (sha256(sample) as sample) from kept")


def asked(s: SparkSession, d: str) -> DataFrame:
    """Every delivery's handle, some of the other scheme, some broken."""
    scheme = F.when(F.col("id") % 3 == 0, content.SCHEMES[1]).when(F.col("id") % 7 == 0, "file://").otherwise(content.SCHEMES[0])
    return deliveries(s, d).select(F.concat(scheme, F.when(F.col("id") % 11 == 0, "gone").otherwise(content.content_hash(F.col("text")))).alias("handle"))


add("recovered_contents", lambda s, d: content.recovered(asked(s, d), kept(s, d), latest(s, d) + 40_000).withColumn("sample", F.sha2("sample", 256)), f"""with {KEPT}, a as (select case when id % 3 = 0 then 'ctx://blob/' when id % 7 = 0 then 'file://' else 'result://' end || case when id % 11 = 0 then 'gone' else substring(sha1(text), 1, 16) end as handle from sent), h as (select handle, regexp_extract(handle, '^(?:result://|ctx://blob/)(.*)$', 1) as hash from a),
    r as (select h.handle, case when h.hash = '' then 'unrecognized' when created_at is null then 'unknown' when t + 40000 - created_at > 86400 then 'expired' else 'found' end as status, t + 40000 - created_at as age_seconds, truncated, sample from h left join kept on h.hash = kept.hash, now)
    select handle, status, age_seconds, coalesce(status = 'found' and truncated, false) as bounded, case when status = 'found' then sha256(sample) end as sample from r""")


def decisions(s: SparkSession, d: str) -> DataFrame:
    o = deliveries(s, d).withColumn("kind", F.when(F.col("id") % 2 == 0, "file").otherwise("search"))
    lines = F.split("text", "\n")
    must = F.when(F.col("id") % 4 == 0, F.element_at(lines, (F.size(lines) / 2).cast("int") + 1)).otherwise(F.element_at(lines, 1))
    small = compaction.reduce_generic(o.filter("id % 13 <> 0"), 10).select("id", "reduced").join(o.select("id", must.alias("must")), "id")
    return content.reduction_decisions(o, small.select("id", "reduced", F.contains("reduced", F.col("must")).alias("invariants")), o.filter("id % 5 = 0"), floor=300, most_bytes=20_000)


add("reduction_decisions", decisions, f"""with sent as (select doc_id as id, regexp_replace(text, 'token = ', chr(10) || 'token = ', 'g') as text from documents), l as (select *, string_split(text, chr(10)) as ls from sent),
    r as (select *, case when id % 13 <> 0 then case when len(ls) > 20 then array_to_string(ls[1:10] || ['... ' || (len(ls) - 20) || ' lines omitted ...'] || ls[len(ls) - 9:], chr(10)) else text end end as reduced, case when id % 4 = 0 then ls[len(ls) // 2 + 1] else ls[1] end as must from l),
    q as (select id, length(text) // 4 as raw_tokens, length(reduced) // 4 as small, case when reduced is null then 'no_reducer' when length(text) // 4 < 300 then 'below_floor' when length(reduced) >= length(text) then 'not_smaller' when not contains(reduced, must) then 'invariant_lost' when octet_length(encode(text)) > 20000 then 'too_large'
        when len(regexp_extract_all({redacted_sql("text")}, '\\[REDACTED:')) - len(regexp_extract_all(text, '\\[REDACTED:')) > 0 then 'secret' when id % 2 = 0 and id % 5 = 0 then 'needed_by_edit' else 'reduce' end as decision from r)
    select id, decision, raw_tokens, case when decision = 'reduce' then small else raw_tokens end as shown_tokens from q""")


def relief(s: SparkSession, d: str, tail: bool) -> DataFrame:
    """Sessions are sources here, and so are their cache reads."""
    reads = V.table(s, d, "documents").select(F.col("source").alias("session"), (F.col("n_chars") * 3).alias("cache_read"))
    return retirement.retirement_relief(obsolete(s, d), reads, tail)


for tail in (False, True):
    goes = "coalesce(superseded_at, turn + 1)" if tail else "superseded_at"
    add(f"retirement_relief{'_with_tail' if tail else ''}", lambda s, d, tail=tail: relief(s, d, tail), f"""with {OBSOLETE}, o as (select *, {goes} as goes from obsolete), n as (select session, max(last_turn) as turns from o group by 1), t as (select session, unnest(range(1, turns + 1)) as t from n),
        curve as (select t.session, t, sum(case when least(turn, last_turn) <= t then size else 0 end) as resident, sum(case when goes is not null and least(goes, last_turn) <= t then size else 0 end) as relieved from t join o on t.session = o.session group by all),
        peaks as (select session, max(resident) as peak_resident, max(relieved) as peak_relief, sum(relieved) as relief from curve group by 1), g as (select session, count(*) as objects, count(goes) as retired, sum(case when goes is not null then size * greatest(0, last_turn - goes) else 0 end) as gross from o group by 1), c as (select source as session, sum(n_chars * 3) as cache_read from documents group by 1)
        select session, turns, objects, retired, {big("gross")} as gross, round(100 * gross / cache_read, 2) as percent_of_reads, {big("peak_resident")} as peak_resident, round(100 * peak_relief / peak_resident, 2) as peak_relief_percent, round(relief / turns, 4) as mean_relief from g join n using (session) join peaks using (session) left join c using (session)""")

START = "epoch_us(ts) // 60000000"
WINDOW = "select to_timestamp({start} * 60)::timestamp as start, model, count(*) as requests, {occupancy} as occupancy from ({rows}) group by all"
OCCUPANCY = big("sum(input + cache_read + cache_write)")
add("windowed_ledger", lambda s, d: live.live_ledger(V.requests(s, d), "6 hours"), f"with {W['requests']} " + WINDOW.format(start="w", occupancy=OCCUPANCY, rows=f"select *, {START} // 360 * 360 as w from requests"))
add("sliding_ledger", lambda s, d: live.live_ledger(V.requests(s, d), "6 hours", slide="2 hours"), f"with {W['requests']} " + WINDOW.format(start="w", occupancy=OCCUPANCY, rows=f"select *, {START} // 120 * 120 - 120 * unnest([0, 1, 2]) as w from requests"))
add("session_windows", lambda s, d: live.live_sessions(V.requests(s, d), "12 hours"), f"""with {W["requests"]}, g as (select *, lag(ts) over w as before from requests window w as (partition by session order by ts)), n as (select *, sum(case when before is null or ts >= before + interval 12 hours then 1 else 0 end) over (partition by session order by ts rows unbounded preceding) as k from g)
    select min(ts) as start, max(ts) + interval 12 hours as "end", session, count(*) as requests from n group by session, k""")
add("counter_windows", lambda s, d: live.counters(V.table(s, d, "events").select("ts", F.col("event_type").alias("metric")), "1 day").select(F.col("window.start").alias("start"), "metric", "count"), "select date_trunc('day', ts) as start, event_type as metric, count(*) as count from events group by all")


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as calls, and two of three of them with a result some minutes later."""
    e = V.table(s, d, "events").withColumn("k", V.number())
    pre = e.select(F.col("event_id").alias("tool_use_id"), "ts", F.when(F.col("k") % 7 != 0, (F.col("k") % 2).cast("string")).alias("digest"))
    post = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("tool_use_id"), (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, k)")).alias("ts"), F.when(F.col("k") % 5 != 0, (F.col("k") % 3).cast("string")).alias("digest"))
    return pre, post


add("paired_calls", lambda s, d: live.pair_pre_post(*sides(s, d)).select("call_id", "version_status"), """with e as (select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events), p as (select event_id, case when k % 7 <> 0 then k % 2 end as a, case when k % 5 <> 0 then k % 3 end as b, event_id % 3 = 0 or k > 60 as alone from e)
    select event_id as call_id, case when alone then 'pending' when a is null or b is null then 'unverified' when a = b then 'stable' else 'raced' end as version_status from p""")
