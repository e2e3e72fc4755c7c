"""Registered queries of the session-log operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators import compaction, evidence, graph, labels, ledger, reduction, retirement, runs, usage
from turnledger.sources import driver_views as V

TTL = 720
WINDOWS = (1, 2, 4, 1_000_000_000)
GRID = [(62, 244), (62, 400), (128, 244), (128, 400), (244, 400), (244, 244)]
#: An ordered price list over the model names of the test tables; ord -1 is the default.
PRICES = [(0, "purch", 5.0), (1, "c", 3.0), (2, "view", 1.0), (-1, "", 2.0)]

WANTED = ["widget", "Brand#13", "Brand#5.small widget.1", "1"]


def breaks(s: SparkSession, d: str) -> DataFrame:
    return ledger.cache_breaks(V.requests(s, d), ttl_minutes=TTL)


def object_breaks(s: SparkSession, d: str) -> DataFrame:
    """Boundaries of the document sessions: every tenth turn."""
    return V.context_objects(s, d).filter("turn % 10 = 0").select("session", "turn")


def horizons(s: SparkSession, d: str) -> DataFrame:
    o = V.context_objects(s, d)
    return ledger.residency_horizon(o, object_breaks(s, d))


def read_labels(s: SparkSession, d: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    return labels.classify_reads(V.tool_events(s, d), windows)


def obsolete(s: SparkSession, d: str) -> DataFrame:
    return retirement.obsolescence(V.context_objects(s, d))


def run_table(s: SparkSession, d: str) -> DataFrame:
    docs, marks = V.table(s, d, "documents"), V.table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("resolved"))
    return docs.join(marks, "doc_id", "left").select(F.col("lang").alias("stratum"), F.concat(F.lit("arm"), (F.col("doc_id") % 3).cast("string")).alias("arm"), F.col("n_chars").alias("total"), "resolved")


def weighted(s: SparkSession, d: str) -> DataFrame:
    return V.code_edges(s, d).withColumn("weight", F.when(F.col("type") == "CONTAINS", 0.5).otherwise(1.0))


def nodes(s: SparkSession, names: list[str]) -> DataFrame:
    return s.createDataFrame([(n,) for n in names], "node string")


def baskets(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


def symbols(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("qualified"), F.concat_ws("/", "p_brand", "p_type").alias("short"))


def references(s: SparkSession, d: str) -> DataFrame:
    p = V.table(s, d, "part")
    exact = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("src"), F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return exact.unionByName(p.filter("p_partkey % 3 = 1").select(F.col("p_partkey").alias("src"), F.concat_ws("/", "p_brand", "p_type").alias("name"))).unionByName(p.filter("p_partkey % 3 = 2").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("name")))


def paths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    whole = V.table(s, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct()
    tails = V.table(s, d, "pages").select(F.regexp_extract("url", "/([a-z]+/[0-9]+)$", 1).alias("path")).filter("path <> ''").distinct()
    return whole, tails


def redacted(s: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("text", "token = ", "\ntoken = ")
    return V.table(s, d, "documents").select("doc_id", C.redactions(text).cast("bigint").alias("redactions"), F.sha2(C.redact(text), 256).alias("redacted_sha256"))


def layers(s: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """Parts by size, by the line they are first ordered in, and by availability."""
    size = V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("rank"))
    ordered = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_linenumber").alias("rank"))
    return [("size", size), ("ordered", ordered), ("quantity", V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(F.col("l_quantity").cast("bigint")).alias("rank")))]


def sha(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.sha2("reduced", 256).alias("reduced_sha256"), *more)


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
W = {k: f"{k} as ({v})" for k, v in V.SQL.items()}
BREAKS = f"""{W["requests"]}, b0 as (select *, lag(cache_read) over w + lag(cache_write) over w as before, lag(model) over w as p_model, lag(version) over w as p_version, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 6e7 as gap_minutes
    from requests window w as (partition by session order by turn)),
    breaks as (select session, id, turn, before - cache_read as lost, cache_read < before * 0.15 as hard, case when model <> p_model then 'model' when version <> p_version then 'version' when gap_minutes > {TTL} then 'ttl' else 'unknown' end as cause, gap_minutes, cache_write
    from b0 where before >= 20000 and cache_read < before * 0.5)"""


def labels_sql(config: str = "false") -> str:
    """Labels of reads; ``config``: whether a path is configuration."""
    return f"""{W["tool_events"]}, e1 as (select * from tool_events where path is not null and (kind = 'edit' or success)),
    e2 as (select *, lead(case when kind = 'edit' then seq end ignore nulls) over w as l_seq, lead(case when kind = 'edit' then step end ignore nulls) over w as l_step,
        lead(case when kind = 'edit' then coalesce(version, '') end ignore nulls) over w as l_version, lead(case when kind = 'edit' then coalesce(batch, -1) end ignore nulls) over w as l_batch, lead(case when kind = 'edit' then status end ignore nulls) over w as l_status,
        lag(case when kind = 'edit' then seq end ignore nulls) over w as e_seq, lag(case when kind = 'edit' then status end ignore nulls) over w as e_status, lag(case when kind = 'edit' then step end ignore nulls) over w as e_step from e1 window w as (partition by stream, path order by seq)),
    e3 as (select e2.*, x.w as "window", l_step - step as distance from e2, (values {", ".join(f"({w})" for w in WINDOWS)}) x(w) where kind = 'read'),
    e4 as (select *, case when representation = 'search' then 'search_result' when status = 'raced' then 'raced' when l_seq is null and abs(step - e_step) <= "window" and e_status = 'unverified' then 'prior_edit_unverified'
        when l_seq is null and abs(step - e_step) <= "window" then 'read_after_edit' when l_seq is null and {config} then 'config_path' when l_seq is null then 'never_edited' when l_status = 'unverified' then 'unverified_version' when batch = l_batch then 'same_batch'
        when version <> nullif(l_version, '') then 'version_conflict' when abs(distance) > "window" then 'outside_window' else 'candidate' end as r0 from e3),
    e5 as (select *, case when r0 <> 'candidate' then r0 when row_number() over (partition by stream, path, "window", l_seq, r0 = 'candidate' order by seq desc) = 1 then 'latest_eligible_read' else 'superseded_by_later_read' end as reason from e4),
    labels_ as (select seq, session, stream, path, step, tokens, l_seq as edit_seq, "window", case reason when 'latest_eligible_read' then 'precondition' when 'read_after_edit' then 'verification' when 'never_edited' then 'exploration' when 'config_path' then 'config' else 'unknown' end as class, reason, distance from e5)"""


LABELS = labels_sql()
HORIZON = f"""{W["context_objects"]}, bounds as (select session, turn from context_objects where turn % 10 = 0), lastt as (select session, max(turn) as last_turn from context_objects group by session),
    horizons as (select o.*, coalesce((select min(b.turn) from bounds b where b.session = o.session and b.turn > o.turn) - 1, l.last_turn) as exit_turn from context_objects o join lastt l using (session))"""
OBSOLETE = f"""{W["context_objects"]}, obsolete as (select *, lead(turn) over (partition by session, key order by pos) as superseded_at, max(turn) over (partition by session) as last_turn from context_objects)"""
LINES = "tl as (select id, ls, unnest(range(1, len(ls) + 1)) as i from (select id, string_split(text, chr(10)) as ls from tool_outputs)), tlines as (select id, i - 1 as pos, ls[i] as line from tl)"
RUNS = "run_table as (select d.lang as stratum, 'arm' || (d.doc_id % 3) as arm, d.n_chars as total, l.quality = 1 as resolved from documents d left join labels l using (doc_id))"
EDGES = W["code_edges"]


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    Q[name] = (query, sql)


def big(x: str) -> str:
    return f"cast({x} as bigint)"


add("occupancy_ledger", lambda s, d: ledger.occupancy_ledger(V.requests(s, d)), f"""with {W["requests"]}, g as (select model, count(*) as requests, {big("sum(input)")} as input, {big("sum(cache_read)")} as cache_read, {big("sum(cache_write)")} as cache_write, {big("sum(output)")} as output from requests group by model)
    select *, input + cache_read + cache_write as occupancy from g""")
add("cache_breaks", lambda s, d: breaks(s, d).select("session", "id", "turn", "lost", "hard", "cause"), f"with {BREAKS} select session, id, turn, lost, hard, cause from breaks")
add("breaks_by_cause", lambda s, d: ledger.breaks_by_cause(breaks(s, d)), f"with {BREAKS} select cause, count(*) as breaks, {big('sum(cast(hard as int))')} as hard_breaks, {big('sum(lost)')} as lost, {big('sum(cache_write)')} as rewritten from breaks group by cause")
add("cache_islands", lambda s, d: ledger.cache_islands(V.requests(s, d), breaks(s, d)), f"""with {BREAKS}, i as (select r.*, {big("sum(case when b.id is not null then 1 else 0 end) over (partition by r.session order by r.turn)")} as island from requests r left join breaks b on r.session = b.session and r.id = b.id)
    select session, island, min(turn) as first_turn, max(turn) as last_turn, count(*) as requests, {big("sum(cache_write)")} as written from i group by session, island""")
add("model_switches", lambda s, d: ledger.model_switches(V.requests(s, d)), f"""with {W["requests"]}, p as (select *, lag(model) over w as p_model, lag(cache_read + cache_write) over w as moved from requests window w as (partition by session order by turn))
    select p_model as from_model, model as to_model, count(*) as switches, {big("sum(moved)")} as migrated, {big("sum(case when moved >= 100000 then 1 else 0 end)")} as large from p where p_model <> model group by p_model, model""")
add("gap_histogram", lambda s, d: ledger.gap_histogram(V.requests(s, d), C.gap_bucket), f"""with {W["requests"]}, g as (select (epoch_us(ts) - epoch_us(lag(ts) over (partition by session order by turn))) / 6e7 as gap from requests)
    select case when gap < 5 then '<5m' when gap < 60 then '5-60m' when gap < 720 then '1-12h' else '>=12h' end as bucket, count(*) as n from g where gap is not null group by 1""")
add("price_match", lambda s, d: ledger.match_price(V.requests(s, d), s.createDataFrame(PRICES, "ord int, match string, input_price double")), f"""with {W["requests"]}, p(ord, match, input_price) as (values {", ".join(f"({o}, '{m}', {x})" for o, m, x in PRICES)}), m as (select distinct model from requests)
    select model, (select match from p where ord >= 0 and contains(model, match) order by ord limit 1) as match, cast(coalesce((select input_price from p where ord >= 0 and contains(model, match) order by ord limit 1), (select input_price from p where ord < 0)) as double) as input_price from m""")
add("residency_horizon", lambda s, d: horizons(s, d).select("session", "pos", "turn", "exit_turn"), f"with {HORIZON} select session, pos, turn, exit_turn from horizons")
add("token_turns_by_key", lambda s, d: ledger.token_turns(horizons(s, d), "key"), f"with {HORIZON} select key, count(*) as objects, {big('sum(size)')} as tokens, {big('sum(size * greatest(1, exit_turn - turn + 1))')} as token_turns from horizons group by key")
DUPES = f"""{W["tool_outputs"]}, h as (select *, substring(sha1(text), 1, 16) as hash from tool_outputs), f as (select session, hash, min(id) as first_id from h group by session, hash having count(*) > 1),
    dupes as (select h.session, h.id, f.first_id, h.hash, {big("floor(length(h.text) / 4)")} as tokens from h join f on h.session = f.session and h.hash = f.hash where h.id > f.first_id)"""
add("merge_objects", lambda s, d: ledger.merge_objects(V.context_objects(s, d).filter("pos % 2 = 0").select("session", "key", "turn"), V.context_objects(s, d).filter("pos % 2 = 1").select("session", "key", "turn")), f"with {W['context_objects']} select session, key, min(turn) as first_seen, max(turn) as last_seen, count(*) as n from context_objects group by session, key")
add("read_labels", lambda s, d: read_labels(s, d), f"with {LABELS} select * from labels_")
add("label_distribution", lambda s, d: labels.label_distribution(read_labels(s, d)), f'with {LABELS} select "window", class, reason, count(*) as reads, {big("sum(tokens)")} as tokens from labels_ group by all')
add("window_sensitivity", lambda s, d: labels.window_sensitivity(read_labels(s, d), 2), f'with {LABELS} select a."window", b.class as from_class, a.class as to_class, count(*) as reads from labels_ a join labels_ b on a.seq = b.seq and b."window" = 2 where a."window" <> 2 group by all')
add("stable_preconditions", lambda s, d: labels.stable_preconditions(read_labels(s, d), len(WINDOWS)), f"with {LABELS} select seq from labels_ where class = 'precondition' group by seq having count(distinct \"window\") = {len(WINDOWS)}")
add("causal_distance", lambda s, d: labels.causal_distance(read_labels(s, d)), f"""with {LABELS} select "window", count(*) as links, round(quantile_cont(distance, 0.5), 4) as p50, round(quantile_cont(distance, 0.9), 4) as p90, round(quantile_cont(distance, 0.95), 4) as p95, max(distance) as longest from labels_ where class = 'precondition' group by "window" """)
CLOSED = f"closed_ as (select stream, epoch, events, epoch < max(epoch) over (partition by session) as closed from (select session, stream, cast(split_part(stream, ':', 3) as bigint) as epoch, count(*) as events from tool_events group by all))"
add("closed_streams", lambda s, d: labels.closed_streams(V.tool_events(s, d)), f"with {W['tool_events']}, {CLOSED} select * from closed_")
add("censoring_bounds", lambda s, d: labels.censoring_bounds(read_labels(s, d), labels.closed_streams(V.tool_events(s, d))), f"""with {LABELS}, {CLOSED} select "window", count(*) filter (class = 'exploration' and closed) as floor_reads, count(*) filter (class = 'exploration') as after_reads,
    count(*) filter (class = 'exploration' or (not closed and class = 'unknown')) as before_reads, count(*) as reads from labels_ join closed_ using (stream) group by "window" """)
add("opportunity_ceiling", lambda s, d: labels.opportunity_ceiling(read_labels(s, d)), f"""with {LABELS}, g as (select "window", session, sum(tokens) as tokens, sum(case when class = 'exploration' then tokens else 0 end) as free from labels_ group by all), h as (select *, 100 * free / nullif(tokens, 0) as share from g)
    select "window", count(*) as sessions, round(100 * sum(free) / sum(tokens), 4) as micro, round(avg(share), 4) as macro_mean, round(quantile_cont(share, 0.5), 4) as macro_median, count(*) filter (share > 10) as above_10 from h group by "window" """)
add("bypass_rate", lambda s, d: labels.bypass_rate(read_labels(s, d)), f"with {LABELS} select \"window\", path, count(*) as reads, {big('sum(tokens)')} as tokens from labels_ where class = 'exploration' group by all")
add("future_touches", lambda s, d: labels.future_touches(V.tool_events(s, d)), f"""with {W["tool_events"]} select a.stream, a.seq as search_seq, count(*) as touches, count(distinct b.path) as paths from tool_events a join tool_events b on a.stream = b.stream and b.seq > a.seq and b.seq <= a.seq + 50
    where a.representation = 'search' and b.representation <> 'search' group by all""")
add("capture_integrity", lambda s, d: labels.capture_integrity(V.tool_events(s, d)), f"with {W['tool_events']} select kind, count(*) as events, count(*) filter (success) as succeeded, count(*) filter (version is null) as unversioned, count(*) filter (status = 'raced') as raced, count(*) filter (batch is not null) as batched from tool_events group by kind")
add("obsolescence", lambda s, d: obsolete(s, d), f"with {OBSOLETE} select * from obsolete")
CEILING = f"""ceiling_ as (select session, count(*) as objects, {big("sum(size * greatest(0, last_turn - turn))")} as resident, {big("sum(case when superseded_at is not null then size * greatest(0, last_turn - superseded_at) else 0 end)")} as provable,
    {big("sum(case when superseded_at is not null then size * greatest(0, last_turn - superseded_at) else size * greatest(0, last_turn - turn - 1) end)")} as with_tail from obsolete group by session)"""
add("retirement_ceiling", lambda s, d: retirement.retirement_ceiling(obsolete(s, d)), f"with {OBSOLETE}, {CEILING} select * from ceiling_")
add("batched_retirement", lambda s, d: retirement.batched_retirement(obsolete(s, d)), f"""with {OBSOLETE}, o as (select *, case when superseded_at is not null then least(last_turn, greatest(10, {big("ceil(superseded_at / 10) * 10")})) end as batch from obsolete),
    g as (select session, {big("sum(size * (last_turn - batch))")} as gross from o where batch is not null group by session), f as (select session, batch, min(turn) as from_turn from o where batch is not null group by all),
    x as (select f.session, {big("sum(o.size)")} as rewritten from f join o on f.session = o.session where o.turn > f.from_turn and o.turn <= f.batch and (o.batch is null or o.batch > f.batch) group by f.session)
    select g.session, gross, coalesce(rewritten, 0) as rewritten from g left join x using (session)""")
add("turn_buckets", lambda s, d: retirement.turn_buckets(retirement.retirement_ceiling(obsolete(s, d))), f"with {OBSOLETE}, {CEILING} select cast(objects >= 40 as int) + cast(objects >= 60 as int) + cast(objects >= 100 as int) as bucket, count(*) as sessions, round(avg(100 * provable / nullif(resident, 0)), 4) as provable_share from ceiling_ group by 1")
CUMULATIVE = f"""cum as (select session, superseded_at as turn, {big("sum(size)")} as retired from obsolete where superseded_at is not null group by all), cumulative as (select *, {big("sum(retired) over (partition by session order by turn)")} as retired_so_far from cum)"""
add("retired_cumulative", lambda s, d: retirement.retired_cumulative(obsolete(s, d)), f"with {OBSOLETE}, {CUMULATIVE} select * from cumulative")
add("first_crossing", lambda s, d: retirement.first_crossing(retirement.retired_cumulative(obsolete(s, d))), f"with {OBSOLETE}, {CUMULATIVE} select session, t.threshold, min(turn) as turn from cumulative, (values (1000), (5000), (20000)) t(threshold) where retired_so_far > t.threshold group by all")
REDACT = "regexp_replace(text, 'token = ', chr(10) || 'token = ', 'g')"
#: The same nine patterns and labels as text of the SQL.
SQL_SECRETS = (
    ("aws-akid", r"\bAKIA[0-9A-Z]{16}\b"),
    ("gh-token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("openai-key", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("slack", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("google-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b"),
    ("bearer", r"(?i)\b(bearer)\s+[A-Za-z0-9._\-]{16,}"),
    ("pem", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
)
REDACT_SHOWN = "text"
for _label, _pattern in SQL_SECRETS:
    REDACT, REDACT_SHOWN = (f"regexp_replace({x}, '{_pattern}', '[REDACTED:{_label}]', 'g')" for x in (REDACT, REDACT_SHOWN))
SQL_VALUE = "(?im)^([A-Z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[_-]?KEY|CLIENT[_-]?SECRET)[A-Z0-9_]*)(\\s*[=:]\\s*)(\\S+)"
REDACT, REDACT_SHOWN = (f"regexp_replace({x}, '{SQL_VALUE}', '\\1\\2[REDACTED:env-secret]', 'g')" for x in (REDACT, REDACT_SHOWN))
add("redact_documents", redacted, f"with r as (select doc_id, text, {REDACT} as red from documents) select doc_id, cast(len(regexp_extract_all(red, '\\[REDACTED:')) - len(regexp_extract_all(text, '\\[REDACTED:')) as bigint) as redactions, sha256(red) as redacted_sha256 from r")
add("duplicate_deliveries", lambda s, d: ledger.duplicate_of(V.tool_outputs(s, d)), f"with {DUPES} select * from dupes")
add("redundancy", lambda s, d: ledger.redundancy(ledger.duplicate_of(V.tool_outputs(s, d))), f"with {DUPES} select session, count(*) as duplicates, {big('sum(tokens)')} as tokens from dupes group by session")
add("reduce_grep", lambda s, d: sha(compaction.reduce_grep(V.tool_outputs(s, d)), "dropped", "kept"), f"""with {W["tool_outputs"]}, {LINES}, r as (select *, row_number() over (partition by id order by pos) as rank from tlines where trim(line) <> '')
    select id, sha256(string_agg(line, chr(10) order by pos) filter (rank <= 20) || case when count(*) > 20 then chr(10) || '... ' || (count(*) - 20) || ' more matches' else '' end) as reduced_sha256, greatest(0, count(*) - 20) as dropped, count(*) filter (rank <= 20) as kept from r group by id""")
add("reduce_generic", lambda s, d: sha(compaction.reduce_generic(V.tool_outputs(s, d)), "dropped"), f"""with {W["tool_outputs"]}, {LINES}, n as (select *, count(*) over (partition by id) as n from tlines)
    select id, sha256(case when max(n) <= 20 then string_agg(line, chr(10) order by pos) else string_agg(line, chr(10) order by pos) filter (pos < 10) || chr(10) || '... ' || (max(n) - 20) || ' lines omitted ...' || chr(10) || string_agg(line, chr(10) order by pos) filter (pos >= n - 10) end) as reduced_sha256, greatest(0, max(n) - 20) as dropped from n group by id""")
add("reduce_logs", lambda s, d: sha(compaction.reduce_logs(V.tool_outputs(s, d), pattern=r"(?i)\b(idiot|scum|license|reserved|token)\b"), "kept"), f"""with {W["tool_outputs"]}, {LINES}, r as (select *, regexp_matches(line, '(?i)\\b(idiot|scum|license|reserved|token)\\b') as hit, row_number() over (partition by id order by pos desc) as back from tlines),
    g as (select id, line, min(case when hit then pos else pos + 1000000000 end) as rank from r where hit or back <= 15 group by all) select id, sha256(string_agg(line, chr(10) order by rank)) as reduced_sha256, count(*) as kept from g group by id""")
add("line_overlap", lambda s, d: compaction.line_overlap(V.tool_outputs(s, d)), f"with {W['tool_outputs']}, {LINES}, u as (select distinct id, trim(line) as line from tlines where length(regexp_replace(trim(line), '\\s', '', 'g')) >= 20) select line, count(*) as outputs, min(id) as first_id from u group by line having count(*) > 1")
add("savings_grid", lambda s, d: compaction.savings_grid(V.tool_outputs(s, d), GRID), f"""with z as (select {big("floor(length(text) / 4)")} as size from documents), g(cap, floor) as (values {", ".join(f"({a}::bigint, {b}::bigint)" for a, b in GRID)})
    select cap, g.floor, {big("sum(size)")} as raw, count(*) filter (size >= greatest(cap, g.floor)) as reduced, {big("sum(case when size >= greatest(cap, g.floor) then size - cap else 0 end)")} as saved from z, g group by cap, g.floor""")
add("content_store", lambda s, d: compaction.content_store(V.tool_outputs(s, d)), "select 'result://' || substring(sha1(text), 1, 16) as handle, min(doc_id) as first_id, count(*) as holders, max(length(text)) as chars from documents group by 1")
add("budget_prefix", lambda s, d: compaction.budget_prefix(V.context_objects(s, d), "session", F.col("pos"), "size", 20_000).select("session", "pos", "spent"), f"with {W['context_objects']}, r as (select session, pos, {big('sum(size) over (partition by session order by pos)')} as spent from context_objects) select * from r where spent <= 20000")
add("reachable", lambda s, d: graph.reachable(V.code_edges(s, d), nodes(s, ["r0", "r1"])), f"""with {EDGES}, e as (select distinct src, dst from code_edges), h0(root, node, hop) as (values ('r0', 'r0', 0), ('r1', 'r1', 0)), h1 as (select distinct root, dst as node, 1 as hop from h0 join e on node = src),
    h2 as (select distinct root, dst as node, 2 as hop from h1 join e on node = src), h3 as (select distinct root, dst as node, 3 as hop from h2 join e on node = src) select root, node, min(hop) as hop from (select * from h0 union all select * from h1 union all select * from h2 union all select * from h3) group by all""")
_STEP = "select dst as node, max(score * 0.6 * weight) as score from {p} join b on node = src group by dst"
add("proximity", lambda s, d: graph.proximity(weighted(s, d), nodes(s, ["p1", "p7"])), f"""with {EDGES}, w as (select src, dst, case when type = 'CONTAINS' then 0.5 else 1.0 end as weight from code_edges), b as (select src, dst, max(weight)::double as weight from (select * from w union all select dst, src, weight from w) group by all),
    s0 as (select * from (values ('p1', 1.0::double), ('p7', 1.0::double)) t(node, score)), s1 as ({_STEP.format(p="s0")}), s2 as ({_STEP.format(p="s1")}), s3 as ({_STEP.format(p="s2")})
    select node, round(max(score), 6) as score from (select * from s0 union all select * from s1 union all select * from s2 union all select * from s3) group by node""")
add("cochange_pairs", lambda s, d: graph.cochange_pairs(baskets(s, d)), """with b as (select distinct l_orderkey as basket, l_partkey as item from lineitem), n as (select basket from b group by basket having count(*) between 2 and 40)
    select x.item, y.item as other, count(*) as together from b x join b y on x.basket = y.basket and x.item < y.item where x.basket in (select basket from n) group by all order by together desc, item, other limit 100""")
SYMBOLS = "symbols as (select p_partkey as id, concat_ws('.', p_brand, p_name, p_partkey) as qualified, concat_ws('/', p_brand, p_type) as short from part), refs as (select p_partkey as src, case p_partkey % 3 when 0 then concat_ws('.', p_brand, p_name, p_partkey) when 1 then concat_ws('/', p_brand, p_type) else p_name end as name from part)"
add("resolve_edges", lambda s, d: graph.resolve_edges(references(s, d), symbols(s, d)), f"""with {SYMBOLS}, x as (select qualified as name, min(id) as exact_id from symbols group by 1), y as (select short as name, min(id) as short_id, count(*) as n from symbols group by 1),
    z as (select src, r.name, exact_id, short_id, case when exact_id is not null then 'exact' when n = 1 then 'unique' when n > 1 then 'ambiguous' else 'unresolved' end as resolution from refs r left join x on r.name = x.name left join y on r.name = y.name)
    select src, name, resolution, case resolution when 'exact' then exact_id when 'unique' then short_id end as dst, cast(case resolution when 'exact' then 1.0 when 'unique' then 0.9 when 'ambiguous' then 0.45 else 0.7 end as double) as confidence from z""")
add("suffix_path_join", lambda s, d: graph.suffix_path_join(*paths(s, d)), """with a as (select distinct regexp_replace(url, '^https?://', '') as path from pages), b as (select distinct regexp_extract(url, '/([a-z]+/[0-9]+)$', 1) as path from pages)
    select a.path, b.path as other from a, b where b.path <> '' and (a.path = b.path or suffix(a.path, '/' || b.path) or suffix(b.path, '/' || a.path))""")
add("index_report", lambda s, d: graph.index_report(V.code_edges(s, d)), f"with {EDGES} select type, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from code_edges group by type")
add("pareto_front", lambda s, d: graph.pareto_front(V.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey"), """with best as (select o_custkey, max(o_totalprice) as o_totalprice from orders group by 1), f as (select *, max(o_totalprice) over (order by o_custkey desc rows between unbounded preceding and 1 preceding) as above from best)
    select o.o_orderkey, o.o_custkey, o.o_totalprice from orders o join f on o.o_custkey = f.o_custkey and o.o_totalprice = f.o_totalprice where above is null or f.o_totalprice > above""")
add("grading_summary", lambda s, d: runs.grading_summary(run_table(s, d)), f"""with {RUNS}, g as (select stratum, count(*) as runs, count(*) filter (resolved) as resolved_runs, count(*) filter (resolved is null) as grader_errors from run_table group by stratum) select *, round(100 * resolved_runs / nullif(runs - grader_errors, 0), 2) as success_rate from g""")
add("arm_means", lambda s, d: runs.arm_means(run_table(s, d)), f"with {RUNS} select stratum, arm, count(*) as runs, round(avg(total), 4) as mean_total, max(total) as max_total from run_table group by grouping sets ((arm), (stratum, arm))")
add("compare_arms", lambda s, d: runs.compare_arms(run_table(s, d), ("arm0", "arm1")), f"with {RUNS}, m as (select stratum, avg(total) filter (arm = 'arm0') as a, avg(total) filter (arm = 'arm1') as b from run_table group by stratum) select stratum, round(a, 4) as base, round(b, 4) as other, round(100 * (b - a) / a, 4) as delta_percent from m")
add("shard_assignment", lambda s, d: runs.shard_assignment(V.table(s, d, "documents").select(F.col("doc_id").alias("id")), 7), "select doc_id as id, (row_number() over (order by doc_id) - 1) % 7 as shard from (select distinct doc_id from documents)")
DECISIONS = f"""{W["tool_events"]}, decisions as (select seq, session, tokens, case when kind = 'edit' or not success then 'pass' when representation = 'search' then case when tokens >= 400 then 'reduce' else 'pass' end when status = 'raced' then 'deny' when tokens >= 400 then 'recommend' else 'pass' end as decision,
    case when kind = 'edit' then 'edit' when not success then 'failed_call' when representation = 'search' then case when tokens >= 400 then 'large_search' else 'small_search' end when status = 'raced' then 'unstable' when tokens >= 400 then 'large_read' else 'small_read' end as reason from tool_events)"""
add("policy_decisions", lambda s, d: runs.policy_decisions(V.tool_events(s, d)), f"with {DECISIONS} select * from decisions")
add("policy_dashboard", lambda s, d: runs.policy_dashboard(runs.policy_decisions(V.tool_events(s, d))), f"""with {DECISIONS} select session, count(*) as calls, {", ".join(f"count(*) filter (decision = '{k}') as n_{k}" for k in ("pass", "recommend", "reduce", "deny"))}, {big("sum(case when decision = 'reduce' then tokens else 0 end)")} as tokens_reducible from decisions group by session""")

EVENT_ROWS = f"""event_rows as (select event_id as id, user_id as session, event_type = 'purchase' as usage, event_type = 'signup' as boundary, case k % 3 when 0 then lag(event_id, 1) over w when 1 then lag(event_id, 2) over w else lag(event_id, 3) over w end as parent
    from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events) window w as (partition by user_id order by event_id))"""
LINEAGE = f"""recursive {EVENT_ROWS}, up(id, cur, crossed) as (select id, parent, false from event_rows union all select up.id, c.parent, up.crossed or c.boundary from up join event_rows c on up.cur = c.id where not c.usage),
    lineage as (select up.id, up.cur as ancestor, up.crossed from up left join event_rows c on up.cur = c.id where up.cur is null or c.usage)"""
add("lineage_parent", lambda s, d: usage.lineage_parent(V.event_rows(s, d)), f"with {LINEAGE} select * from lineage")
add("forks", lambda s, d: usage.forks(V.event_rows(s, d), usage.lineage_parent(V.event_rows(s, d))), f"""with {LINEAGE}, u as (select session, id, lag(id) over (partition by session order by id) as latest from event_rows where usage) select session, id, ancestor, latest from u join lineage using (id) where ancestor <> latest""")
add("recache_by_bucket", lambda s, d: usage.recache_by_bucket(V.requests(s, d)), f"""with {W["requests"]}, r as (select *, lag(cache_read + cache_write) over w as held, lag(model) over w as p_model, (epoch_us(ts) - epoch_us(lag(ts) over w)) / 6e7 as gap from requests window w as (partition by session order by turn)),
    q as (select *, least(cache_write, greatest(0, held - cache_read)) as rebuilt, case when model <> p_model then 'model' when gap < 5 then 'within_5m' when gap < 60 then 'within_1h' else 'expired' end as bucket from r where held is not null)
    select bucket, count(*) as requests, {big("sum(rebuilt)")} as rebuilt, {big("sum(cache_write)")} as written from q where rebuilt > 0 group by bucket""")
add("cache_churn", lambda s, d: usage.cache_churn(V.requests(s, d)), f"with {W['requests']} select session, {big('sum(cache_write)')} as written, {big('sum(input + output)')} as fresh, {big('greatest(0, sum(cache_write) - sum(input + output))')} as churn from requests group by session")
add("reset_boundaries", lambda s, d: usage.reset_boundaries(V.requests(s, d)), f"""with {W["requests"]}, r as (select session, turn, input + cache_read + cache_write as total, lag(input + cache_read + cache_write) over (partition by session order by turn) as before from requests) select session, turn, total, before from r where before > 50000 and total < before * 0.6""")
add("boundaries_since_previous", lambda s, d: usage.boundaries_since_previous(V.event_rows(s, d)), f"""with {EVENT_ROWS}, r as (select *, count(*) filter (boundary) over (partition by session order by id) as seen from event_rows) select session, id, seen - coalesce(lag(seen) over (partition by session order by id), 0) as boundaries from r where usage""")
add("next_user_turn", lambda s, d: usage.next_user_turn(V.table(s, d, "conversations")), "select conv_id, turn, (select min(b.turn) from conversations b where b.conv_id = a.conv_id and b.turn > a.turn and b.role = 'user') as next_user from conversations a")
STALE = """calls as (select source as session, lang as args, row_number() over (partition by source order by doc_id) as turn, sha1(text) as hash, cast(floor(length(text) / 4) as bigint) as tokens from documents), lastt as (select session, max(turn) as last_turn from calls group by session)"""
add("stale_results", lambda s, d: usage.stale_results(V.calls(s, d)), f"""with {STALE}, n as (select *, lead(hash) over w as next_hash, lead(turn) over w as stale_from from calls window w as (partition by session, args order by turn)) select session, turn, stale_from, tokens * (last_turn - stale_from) as token_turns from n join lastt using (session) where next_hash <> hash""")
add("opportunity_pools", lambda s, d: usage.opportunity_pools(V.calls(s, d)), f"""with {STALE} select session, count(*) as results, {big("sum(case when tokens >= 500 then tokens else 0 end)")} as large_tokens, {big("sum(case when last_turn - turn > 50 then tokens else 0 end)")} as old_tokens from calls join lastt using (session) group by session""")
add("corpus_rollup", lambda s, d: usage.corpus_rollup(V.tool_events(s, d)), f"with {W['tool_events']} select kind, representation, count(*) as calls, count(*) filter (success) as succeeded, {big('sum(tokens)')} as tokens from tool_events group by grouping sets ((kind), (representation), ())")
add("token_shares", lambda s, d: usage.token_shares(read_labels(s, d)), f"""with {LABELS}, g as (select "window", class, {big("sum(tokens)")} as tokens from labels_ group by all) select *, round(100 * tokens / nullif(sum(tokens) over (partition by "window"), 0), 4) as share from g""")
add("support_paths", lambda s, d: usage.support_paths(V.tool_events(s, d)), f"with {W['tool_events']} select distinct stream, path from tool_events where kind = 'read' and path is not null except select stream, path from tool_events where kind = 'edit'")
add("attribute_tokens", lambda s, d: usage.attribute_tokens(V.tool_events(s, d)), f"with {W['tool_events']} select batch, count(*) as reads, {big('sum(tokens)')} as tokens, case when count(*) = 1 then 'attributed' else 'ambiguous' end as attribution from tool_events where kind = 'read' and batch is not null group by batch")
add("call_fingerprints", lambda s, d: V.tool_events(s, d).groupBy(usage.call_fingerprint(F.col("kind"), F.col("representation"), F.col("path"), F.col("version")).alias("fingerprint")).agg(F.count("*").alias("calls")), f"with {W['tool_events']} select sha1(concat_ws('|', kind, representation, path, version)) as fingerprint, count(*) as calls from tool_events group by 1")
add("rewrite_amplification", lambda s, d: usage.rewrite_amplification(V.file_versions(s, d)), """with v as (select source as session, lang as path, row_number() over (partition by source, lang order by doc_id) - 1 as version, text from documents), l as (select session, path, version, unnest(string_split(text, chr(10))) as line from v),
    c as (select session, path, version, line, count(*) as n from l group by all), lastv as (select session, path, max(version) as last_version from v group by all), d as (select session, path, version, line, n from c union all select session, path, version + 1, line, -n from c join lastv using (session, path) where version < last_version),
    g as (select session, path, version, line, sum(n) as n from d where version > 0 group by all) select session, path, version, cast(sum(greatest(n, 0)) as bigint) as added, cast(sum(greatest(-n, 0)) as bigint) as removed from g group by all""")
add("top_items", lambda s, d: usage.top_items(V.table(s, d, "lineitem"), "l_suppkey", "l_partkey"), """with g as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_partkey) as rank, count(*) over (partition by l_suppkey) as held from g)
    select l_suppkey, string_agg(l_partkey || ':' || n, ',' order by rank) filter (rank <= 12) as listed, greatest(0, max(held) - 12) as more from r group by l_suppkey""")
add("callers", lambda s, d: usage.callers(V.code_edges(s, d), "USES"), f"with {EDGES}, e as (select distinct dst, src from code_edges where type = 'USES'), r as (select *, row_number() over (partition by dst order by src) as rank, count(*) over (partition by dst) as total from e) select dst, src, total from r where rank <= 5")
add("symbol_at", lambda s, d: usage.symbol_at(V.spans(s, d), V.places(s, d)), """with spans as (select o_orderkey as id, o_custkey as path, o_orderkey % 500 as start_line, o_orderkey % 500 + 1 + o_orderkey % 97 as end_line from orders), places as (select distinct c_custkey as path, c_custkey * 7 % 500 as line from customer),
    r as (select p.path, line, id, row_number() over (partition by p.path, line order by end_line - start_line, start_line desc, id) as rank, count(*) over (partition by p.path, line) as enclosing from places p join spans s on p.path = s.path and line between start_line and end_line) select path, line, id, enclosing from r where rank = 1""")
add("search_symbols", lambda s, d: usage.search_symbols(symbols(s, d), WANTED), f"""with {SYMBOLS}, x as (select id, qualified, query, case when qualified = query then 0 when suffix(qualified, query) then 1 when contains(qualified, query) then 2 end::bigint as kind from symbols, (values {", ".join(f"('{w}')" for w in WANTED)}) q(query)),
    r as (select query, row_number() over (partition by query order by kind, length(qualified), qualified, id) as rank, kind, id from x where kind is not null) select * from r where rank <= 10""")
add("expansion_debt", lambda s, d: usage.expansion_debt(V.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_quantity").cast("bigint").alias("tokens"))), """with g as (select l_orderkey, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as t from lineitem group by 1)
    select o_orderkey as id, coalesce(n, 0) as expansions, coalesce(t, 0) as debt from orders left join g on o_orderkey = l_orderkey""")
add("token_crosscheck", lambda s, d: usage.token_crosscheck(V.requests(s, d).select("id", F.col("input").alias("tokens")), V.tool_events(s, d).select(F.col("seq").alias("id"), F.floor(F.col("tokens") / 4).alias("tokens"))), f"""with {W["requests"]}, {W["tool_events"]}, b as (select input as a, cast(floor(tokens / 4) as bigint) as b from requests join tool_events on id = seq)
    select b is null as unmeasured, count(*) as compared, count(*) filter (abs(a - b) <= 0.1 * greatest(b, 1)) as agreed from b group by 1""")
MARKED = "(?i)\\b(license|reserved|token)\\b"
add("reduce_file", lambda s, d: sha(compaction.reduce_file(V.tool_outputs(s, d), MARKED, 1000), "kept"), f"""with {W["tool_outputs"]}, {LINES}, r as (select *, sum(length(line) + 1) over (partition by id order by pos) as spent from tlines where pos < 6 or regexp_matches(line, '{MARKED}')),
    g as (select *, pos - coalesce(lag(pos) over (partition by id order by pos), -1) - 1 as gap from r where spent <= 1000) select id, sha256(string_agg(case when gap > 0 then '... ' || gap || ' lines' || chr(10) || line else line end, chr(10) order by pos)) as reduced_sha256, count(*) as kept from g group by id""")
add("reduce_tests", lambda s, d: sha(compaction.reduce_tests(V.tool_outputs(s, d), "(?i)\\btoken\\b", "(?i)\\b(license|reserved)\\b"), "kept"), f"""with {W["tool_outputs"]}, {LINES}, m as (select *, regexp_matches(line, '(?i)\\btoken\\b') as failed from tlines where regexp_matches(line, '(?i)\\b(token|license|reserved)\\b')),
    b as (select *, row_number() over (partition by id, failed order by pos desc) as back, bool_or(failed) over (partition by id) as any_failed from m), g as (select id, line, min(pos) as rank from b where failed or back <= case when any_failed then 3 else 1 end group by all)
    select id, sha256(string_agg(line, chr(10) order by rank)) as reduced_sha256, count(*) as kept from g group by id""")

add("read_versions", lambda s, d: evidence.read_versions(V.version_calls(s, d)), f"""with {W["tool_events"]}, c as (select seq, kind, success, version as pre, lead(version) over (partition by stream, path order by seq) as post from tool_events)
    select seq, case when kind = 'edit' or pre = post then pre end as version, case when pre is null or post is null then 'unverified' when kind = 'edit' or pre = post then 'stable' else 'raced' end as version_status,
    case when kind = 'edit' then case when pre is null or post is null then 'unverified' else 'verified_change' end end as mutation_status,
    case when success then 'success' when kind <> 'edit' then 'failed' when pre is null or post is null then 'failed_uncertain' else 'failed_partial' end as outcome from c where not coalesce(kind = 'edit' and pre = post, false)""")
add("measure_responses", lambda s, d: evidence.measure_responses(V.response_blocks(s, d)), """with g as (select conv_id as id, string_agg(coalesce(text, ''), '' order by turn, coalesce(text, '')) filter (role <> 'system') as t, count(*) filter (role <> 'system') as texts, count(*) filter (role = 'system') as others from conversations group by 1)
    select id, length(t) as chars, cast(floor(length(t) / 4) as bigint) as tokens, substr(sha1(t), 1, 16) as text_hash, case when texts > 0 and others > 0 then 'text_partial_multimodal' when texts > 0 then 'text' else 'multimodal' end as status from g""")
add("causal_histogram", lambda s, d: evidence.causal_histogram(read_labels(s, d)), f"""with {LABELS} select "window", case when distance <= 0 then '0' when distance = 1 then '1' when distance = 2 then '2' when distance <= 4 then '3-4' when distance <= 8 then '5-8' when distance <= 16 then '9-16' when distance <= 32 then '17-32' else '>32' end as bucket, count(*) as links
    from labels_ where class = 'precondition' group by all""")
add("admission_gates", lambda s, d: evidence.admission_gates(V.tool_events(s, d)), f"""with {W["tool_events"]}, g as (select session, count(*) as events, bool_and(step is not null) as steps_clean, coalesce(bool_and(tokens is not null) filter (kind = 'read'), false) as token_share_eligible, count(*) filter (status <> 'stable') <= 0.5 * count(*) as versions_clean from tool_events group by session)
    select *, steps_clean and token_share_eligible and versions_clean as admissible from g""")
add("reduce_git", lambda s, d: sha(evidence.reduce_git(V.diffs(s, d)), "added", "removed"), """with d as (select doc_id as id, 'commit ' || doc_id || chr(10) || replace(replace(replace(text, '. ', chr(10) || '+'), ', ', chr(10) || '-'), chr(10) || 'T', chr(10) || '@@ T') as text from documents), tl as (select id, ls, unnest(range(1, len(ls) + 1)) as i from (select id, string_split(text, chr(10)) as ls from d)),
    l as (select id, i, ls[i] as line, regexp_matches(ls[i], '^(commit |Author:|Date:|diff --git|\\+\\+\\+|---|@@)') as header from tl), g as (select id, string_agg(line, chr(10) order by i) filter (header) as kept, count(*) filter (not header and line[1] = '+') as added, count(*) filter (not header and line[1] = '-') as removed from l group by id)
    select id, sha256(kept || chr(10) || '[+' || added || ' / -' || removed || ' changed lines]') as reduced_sha256, added, removed from g""".replace("\\\\", "\\"))
add("staleness_safety", lambda s, d: evidence.staleness_safety(V.context_objects(s, d), V.mentions(s, d)), f"""with {W["context_objects"]}, e as (select session, max(turn) as last_turn from context_objects group by 1), t as (select session, key, max(turn) as tail_turn, max_by(size, turn) as size from context_objects group by all),
    m as (select source as session, lang || '-' || ((n_chars + 1) % 5) as key, row_number() over (partition by source order by doc_id) as turn from documents), n as (select session, key, max(turn) as needed from m group by all),
    r as (select t.*, last_turn, needed, lag, tail_turn + lag as retired from t join e using (session) left join n using (session, key), (values (0), (3), (5), (10), (20)) l(lag)) select session, lag, count(*) as n_retired, count(*) filter (coalesce(needed <= retired, true)) as n_safe,
    {big("sum(size * (last_turn - retired))")} as tail_gross, {big("sum(case when coalesce(needed <= retired, true) then size * (last_turn - retired) else 0 end)")} as safe_gross from r where retired < last_turn group by all""")
add("path_scores", lambda s, d: evidence.path_scores(paths(s, d)[0].withColumn("score", F.length("path").cast("bigint")), paths(s, d)[1]), r"""with f as (select distinct regexp_replace(url, '^https?://', '') as path from pages), a as (select distinct regexp_extract(url, '/([a-z]+/[0-9]+)$', 1) as path from pages), q as (select path from a where path <> '')
    select q.path, coalesce(max(length(f.path)) filter (f.path = q.path), max(length(f.path))) as score from q join f on f.path = q.path or suffix(f.path, '/' || q.path) or suffix(q.path, '/' || f.path) group by 1""")
add("symbols_overlapping_reads", lambda s, d: evidence.symbols_overlapping_reads(V.spans(s, d), V.line_reads(s, d)), "select c_custkey as read_id, o_orderkey as id from customer join orders on o_custkey = c_custkey and o_orderkey % 500 <= c_custkey * 7 % 500 + 40 and o_orderkey % 500 + 1 + o_orderkey % 97 >= c_custkey * 7 % 500")
add("prefix_composition", lambda s, d: evidence.prefix_composition(V.tool_events(s, d), V.requests(s, d)), f"""with {W["tool_events"]}, {W["requests"]}, g as (select session, {big("coalesce(sum(tokens) filter (kind = 'read' and representation = 'file'), 0)")} as file_tokens, {big("coalesce(sum(tokens) filter (kind = 'read' and representation = 'search'), 0)")} as search_tokens, {big("sum(tokens)")} as tokens from tool_events group by session),
    w as (select session, min_by(cache_write, turn) as first_write from requests where cache_write > 0 group by session) select session, file_tokens, search_tokens, tokens, round(100 * file_tokens / nullif(tokens, 0), 2) as file_share, first_write from g left join w using (session)""")
add("stratified_means", lambda s, d: evidence.stratified_means(V.session_means(s, d), "value"), f"""with {W["requests"]}, g as (select session, count(*) as turns, avg(cache_read) as avg_read, sum(cache_write) / count(*) as value from requests group by session)
    select cast(case when turns < 60 then 0 when turns < 100 then 1 when turns < 150 then 2 else 3 end as bigint) as stratum, count(*) as sessions, round(avg(turns), 4) as mean_turns, round(avg(value), 4) as mean_value from g where avg_read <= 210000 group by 1""")
add("reduce_search", lambda s, d: sha(reduction.reduce_search(V.tool_outputs(s, d), 256, "(?i)\\btoken\\b"), "matches", "files", "diagnostics", "kept"), f"""with {W["tool_outputs"]}, {LINES}, r as (select *, regexp_matches(line, '(?i)\\btoken\\b') as diagnostic, case when regexp_matches(line, '^(.*?):([0-9]+):') then regexp_extract(line, '^(.*?):([0-9]+):', 1) when regexp_matches(line, '^([^:]+):') then regexp_extract(line, '^([^:]+):', 1) else line end as path from tlines where trim(line) <> ''),
    h as (select id, count(*) filter (not diagnostic) as matches, count(distinct path) filter (not diagnostic) as files, count(*) filter (diagnostic) as diagnostics, coalesce(sum(length(line) + 1) filter (diagnostic), 0) as spoken from r group by id),
    k as (select id, pos, line, diagnostic, sum(length(line) + 1) over (partition by id, diagnostic order by pos) as spent from r), b as (select id, string_agg(line, chr(10) order by not diagnostic, pos) as body, count(*) filter (not diagnostic) as kept from k join h using (id) where diagnostic or spent <= 1024 - spoken group by id)
    select id, sha256(concat_ws(chr(10), matches || ' matches in ' || files || ' file(s)', body)) as reduced_sha256, matches, files, diagnostics, coalesce(kept, 0) as kept from h left join b using (id)""".replace("\\\\b", "\\b"))
add("reduction_scan", lambda s, d: reduction.reduction_scan(V.tool_outputs(s, d).withColumn("text", F.regexp_replace("text", "token = ", "\ntoken = "))), f"""with x as (select doc_id as id, regexp_replace(text, 'token = ', chr(10) || 'token = ', 'g') as text from documents), y as (select id, text, string_split(text, chr(10)) as ls from x),
    z as (select id, length(text) as before, octet_length(encode(text)) as bytes, case when len(ls) > 20 then length(array_to_string(ls[1:10] || ['... ' || (len(ls) - 20) || ' lines omitted ...'] || ls[len(ls) - 9:], chr(10))) else length(text) end as after from y), s as ({Q["redact_documents"][1]}),
    q as (select *, case when before // 4 < 400 then 'below_floor' when bytes > 200000 then 'too_large' when redactions > 0 then 'secret' when after >= before then 'not_smaller' else 'reduced' end as reason from z join s on id = doc_id)
    select reason, count(*) as outputs, {big("sum(before // 4)")} as raw_tokens, {big("sum(case when reason = 'reduced' then after // 4 else before // 4 end)")} as reduced_tokens from q group by reason""")
add("candidate_pool", lambda s, d: reduction.candidate_pool(layers(s, d)), """with e as (select p_partkey as id, cast(p_size as bigint) as rank, 0 as k, 'size' as layer from part union all select l_partkey, min(l_linenumber), 1, 'ordered' from lineitem group by 1 union all select l_partkey, min(cast(l_quantity as bigint)), 2, 'quantity' from lineitem group by 1),
    r as (select *, row_number() over (partition by id order by rank, k) as n from e) select id, cast(rank as bigint) as rank, layer from r where n = 1""")
add("file_read_ceiling", lambda s, d: reduction.file_read_ceiling(V.tool_events(s, d)), f"""with {W["tool_events"]}, e as (select session, greatest(max(step), 1) as last_step from tool_events group by 1), f as (select session, path, min(step) as edit_step from tool_events where kind = 'edit' group by all),
    r as (select t.session, tokens * greatest(last_step - step, 0) as rest, edit_step is null as free, tokens * greatest(edit_step - step, 0) as held from tool_events t join e using (session) left join f on f.session = t.session and f.path = t.path where kind = 'read' and representation = 'file')
    select session, count(*) as reads, count(*) filter (free) as reducible_reads, cast(floor(sum(rest) * 80 / 100) as bigint) as raw_saving, cast(floor(sum(case when free then rest else 0 end) * 80 / 100) as bigint) as reducible_saving, cast(floor(sum(case when free then rest else held end) * 80 / 100) as bigint) as residency_saving from r group by session""")
add("effective_price", lambda s, d: reduction.effective_price(V.requests(s, d), PRICES), f"with {W['requests']} select version, count(*) as requests, round(avg(case when contains(model, 'purch') then 5.0::double when contains(model, 'c') then 3 when contains(model, 'view') then 1 else 2 end), 6) as effective from requests group by version")
add("continuation", lambda s, d: reduction.continuation(V.event_rows(s, d).select("id", "session"), V.event_rows(s, d).filter("usage")), f"with {EVENT_ROWS} select id, session from event_rows where id not in (select id from event_rows where usage)")


def every() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """These queries and those of the other modules, which build on this one."""
    from turnledger.plans import calls, code, lineages, policies, replay, resolving, retention, stored_files, streamed, totals

    return Q | calls.Q | replay.Q | code.Q | totals.Q | resolving.Q | lineages.Q | retention.Q | stored_files.Q | policies.Q | streamed.Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in every().items() if sql}
