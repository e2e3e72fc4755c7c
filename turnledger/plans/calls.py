"""Queries on transcripts, commands, journals and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.functions import commands as S
from turnledger.operators import compaction, journal, labels, ledger, reduction, retirement, runs, transcripts
from turnledger.plans import registry as R
from turnledger.plans.registry import LABELS, W, big
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def listed(names: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def blocks(s: SparkSession, d: str) -> DataFrame:
    return transcripts.transcript_blocks(V.session_lines(s, d))


K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"
CALLS = f"""conv as (select conv_id, turn, role, coalesce(text, '') as text, length(coalesce(text, '')) as n from conversations),
    uses as (select cast(conv_id as varchar) as session, turn as call_pos, conv_id || '-' || turn as call_id, {listed(V.CALL_TOOLS)}[n % 6 + 1] as tool, 'src/f' || (n % 7) as path from conv where role = 'assistant'),
    keyed as (select *, case when tool in ('Read', 'Edit') then 'path:' || path when tool = 'Bash' then 'bash:cat ./' || path when tool = 'Grep' then 'grep:{{"path":"./' || path || '","pattern":"p"}}' when tool = 'Glob' then 'glob:{{"path":"./' || path || '","pattern":"p"}}' else '' end as key from uses),
    results as (select cast(conv_id as varchar) as session, turn as pos, conv_id || '-' || (turn - 1) as call_id, text from conv where role = 'user' and turn > 0 and n % 9 <> 0),
    paired as (select r.session, r.pos, r.call_id, coalesce(k.tool, '?') as tool, coalesce(k.key, '') as key, k.call_pos, r.text from results r left join keyed k on r.session = k.session and r.call_id = k.call_id),
    objects as (select p.session, p.pos, (select count(*) from uses u where u.session = p.session and u.call_pos <= p.call_pos) as turn, key, tool, cast(floor(length(text) / 4) as bigint) as size from paired p where tool in ('Read', 'Edit', 'Grep', 'Glob', 'Bash'))"""
add("paired_calls", lambda s, d: transcripts.pair_tool_calls(blocks(s, d)).select("session", "pos", "call_id", "tool", "key", "call_pos", C.content_hash(F.col("text")).alias("text_hash")), f"with {CALLS} select session, pos, call_id, tool, key, call_pos, substring(sha1(text), 1, 16) as text_hash from paired")
add("transcript_objects", lambda s, d: transcripts.context_objects(blocks(s, d)), f"with {CALLS} select * from objects")
add("entry_turns", lambda s, d: transcripts.entry_turns(blocks(s, d)), "select cast(conv_id as varchar) as session, turn as pos, (select count(distinct b.turn // 4) from conversations b where b.conv_id = a.conv_id and b.role = 'assistant' and b.turn <= a.turn) as turn from conversations a")
add("transcript_retirement", lambda s, d: retirement.retirement_ceiling(retirement.obsolescence(transcripts.context_objects(blocks(s, d)))), f"""with {CALLS}, obsolete as (select *, lead(turn) over (partition by session, key order by pos) as superseded_at, max(turn) over (partition by session) as last_turn from objects), {R.CEILING} select * from ceiling_""")
add("transcript_duplicates", lambda s, d: ledger.duplicate_of(transcripts.pair_tool_calls(blocks(s, d)).select("session", F.col("pos").alias("id"), F.regexp_replace("text", "[^ ]", "").alias("text"))), f"""with {CALLS}, h as (select session, pos as id, regexp_replace(text, '[^ ]', '', 'g') as text from paired), f as (select session, text, min(id) as first_id from h group by all having count(*) > 1)
    select h.session, h.id, f.first_id, substring(sha1(h.text), 1, 16) as hash, cast(floor(length(h.text) / 4) as bigint) as tokens from h join f on h.session = f.session and h.text = f.text where h.id > f.first_id""")
add("clean_cuts", lambda s, d: transcripts.clean_cuts(blocks(s, d), 2), f"""with {CALLS}, l as (select cast(conv_id as varchar) as session, turn as pos, role, sum(case when role = 'assistant' then 1 else 0 end) over w as turns from conv window w as (partition by conv_id order by turn)),
    o as (select l.*, (select count(*) from uses u where u.session = l.session and u.call_pos <= l.pos) - (select count(*) from paired p where p.session = l.session and p.pos <= l.pos and p.call_pos is not null) as open_calls from l)
    select session, max(pos) as cut from o where turns <= 2 and open_calls = 0 and role in ('assistant', 'user') group by session""")
add("stubbed_results", lambda s, d: transcripts.stub_retired(transcripts.pair_tool_calls(blocks(s, d)), retirement.retire_turns(retirement.obsolescence(transcripts.context_objects(blocks(s, d))), 1), 2).select("session", "pos", "stubbed", F.length("text").cast("bigint").alias("chars")), f"""with {CALLS},
    o as (select *, lead(turn) over (partition by session, key order by pos) as superseded_at from objects), g as (select session, pos from o where coalesce(superseded_at, turn + 1) <= 2 and turn <= 2)
    select p.session, p.pos, g.pos is not null as stubbed, case when g.pos is not null then length('{transcripts.STUB}') else length(p.text) end as chars from paired p left join g on p.session = g.session and p.pos = g.pos""")
MIX = f"mix as (select event_id as id, {listed(V.MIX_TOOLS)}[k % 14 + 1] as tool, cast(floor(value) as bigint) as tokens, k from (select *, {K} as k from events))"
CATEGORY = "case when tool = 'Read' then 'file_read' when tool in ('Grep', 'Glob') then 'search_tool' when tool = 'Bash' then 'shell' when tool in ('Edit', 'Write') then 'edit_result' when tool in ('Agent', 'Task') then 'subagent_result' when tool = 'WebSearch' then 'web' when tool in ('TodoWrite', 'Skill') then 'agent_meta' when tool like 'mcp__chrome%' then 'mcp_browser' when tool like 'mcp__%' then 'mcp_other' else 'other_tool' end"
KIND = "case when tool = 'Read' then 'source_slice' when tool in ('Grep', 'Glob') then 'search_result' when tool in ('Bash', 'WebSearch') then 'log' else 'tool_result' end"
add("tool_mix", lambda s, d: V.tool_mix(s, d).groupBy(C.tool_category(F.col("tool")).alias("category"), C.tool_kind(F.col("tool"))["kind"].alias("kind"), C.tool_kind(F.col("tool"))["provenance"].alias("provenance")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")),
    f"with {MIX} select {CATEGORY} as category, {KIND} as kind, case when tool = 'Read' then 'source' when tool = 'WebSearch' then 'external' else 'tool' end as provenance, count(*) as calls, {big('sum(tokens)')} as tokens from mix group by all")
add("retention", lambda s, d: V.tool_mix(s, d).groupBy(C.should_reduce(C.tool_kind(F.col("tool"))["kind"], F.col("tokens") * 10, F.col("k") % 3 == 0).alias("r")).agg(F.count("*").alias("calls")).select("r.reduce", "r.reason", "calls"),
    f"""with {MIX}, t as (select *, {KIND} as kind from mix), r as (select case when kind = 'source_slice' then 'native' when k % 3 = 0 then 'edit_target' when tokens * 10 < 400 then 'below_floor' else 'reducible' end as reason from t) select reason = 'reducible' as reduce, reason, count(*) as calls from r group by all""")
add("model_names", lambda s, d: V.requests(s, d).groupBy(C.short_model(F.concat(F.lit("claude-"), "model", F.lit("-20251001"))).alias("model")).agg(F.count("*").alias("requests")), "select event_type as model, count(*) as requests from events group by 1")
add("module_names", lambda s, d: V.table(s, d, "part").select(F.col("p_partkey").alias("id"), C.module_name(F.concat(F.when(F.col("p_partkey") % 2 == 0, "src/").otherwise(""), F.replace("p_brand", F.lit("#"), F.lit("/")), F.when(F.col("p_partkey") % 3 == 0, "/__init__.py").otherwise(F.concat(F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py"))))).alias("module")), "select p_partkey as id, replace(p_brand, '#', '.') || case when p_partkey % 3 = 0 then '' else '.m' || p_partkey end as module from part")
add("failure_marks", lambda s, d: V.table(s, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "reserved", "3 passed"), "token", "ERROR").alias("t")).select("doc_id", S.is_test_like(F.col("t")).alias("test_like"), S.has_failure(F.col("t")).alias("failed")).filter("test_like or failed"),
    "with x as (select doc_id, replace(replace(text, 'reserved', '3 passed'), 'token', 'ERROR') as t from documents), y as (select doc_id, coalesce(regexp_matches(t, '(?im)([0-9]+\\s+(passed|failed|error|skipped)|test session starts|^OK$|^\\s*(PASSED|FAILED)\\b|::\\w)'), false) as test_like, coalesce(regexp_matches(t, '(?i)(FAILED|FAILURES|ERROR|Traceback|AssertionError)'), false) as failed from x) select * from y where test_like or failed")

#: Written by hand: for each command template its class, the reducer of its output, and its effects (statement, kind, path,
#: representation, certain, attributable).
EXPECTED = (
    ("shell_file_dump", "logs", [(0, "read", "src/@", "file", True, True)]), ("shell_search", "logs", [(0, "read", "src/@", "search", True, True)]), ("shell_file_dump", "logs", [(1, "read", "a/@", "file", True, True)]), ("shell_file_dump", "logs", [(2, "read", "a/@", "file", True, True)]),
    ("shell_test", "tests", [(0, "execution", None, None, True, False)]), ("shell_file_dump", "logs", [(0, "read", "@", "derived", True, True)]), ("shell_search", "logs", [(0, "read", "src", "path_listing", True, True)]), ("shell_search", "logs", [(0, "read", ".", "path_listing", True, True)]), ("shell_search", "logs", [(0, "unknown", None, None, True, False)]),
    ("shell_git", "git", [(0, "read", "src/@", "git_blob", True, True)]), ("shell_git", "git", [(0, "unknown", None, None, True, False)]), ("shell_file_dump", "logs", [(0, "read", "@", "file", True, True)]), ("shell_other", "logs", [(0, "edit", "@", None, True, False)]), ("shell_other", "logs", [(0, "edit", "@", None, True, False)]), ("shell_file_dump", "logs", [(0, "read", "@", "file", True, True)]),
    ("shell_other", "logs", [(0, "edit", "@", None, True, False)]), ("shell_other", "logs", [(0, "edit", "@", None, True, False), (0, "edit", "b", None, True, False), (1, "read", "b", "file", False, False)]), ("shell_other", "logs", [(0, "edit", "c", None, True, False), (1, "read", "c", "file", True, True)]), ("shell_build", "logs", [(0, "execution", None, None, False, False), (1, "read", "@", "file", False, False)]),
    ("shell_other", "logs", [(0, "unknown", None, None, True, False)]), ("shell_file_dump", "logs", [(0, "unknown", None, None, True, False)]), ("shell_search", "logs", [(1, "read", "/abs", "path_listing", True, True)]), ("shell_search", "logs", [(0, "read", "@", "search", True, True)]), ("shell_test", "tests", [(0, "execution", None, None, True, False), (1, "read", "@", "file", False, False)]),
)
#: Written by hand: why each template's output can or cannot be reduced.
ROUTES = ("other_representation", "shell_read", "other_representation", "other_representation", "execution", "other_representation", "shell_read", "shell_read", "uncertain", "other_representation", "uncertain", "other_representation", "no_read", "no_read", "other_representation", "no_read", "uncertain", "other_representation", "execution", "uncertain", "uncertain", "shell_read", "shell_read", "execution")


def sql_value(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool | int) else f"'{x}'"


COMMANDS = f"cmds as (select event_id as id, event_id % {len(V.COMMANDS)} as t, 'f' || (k % 4) as f, k, case when k % 5 = 0 then 'Grep' when k % 5 = 1 then 'Read' else 'Bash' end as tool from (select *, {K} as k from events))"
EFFECTS = "expected(t, idx, kind, path, representation, certain, attributable) as (values " + ", ".join(f"({t}, {', '.join(map(sql_value, e))})" for t, (_, _, es) in enumerate(EXPECTED) for e in es) + ")"
add("command_effects", lambda s, d: S.command_effects(V.commands(s, d)), f"with {COMMANDS}, {EFFECTS} select id, idx, kind, replace(path, '@', f) as path, representation, certain, attributable from cmds join expected using (t)")
add("command_classes", lambda s, d: V.commands(s, d).groupBy("command", S.bash_class(F.col("command")).alias("class"), S.reducer_for(F.lit("Bash"), F.col("command"), F.lit("")).alias("reducer")).agg(F.count("*").alias("calls")),
    f"with {COMMANDS}, c(t, class, reducer, template) as (values {', '.join('(' + str(t) + ', ' + ', '.join(map(sql_value, (c, r, V.COMMANDS[t].replace(chr(39), chr(39) * 2)))) + ')' for t, (c, r, _) in enumerate(EXPECTED))}) select replace(template, '@', f) as command, class, reducer, count(*) as calls from cmds join c using (t) group by all")
add("routes", lambda s, d: S.routes(V.commands(s, d), S.command_effects(V.commands(s, d))), f"""with {COMMANDS}, r(t, own) as (values {', '.join(f"({t}, '{x}')" for t, x in enumerate(ROUTES))}), q as (select *, case tool when 'Grep' then 'native_search' when 'Read' then 'other_tool' else own end as reason from cmds join r using (t))
    select id, reason in ('native_search', 'shell_read') as reduce, case when reason = 'native_search' or (reason = 'shell_read' and t in (1, 22)) then 'search' when reason = 'shell_read' then 'path_listing' end as representation, reason from q""")

TELEMETRY = f"""tm as (select event_id as id, event_type as channel, case when k % 3 = 0 then 'search' else 'file' end as representation, cast(floor(value) as bigint) as payload, cast(floor(value) as bigint) + k - 20 as transport, k from (select *, {K} as k from events))"""
add("reads_by_channel", lambda s, d: journal.reads_by_channel(V.telemetry(s, d)), f"with {TELEMETRY} select channel, representation, count(*) as reads, {big('sum(payload)')} as payload_tokens, {big('sum(transport)')} as transport_tokens, {big('sum(greatest(0, transport - payload))')} as overhead from tm group by all")
add("token_categories", lambda s, d: V.telemetry(s, d).groupBy(C.token_category(F.col("attribution"), F.col("tokens"), F.col("status")).alias("category")).agg(F.count("*").alias("reads"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")),
    f"""with {TELEMETRY} select case when k % 5 = 0 then 'ambiguous_composite' when k % 5 = 1 then 'ambiguous_multipath' when k % 5 in (2, 3) and k % 7 <> 0 and k % 4 not in (0, 1) and k % 8 <> 2 then 'fully_attributed_text' when k % 4 = 0 then 'partial_multimodal' when k % 4 = 1 then 'multimodal_unmeasured' when k % 8 = 2 then 'unsupported' else 'unmeasured_other' end as category,
    count(*) as reads, {big("coalesce(sum(case when k % 7 <> 0 then payload end), 0)")} as tokens from tm group by 1""")  # fmt: skip
add("rejected_events", lambda s, d: journal.rejected_events(V.telemetry(s, d)), f"""with {TELEMETRY}, p as (select id, case when k % 6 = 1 then 'closure_reason' when k % 4 = 1 and k % 3 = 0 then 'empty_key' when k % 4 = 1 and k % 9 = 0 then 'no_source_system' when k % 4 = 1 and k % 8 = 0 then 'no_stream' end as problem from tm) select * from p where problem is not null""")
add("pseudonyms", lambda s, d: journal.pseudonyms(V.tool_events(s, d)), f"with {W['tool_events']}, g as (select stream, min(seq) as first_seq from tool_events group by 1), r as (select stream, row_number() over (order by first_seq, stream) as n from g) select stream, 'stream_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as pseudonym from r")
add("provisional_reads", lambda s, d: journal.provisional_reads(R.read_labels(s, d), V.closures(s, d)), f"""with {LABELS}, c as (select session, stream, max(seq) as last_seq from tool_events group by all)
    select l.seq, "window", reason in ('never_edited', 'read_after_edit', 'prior_edit_unverified') and (c.session % 2 = 1 or (c.session % 4 = 0 and l.seq > last_seq - 3000)) as provisional from labels_ l join c using (stream)""")
add("reduction_buckets", lambda s, d: R.read_labels(s, d).groupBy("window", C.reduction_bucket(F.col("class"), F.col("reason")).alias("bucket")).agg(F.count("*").alias("reads"), F.sum("tokens").alias("tokens")), f"""with {LABELS} select "window", case when class = 'precondition' then 'required' when class = 'verification' then 'verification' when class = 'exploration' then 'exploration_reducible' when reason = 'search_result' then 'search_listing_reducible' else 'unresolved_other' end as bucket, count(*) as reads, {big("sum(tokens)")} as tokens from labels_ group by all""")
add("step_epochs", lambda s, d: journal.step_epochs(V.table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), (F.col("event_type") == "signup").alias("reset"), (F.col("event_type") != "error").alias("moves"))), f"""with e as (select event_id as seq, user_id as session, event_type, {big("sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id)")} as epoch from events)
    select seq, epoch, {big("sum(case when event_type <> 'error' then 1 else 0 end) over (partition by session, epoch order by seq)")} as step from e""")
add("run_outcomes", lambda s, d: runs.runs_with_verdicts(V.table(s, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("lang").alias("stratum")), V.table(s, d, "labels").select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("resolved")), V.table(s, d, "documents").filter("n_chars % 3 = 0").select(F.col("doc_id").alias("task_id"))).groupBy("stratum", "outcome").agg(F.count("*").alias("runs")),
    "select lang as stratum, case when quality = 1 then 'resolved' when quality is not null then 'unresolved' when n_chars % 3 = 0 then 'empty_patch' else 'grader_error' end as outcome, count(*) as runs from documents left join labels using (doc_id) group by all")
add("continuation_report", lambda s, d: transcripts.continuation_report(blocks(s, d), blocks(s, d).filter("pos < 3").select("session", "pos").distinct(), transcripts.context_objects(blocks(s, d)).filter("pos < 3 and key like 'path:%'").select("session", F.substring("key", 6, 1000).alias("path"))), f"""with {CALLS}, l as (select cast(conv_id as varchar) as session, count(*) as n_lines from conv where turn >= 3 group by 1), u as (select * from uses where call_pos >= 3), q as (select distinct session, substring(key, 6) as path from objects where pos < 3 and key like 'path:%')
    select l.session, n_lines as lines, (select count(*) from u where u.session = l.session) as calls, (select count(*) from u where u.session = l.session and tool = 'Edit') as edits, (select count(*) from u join q on u.session = q.session and u.path = q.path where u.session = l.session and tool = 'Read') as rereads from l""")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
add("table_counts", lambda s, d: journal.table_counts({t: V.table(s, d, t) for t in TABLES}), " union all ".join(f"select '{t}' as name, count(*) as n_rows from {t}" for t in TABLES))
def expanding(s: SparkSession, d: str) -> DataFrame:
    """Tool events of which some expand a handle."""
    return V.tool_events(s, d).withColumn("kind", F.when(F.col("seq") % 10 == 3, "expand").otherwise(F.col("kind")))


add("run_metrics", lambda s, d: journal.run_metrics(expanding(s, d), V.requests(s, d)), f"""with {W["tool_events"].replace("tool_events as (", "tool_events_ as (", 1)}, tool_events as (select * replace (case when seq % 10 = 3 then 'expand' else kind end as kind) from tool_events_), {W["requests"]}, u as (select session, {big("sum(input + output + cache_read + cache_write)")} as total, count(*) as turns from requests group by 1), a as (select session, representation, count(*) - count(distinct path) as again from tool_events where kind = 'read' and path is not null group by all)
    select session, total, turns, {big("coalesce((select sum(again) from a where a.session = u.session and representation = 'file'), 0)")} as rereads, {big("coalesce((select sum(again) from a where a.session = u.session and representation = 'search'), 0)")} as repeat_searches, (select count(*) from tool_events t where t.session = u.session and kind = 'expand') as expansions from u""")
add("engagement", lambda s, d: journal.engagement(V.tool_events(s, d)), f"""with {W["tool_events"]}, g as (select session, count(*) filter (kind = 'read' and success) as reads, count(*) filter (kind = 'edit' and success) as edits from tool_events group by 1)
    select count(*) as runs, count(*) filter (edits = 0) as empty_runs, count(*) filter (edits = 0 and reads <= 1) as degenerate, count(*) filter (edits > 0) as engaged, round(quantile_cont(reads, 0.5), 4) as median_reads from g""")
add("search_heavy", lambda s, d: journal.search_heavy(V.tool_events(s, d)), f"with {W['tool_events']} select session, {big('sum(tokens)')} as search_tokens from tool_events where representation = 'search' group by 1 having sum(tokens) > 0 order by 2 desc, 1 limit 4")


def probe_reads(s: SparkSession, d: str) -> DataFrame:
    e = V.tool_events(s, d)
    edits = e.filter("kind = 'edit'").select("stream", "path").distinct().withColumn("edited", F.lit(True))
    return e.filter("kind = 'read'").join(edits, ["stream", "path"], "left").select("seq", "path", "tokens", F.coalesce("edited", F.lit(False)).alias("edited"))


add("opportunity_probe", lambda s, d: journal.opportunity_probe(probe_reads(s, d), V.table(s, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("path"), (F.col("p_size") % 2).cast("bigint").alias("est_tokens"))), f"""with {W["tool_events"]}, c as (select 'f' || (p_partkey % 3) as path, {big("sum(p_size % 2)")} as cost from part group by 1), e as (select distinct stream, path from tool_events where kind = 'edit'),
    r as (select t.seq, t.tokens, cost, case when cost is null then 'no_signatures' when e.path is not null then 'edited' when cost >= t.tokens then 'no_gain' else 'opportunity' end as opportunity from tool_events t left join c on t.path = c.path left join e on t.stream = e.stream and t.path = e.path where t.kind = 'read')
    select seq, opportunity, tokens, coalesce(cost, 0) as signature_tokens, case when opportunity = 'opportunity' then tokens - cost else 0 end as avoidable from r""")


def signatures(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("path"), (F.col("p_size") % 2).cast("bigint").alias("est_tokens"))


add("opportunity_dashboard", lambda s, d: journal.opportunity_dashboard(journal.opportunity_probe(probe_reads(s, d), signatures(s, d)).join(V.tool_events(s, d).select("seq", "session", "path", F.when(F.col("seq") % 3 == 0, "symbol").otherwise("native").alias("channel")), "seq")), f"""with {W["tool_events"]}, c as (select 'f' || (p_partkey % 3) as path, {big("sum(p_size % 2)")} as cost from part group by 1), e as (select distinct stream, path from tool_events where kind = 'edit'),
    r as (select t.session, t.seq, t.path, t.seq % 3 = 0 as used, coalesce(cost < t.tokens and e.path is null, false) as chance, t.tokens - cost as avoidable, lag(t.seq % 3 = 0) over (partition by t.session, t.path order by t.seq) as after_symbol from tool_events t left join c on t.path = c.path left join e on t.stream = e.stream and t.path = e.path where t.kind = 'read')
    select session, count(*) as reads, count(*) filter (chance) as opportunities, count(*) filter (chance and used) as used, count(*) filter (chance and not used) as fallbacks, {big("coalesce(sum(avoidable) filter (chance and used), 0)")} as tokens_avoided, {big("coalesce(sum(avoidable) filter (chance and not used), 0)")} as tokens_missed, count(*) filter (not used and after_symbol) as retries from r group by session""")


def tool_results(s: SparkSession, d: str) -> DataFrame:
    """Outputs of searches, commands and other tools, with the reducer that each calls for."""
    tool = F.when(F.col("id") % 3 == 0, "Grep").when(F.col("id") % 3 == 1, "Bash").otherwise("Other")
    o = V.tool_outputs(s, d).withColumn("tool", tool).withColumn("kind", F.when(F.col("id") % 10 == 0, "source_slice").otherwise(C.tool_kind(F.col("tool"))["kind"]))
    return o.select("id", "text", "kind", S.reducer_for(F.col("tool"), F.lit("run"), F.col("kind")).alias("reducer"))


def by_reducer(s: SparkSession, d: str) -> DataFrame:
    o = tool_results(s, d)
    return reduction.reduction_by_reducer(o, {"grep": compaction.reduce_grep(o), "logs": compaction.reduce_logs(o), "generic": compaction.reduce_generic(o)})


add("reduction_by_reducer", by_reducer, f"""with {W["tool_outputs"]}, {R.LINES}, o as (select id, length(text) // 4 as raw, case id % 3 when 0 then 'grep' when 1 then 'logs' else 'generic' end as reducer, id % 10 = 0 as native from tool_outputs),
    x as (select *, count(*) over (partition by id) as n, row_number() over (partition by id order by pos desc) as back, regexp_matches(line, '\\b(ERROR|CRITICAL|FATAL|WARN|Exception|Traceback|panic)\\b') as hit from tlines), k as (select *, row_number() over (partition by id order by pos) as rank, count(*) over (partition by id) as held from x where trim(line) <> ''),
    gr as (select id, length(string_agg(line, chr(10) order by pos) filter (rank <= 20) || case when max(held) > 20 then chr(10) || '... ' || (max(held) - 20) || ' more matches' else '' end) // 4 as small from k group by id),
    lg as (select id, length(string_agg(line, chr(10))) // 4 as small from (select distinct id, line from x where hit or back <= 15) group by id),
    ge as (select id, length(case when max(n) <= 20 then string_agg(line, chr(10)) else string_agg(line, chr(10)) filter (pos < 10 or pos >= n - 10) || chr(10) || '... ' || (max(n) - 20) || ' lines omitted ...' end) // 4 as small from x group by id),
    q as (select o.*, case reducer when 'grep' then gr.small when 'logs' then lg.small else ge.small end as small from o left join gr using (id) left join lg on lg.id = o.id left join ge on ge.id = o.id),
    z as (select *, case when native then 'native' when raw < 400 then 'below_floor' when small < raw then 'reduced' else 'not_smaller' end as reason from q)
    select reducer, reason, count(*) as outputs, {big("sum(raw)")} as raw_tokens, {big("sum(case when reason = 'reduced' then small else raw end)")} as reduced_tokens from z group by all""")


def configured(s: SparkSession, d: str) -> DataFrame:
    """Labels where one path counts as configuration."""
    return labels.label_distribution(labels.classify_reads(V.tool_events(s, d), R.WINDOWS, lambda path: path == "f3"))


add("config_reads", configured, f"""with {R.labels_sql("path = 'f3'")} select "window", class, reason, count(*) as reads, {big("sum(tokens)")} as tokens from labels_ group by all""")
