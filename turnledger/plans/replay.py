"""Queries on retirement with costs, resets, recall and measured reductions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.operators import compaction, evidence, recall, retirement, summaries
from turnledger.plans import registry as R
from turnledger.plans.registry import LINES, MARKED, OBSOLETE, W, big
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


COSTS = f"""g as (select session, count(distinct batch) as batches, count(*) as removed, {big("sum(size * greatest(last_turn - batch, 0))")} as gross from o where batch is not null group by session), f as (select session, batch, min(pos) as from_pos from o where batch is not null group by all),
    x as (select f.session, {big("sum(o.size)")} as rewritten from f join o on f.session = o.session where o.pos > f.from_pos and o.turn <= f.batch and (o.batch is null or o.batch > f.batch) group by f.session)
    select g.*, coalesce(rewritten, 0) as rewritten, round(0.1::double * gross - (1.25::double - 0.1::double) * coalesce(rewritten, 0), 4) as cost_net from g left join x using (session)"""
add("retirement_costs", lambda s, d: retirement.retirement_costs(retirement.every_turns(R.obsolete(s, d), 7)), f"with {OBSOLETE}, o as (select *, case when superseded_at is not null then least(last_turn, greatest(7, {big('ceil(superseded_at / 7) * 7')})) end as batch from obsolete), {COSTS}")
add("retirement_once", lambda s, d: retirement.retirement_costs(retirement.once_at_end(R.obsolete(s, d))), f"with {OBSOLETE}, o as (select *, case when superseded_at <= greatest(last_turn - 1, 1) then greatest(last_turn - 1, 1) end as batch from obsolete), {COSTS}")
add("retirement_threshold", lambda s, d: retirement.retirement_costs(retirement.at_threshold(R.obsolete(s, d), 3000)), f"""with recursive {OBSOLETE}, t0 as (select session, superseded_at as turn, {big("sum(size)")} as size from obsolete where superseded_at is not null group by all), t as (select *, row_number() over (partition by session order by turn) as k from t0),
    walk(session, k, turn, held, fires) as (select session, k, turn, case when size >= 3000 then 0 else size end, size >= 3000 from t where k = 1 union all select t.session, t.k, t.turn, case when w.held + t.size >= 3000 then 0 else w.held + t.size end, w.held + t.size >= 3000 from walk w join t on t.session = w.session and t.k = w.k + 1),
    o as (select b.*, case when superseded_at is not null then coalesce((select min(w.turn) from walk w where w.session = b.session and w.fires and w.turn >= b.superseded_at), last_turn) end as batch from obsolete b), {COSTS}""")

THRESHOLDS = (2000, 6000, 12000)


def window_reads(s: SparkSession, d: str) -> DataFrame:
    """The context of each turn of the document sessions, which starts anew every 25 turns."""
    w = Window.partitionBy("session", F.floor(F.col("turn") / 25)).orderBy("turn")
    return V.context_objects(s, d).select("session", "turn", F.sum("size").over(w).alias("cache_read"))


def resets(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("turn")
    r = window_reads(s, d).withColumn("before", F.lag("cache_read").over(w))
    return r.filter("before > 5000 and cache_read < before * 0.6").select("session", "turn")


def retired(s: SparkSession, d: str) -> DataFrame:
    return retirement.retire_turns(R.obsolete(s, d), 5)


RETIRED = f"""{OBSOLETE}, retired as (select *, coalesce(superseded_at, turn + 5) as retired from obsolete), reads_ as (select session, turn, {big("sum(size) over (partition by session, turn // 25 order by turn)")} as cache_read from context_objects),
    resets as (select session, turn from (select *, lag(cache_read) over (partition by session order by turn) as before from reads_) where before > 5000 and cache_read < before * 0.6)"""
add("deferral", lambda s, d: retirement.deferral(window_reads(s, d), retired(s, d), THRESHOLDS), f"""with {RETIRED}, r as (select a.session, a.turn, cache_read, greatest(0, cache_read - coalesce((select sum(size) from retired t where t.session = a.session and t.retired <= a.turn), 0)) as rest from reads_ a),
    k as (select session, threshold, min(turn) filter (cache_read > threshold) as native_turn, min(turn) filter (rest > threshold) as retired_turn, max(turn) as last_turn from r, (values {", ".join(f"({t})" for t in THRESHOLDS)}) q(threshold) group by all)
    select session, threshold, native_turn, retired_turn, retired_turn is null as avoided, coalesce(retired_turn, last_turn) - native_turn as deferral from k where native_turn is not null""")
add("unique_savings", lambda s, d: retirement.unique_savings(retired(s, d), resets(s, d)), f"""with {RETIRED}, n as (select t.*, least(coalesce((select min(b.turn) from resets b where b.session = t.session and b.turn > t.turn), last_turn), last_turn) as until from retired t where retired < last_turn)
    select session, {big("sum(size * (last_turn - retired))")} as standalone, {big("sum(size * greatest(until - retired, 0))")} as unique_saving from n group by session""")


def touches(s: SparkSession, d: str) -> DataFrame:
    """Reads and edits of files by step."""
    return V.tool_events(s, d).select("seq", "session", "path", F.col("step").alias("turn"), "kind")


add("last_read_before_edit", lambda s, d: recall.last_read_before_edit(touches(s, d)), f"""with {W["tool_events"]}, e as (select seq, session, path, step as turn, kind from tool_events where path is not null), f as (select session, path, min(turn) as first_turn from e where kind = 'edit' group by all),
    p as (select a.seq as edit_seq, a.session, a.path, a.turn, b.seq as read_seq, b.turn as read_turn, row_number() over (partition by a.seq order by b.turn desc, b.seq desc) as rank from e a join e b on a.session = b.session and a.path = b.path and b.kind = 'read' and b.turn <= a.turn where a.kind = 'edit')
    select edit_seq, p.session, p.path, turn, read_seq, read_turn, turn <= first_turn as first_edit, read_turn <= first_turn as read_before_edits from p join f using (session, path) where rank = 1""")


def version_touches(s: SparkSession, d: str) -> DataFrame:
    """Texts of a source and language as versions of a file: two reads, then an edit, and so on."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return V.table(s, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("session"), F.col("lang").alias("path"), F.row_number().over(w).cast("bigint").alias("turn"), "text").withColumn("kind", F.when(F.col("turn") % 3 == 0, "edit").otherwise("read"))


def replaced_lines(s: SparkSession, d: str) -> DataFrame:
    """Each edit replaces the second and the ninth line of the read before it."""
    edits = recall.last_read_before_edit(version_touches(s, d))
    texts = V.table(s, d, "documents").select(F.col("doc_id").alias("read_seq"), F.split("text", "\n").alias("ls"))
    return edits.join(texts, "read_seq").select("edit_seq", F.explode(F.array_compact(F.array(F.try_element_at("ls", F.lit(2)), F.try_element_at("ls", F.lit(9))))).alias("line"))


add("edit_recall", lambda s, d: recall.edit_recall(recall.last_read_before_edit(version_touches(s, d)), replaced_lines(s, d), V.tool_outputs(s, d), MARKED, 1000), f"""with {W["tool_outputs"]}, {LINES}, v as (select doc_id as seq, source as session, lang as path, row_number() over (partition by source, lang order by doc_id) as turn, string_split(text, chr(10)) as ls from documents),
    e as (select a.seq as edit_seq, b.seq as read_seq, a.turn = 3 as first_edit, b.turn <= 3 as early, unnest(list_distinct(list_filter([rtrim(b.ls[2]), rtrim(b.ls[9])], lambda x: x is not null and trim(x) <> ''))) as line from v a join v b on a.session = b.session and a.path = b.path and b.turn = a.turn - 1 where a.turn % 3 = 0),
    r as (select *, sum(length(line) + 1) over (partition by id order by pos) as spent from tlines where pos < 6 or regexp_matches(line, '{MARKED}')), k as (select distinct id, rtrim(line) as line from r where spent <= 1000),
    m as (select edit_seq, any_value(first_edit) as first_edit, bool_and(not early or k.id is not null) as hit from e left join k on k.id = e.read_seq and k.line = e.line group by edit_seq)
    select count(*) as scored, count(*) filter (first_edit) as first_edits, count(*) filter (hit) as hits, round(count(*) filter (hit) / count(*), 4) as recall from m""")

TOKEN = "(?i)\\btoken\\b"
ROWS = """r as (select *, regexp_matches(line, '(?i)\\btoken\\b') as diagnostic, case when regexp_matches(line, '^(.*?):([0-9]+):') then regexp_extract(line, '^(.*?):([0-9]+):', 1) when regexp_matches(line, '^([^:]+):') then regexp_extract(line, '^([^:]+):', 1) else line end as path from tlines where trim(line) <> ''),
    spoken as (select id, coalesce(sum(length(line) + 1) filter (diagnostic), 0) as spoken, count(*) filter (not diagnostic) as matches, count(distinct path) filter (not diagnostic) as files from r group by id), k as (select *, sum(length(line) + 1) over (partition by id, diagnostic order by pos) as spent from r)"""
add("paired_reduction", lambda s, d: recall.paired_reduction(V.tool_outputs(s, d), (64, 128, 256), (125, 244, 400), TOKEN), f"""with {W["tool_outputs"]}, {LINES}, {ROWS}, b(budget) as (values (64), (128), (256)), f(floor) as (values (125), (244), (400)),
    z as (select s.id, budget, length(concat_ws(chr(10), matches || ' matches in ' || files || ' file(s)', string_agg(line, chr(10) order by diagnostic desc, pos))) // 4 as small from spoken s cross join b left join k on k.id = s.id and (diagnostic or spent <= 4 * budget - spoken) group by s.id, budget, matches, files),
    q as (select z.*, floor, length(text) // 4 as raw, length(text) // 4 >= floor and small < length(text) // 4 as fired from z join tool_outputs using (id) cross join f)
    select budget, floor, count(*) as outputs, count(*) filter (fired) as reductions, {big("sum(raw)")} as raw_tokens, {big("sum(case when fired then small else raw end)")} as reduced_tokens, round(1 - sum(case when fired then small else raw end) / nullif(sum(raw), 0), 4) as saving from q group by all""")


def later_paths(s: SparkSession, d: str) -> DataFrame:
    """Every fifth line of an output names a path that is touched afterwards."""
    from turnledger.operators import compaction, reduction

    return compaction.lines(V.tool_outputs(s, d)).filter("pos % 5 = 3").select("id", reduction.matched_path(F.col("line")).alias("path"))


add("evidence_recall", lambda s, d: recall.evidence_recall(V.tool_outputs(s, d), later_paths(s, d), 128, TOKEN), f"""with {W["tool_outputs"]}, {LINES}, {ROWS}, t as (select distinct id, path from r where pos % 5 = 3),
    n as (select k.id, k.path, count(*) as lines, count(*) filter (spent <= 512 - spoken) as kept from k join t on k.id = t.id and k.path = t.path join spoken on spoken.id = k.id where not diagnostic group by all)
    select count(distinct id) as searches, count(*) as needed_paths, count(*) filter (kept > 0) as retained_paths, {big("coalesce(sum(lines), 0)")} as needed_lines, {big("coalesce(sum(kept), 0)")} as retained_lines, round(count(*) filter (kept > 0) / nullif(count(*), 0), 4) as path_recall, round(sum(kept) / nullif(sum(lines), 0), 4) as line_recall from n""")


def path_ranks(s: SparkSession, d: str) -> DataFrame:
    """A score for every path: short ones first."""
    from turnledger.operators import compaction, reduction

    paths = compaction.lines(V.tool_outputs(s, d)).filter("trim(line) <> ''").select(reduction.matched_path(F.col("line")).alias("path")).distinct()
    return paths.select("path", (1.0 / (1 + F.length("path") % 7)).alias("score"))


add("compare_ranking", lambda s, d: recall.compare_ranking(V.tool_outputs(s, d), path_ranks(s, d), 64, TOKEN).select("id", "pos", "change"), f"""with {W["tool_outputs"]}, {LINES}, {ROWS}, x as (select *, sum(length(line) + 1) over (partition by id, diagnostic order by length(path) % 7, pos) as spent_2 from k),
    c as (select id, pos, spent <= 256 - spoken as a, spent_2 <= 256 - spoken as b from x join spoken using (id) where not diagnostic) select id, pos, case when b then 'promoted' else 'demoted' end as change from c where a <> b""")


RANKED = f"""{W["tool_outputs"]}, {LINES}, {ROWS}, t as (select distinct id, path from r where pos % 5 = 3), x as (select *, sum(length(line) + 1) over (partition by id, diagnostic order by length(path) % 7, pos) as spent_2 from k), c as (select x.id, x.path, pos, spent <= 256 - spoken as a, spent_2 <= 256 - spoken as b from x join spoken on spoken.id = x.id where not diagnostic),
    p as (select *, case when a then count(*) filter (a) over (partition by id order by pos) - 1 end as place_a, case when b then count(*) filter (b) over (partition by id order by length(path) % 7, pos) - 1 end as place_b from c),
    found as (select p.id, p.path, count(*) filter (a) as lines_plain, count(*) filter (b) as lines_ranked, min(place_a) as rank_plain, min(place_b) as rank_ranked from p join t on p.id = t.id and p.path = t.path group by all),
    ranked as (select *, case when lines_ranked > 0 and lines_plain = 0 then 'promoted' when lines_plain > 0 and lines_ranked = 0 then 'demoted' when lines_plain > 0 then 'same' else 'missed' end as change from found)"""


def ranking(s: SparkSession, d: str) -> DataFrame:
    return recall.ranking_recall(V.tool_outputs(s, d), later_paths(s, d), path_ranks(s, d), 64, TOKEN)


add("ranking_recall", lambda s, d: ranking(s, d).withColumn("path", F.sha1("path")), f"with {RANKED} select * replace (sha1(path) as path) from ranked")
add("ranking_summary", lambda s, d: recall.ranking_summary(ranking(s, d)), f"""with {RANKED} select count(*) as needed, count(*) filter (lines_plain > 0) as held_plain, count(*) filter (lines_ranked > 0) as held_ranked, count(*) filter (change = 'promoted') as promoted, count(*) filter (change = 'demoted') as demoted, count(*) filter (change = 'missed') as missed,
    round(count(*) filter (lines_plain > 0) / nullif(count(*), 0), 4) as recall_plain, round(count(*) filter (lines_ranked > 0) / nullif(count(*), 0), 4) as recall_ranked, round(sum(rank_plain - rank_ranked) / nullif(count(rank_plain + rank_ranked), 0), 3) as mean_rank_gain from ranked""")


def shown(s: SparkSession, d: str) -> DataFrame:
    """Outputs whose secrets stand on lines of their own, as compaction.wrapped shows them."""
    outputs = V.tool_outputs(s, d).withColumn("text", F.regexp_replace("text", "token = ", "\ntoken = "))
    small = compaction.reduce_logs(outputs, pattern="(?i)\\btoken\\b")
    return compaction.wrapped(small, outputs).join(compaction.keeps_all(small, outputs, "(?i)\\btoken\\b"), "id")


add("wrapped_outputs", lambda s, d: shown(s, d).select("id", F.sha2("text", 256).alias("text_sha256"), "handle", "raw_tokens", "reduced_tokens", "smaller", "invariants_ok"), f"""with tool_outputs as (select doc_id as id, regexp_replace(text, 'token = ', chr(10) || 'token = ', 'g') as text from documents), {LINES}, r as (select *, regexp_matches(line, '(?i)\\btoken\\b') as hit, row_number() over (partition by id order by pos desc) as back from tlines),
    g as (select id, line, min(case when hit then pos else pos + 1000000000 end) as rank from r where hit or back <= 15 group by all), x as (select id, string_agg(line, chr(10) order by rank) as text from g group by id), y as (select id, {R.REDACT_SHOWN} as red from x),
    z as (select id, red || chr(10) || '[+ full output: result://' || substring(sha1(t.text), 1, 16) || ']' as shown, t.text from y join tool_outputs t using (id))
    select id, sha256(shown) as text_sha256, 'result://' || substring(sha1(text), 1, 16) as handle, {big("floor(length(text) / 4)")} as raw_tokens, {big("floor(length(shown) / 4)")} as reduced_tokens, length(shown) // 4 < length(text) // 4 as smaller, true as invariants_ok from z""")


def object_texts(s: SparkSession, d: str) -> DataFrame:
    return V.context_objects(s, d).join(V.table(s, d, "documents").select(F.col("doc_id").alias("pos"), "text"), "pos")


def needs(s: SparkSession, d: str) -> DataFrame:
    """Every seventh turn edits, with the turn's own text."""
    o = object_texts(s, d)
    return evidence.later_needs(V.mentions(s, d), o.select("session", "key", "text"), o.filter("turn % 7 = 0").select("session", "turn", "text"))


add("later_needs", needs, f"""with {W["context_objects"]}, {W["tool_outputs"]}, {LINES}, l as (select distinct o.session, o.key, o.turn, trim(line) as line from context_objects o join tlines on id = o.pos where length(regexp_replace(trim(line), '\\s', '', 'g')) >= 20),
    m as (select source as session, lang || '-' || ((n_chars + 1) % 5) as key, row_number() over (partition by source order by doc_id) as turn from documents), e as (select session, line, max(turn) as turn from l where turn % 7 = 0 group by all)
    select session, key, max(turn) as turn from (select * from m union all select l.session, l.key, e.turn from l join e on l.session = e.session and l.line = e.line) group by all""")
add("staleness_needs", lambda s, d: evidence.staleness_safety(V.context_objects(s, d), needs(s, d), (0, 5)), f"""with {W["context_objects"]}, needs_ as ({Q["later_needs"][1]}), e as (select session, max(turn) as last_turn from context_objects group by 1), t as (select session, key, max(turn) as tail_turn, max_by(size, turn) as size from context_objects group by all),
    r as (select t.*, last_turn, n.turn as needed, lag, tail_turn + lag as retired from t join e using (session) left join needs_ n using (session, key), (values (0), (5)) l(lag)) select session, lag, count(*) as n_retired, count(*) filter (coalesce(needed <= retired, true)) as n_safe,
    {big("sum(size * (last_turn - retired))")} as tail_gross, {big("sum(case when coalesce(needed <= retired, true) then size * (last_turn - retired) else 0 end)")} as safe_gross from r where retired < last_turn group by all""")
add("read_tokens", lambda s, d: evidence.read_tokens(V.tool_events(s, d)), f"with {W['tool_events']}, g as (select representation, count(*) as reads, {big('sum(tokens)')} as tokens from tool_events where kind = 'read' and success group by 1) select *, round(100 * tokens / nullif(sum(tokens) over (), 0), 2) as share from g")


def marked(s: SparkSession, d: str) -> DataFrame:
    """Outputs with words that count: failures, tallies, constants and secrets."""
    text = F.col("text")
    for word, mark in (("token = ", "\ntoken = "), ("license", "FAILED"), ("reserved", "3 passed")):
        text = F.replace(text, F.lit(word), F.lit(mark))
    return V.tool_outputs(s, d).withColumn("text", F.regexp_replace(text, "(?m)^T", "T_X = "))


MARKS = f"""tool_outputs as (select doc_id as id, regexp_replace(replace(replace(replace(text, 'token = ', chr(10) || 'token = '), 'license', 'FAILED'), 'reserved', '3 passed'), '(?m)^T', 'T_X = ', 'g') as text from documents), {LINES}, hd as (select id, text, 'result://' || substring(sha1(text), 1, 16) as handle, '[+ full output: result://' || substring(sha1(text), 1, 16) || ']' as tail from tool_outputs)"""
RED = R.REDACT_SHOWN
add("search_summary", lambda s, d: summaries.search_summary(marked(s, d), 160, TOKEN).select("id", F.sha2("text", 256).alias("text_sha256"), "matches", "kept"), f"""with {MARKS}, {ROWS}, fc as (select id, path, count(*) as n, min(pos) as first from r where not diagnostic group by all), fr as (select *, row_number() over (partition by id order by n desc, first) as rank, count(*) over (partition by id) as files from fc),
    ru as (select id, max(files) as files, 'matches by file: ' || string_agg(path || '×' || n, ', ' order by rank) filter (rank <= 12) || case when max(files) > 12 then ', +' || (max(files) - 12) || ' more file(s)' else '' end as rollup from fr group by id),
    h0 as (select id, count(*) filter (not diagnostic) as matches, count(*) filter (diagnostic) as diagnostics, string_agg(line, chr(10) order by pos) filter (diagnostic) as said from r group by id),
    h1 as (select h0.*, rollup, handle, tail, concat_ws(chr(10), matches || ' matches in ' || coalesce(files, 0) || ' file(s)' || case when diagnostics > 0 then '; ' || diagnostics || ' diagnostic(s)' else '' end, said) as top from h0 left join ru using (id) join hd using (id)),
    h2 as (select *, greatest(0, 160 - length(top) // 4 - length(tail) // 4 - case when matches = 0 then 0 else length(rollup) // 4 + length('... 0 more match(es) across 0 file(s) — full: ' || handle) // 4 end) as room from h1),
    m as (select r.id, r.pos, r.line, r.path, sum(length(r.line) // 4 + 1) over (partition by r.id order by r.pos) <= room as stays from r join h2 using (id) where not r.diagnostic),
    bd as (select id, string_agg(line, chr(10) order by pos) filter (stays) as body, count(*) filter (stays) as kept, count(distinct path) filter (not stays) as cut_files from m group by id),
    x as (select h2.id, tail, matches, coalesce(kept, 0) as kept, concat_ws(chr(10), top, body, case when matches > coalesce(kept, 0) then rollup || chr(10) || '... ' || (matches - coalesce(kept, 0)) || ' more match(es) across ' || cut_files || ' file(s) — full: ' || handle end) as text from h2 left join bd using (id))
    select id, sha256({RED} || chr(10) || tail) as text_sha256, matches, kept from x""")
add("test_summary", lambda s, d: summaries.test_summary(marked(s, d)).select("id", F.sha2("text", 256).alias("text_sha256")), f"""with {MARKS}, m as (select *, regexp_matches(line, '(?i)(FAILED|ERROR\\b|FAIL\\b|AssertionError|Traceback|^E\\s|Exception|panic:|--- FAIL)') as failed, regexp_matches(line, '(?i)([0-9]+\\s+(failed|passed|error|skipped)|=+.*=+|Tests:|Ran [0-9]+)') as tally from tlines),
    b as (select *, row_number() over (partition by id, tally order by pos desc) as back from m where failed or tally), g as (select id, line, min(case when failed then pos else pos + 1000000000 end) as rank from b where failed or (tally and back <= 3) group by all),
    s as (select id, string_agg(line, chr(10) order by rank) as small from g group by id), x as (select hd.id, tail, coalesce(small, '{summaries.NO_TALLY}') as text from hd left join s using (id)) select id, sha256({RED} || chr(10) || tail) as text_sha256 from x""")
add("file_skeleton", lambda s, d: summaries.file_skeleton(marked(s, d), 128).select("id", F.sha2("text", 256).alias("text_sha256"), "kept"), f"""with {MARKS}, w as (select *, count(*) over (partition by id) as n from tlines), k0 as (select *, pos - coalesce(lag(pos) over (partition by id order by pos), -1) - 1 as skipped from w where pos < 6 or regexp_matches(regexp_replace(line, '^\\s*[0-9]+[→\\t]', ''), '^\\s*(?:from\\s+\\S+\\s+import|import\\s+\\S|@|(?:async\\s+)?def\\s+\\w|class\\s+\\w)|^[A-Z_][A-Z0-9_]*\\s*(?::[^=]+)?=')),
    k1 as (select *, case when skipped > 0 then '… ' || skipped || ' lines …' end as gap, length(line) // 4 + 1 as cost from k0), k2 as (select *, coalesce(sum(cost + coalesce(length(gap) // 4 + 1, 0)) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0) as charged from k1),
    k3 as (select k2.*, tail, min(case when length('file skeleton: ' || n || ' lines') // 4 + length(tail) // 4 + charged + cost > 128 then pos end) over (partition by k2.id) as cut from k2 join hd using (id) where text <> ''),
    g as (select id, any_value(tail) as tail, any_value(n) as n, any_value(cut) as cut, string_agg(concat_ws(chr(10), gap, line), chr(10) order by pos) filter (cut is null or pos < cut) as body, count(*) filter (cut is null or pos < cut) as kept, max(pos) filter (cut is null or pos < cut) as last from k3 group by id),
    x as (select id, tail, kept, concat_ws(chr(10), 'file skeleton: ' || n || ' lines', body, case when cut is not null then '… ' || (n - cut) || ' more lines (full file recoverable) …' when last < n - 1 then '… ' || (n - 1 - last) || ' lines …' end) as text from g) select id, sha256({RED} || chr(10) || tail) as text_sha256, kept from x""")
