"""Queries on code symbols, bundles and levels of detail, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators import bundles, compaction, graph
from turnledger.plans.registry import LINES, W, big
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def sources(s: SparkSession, d: str) -> DataFrame:
    """Documents as source files: of five lines one each declares a function, an arrow function and a class, and one imports."""

    def line(x, i):
        n, k = F.length(x).cast("string"), i % 5
        return F.when(k == 0, F.concat(F.lit("export function w"), n, F.lit("(a) {"))).when(k == 1, F.concat(F.lit("const v"), n, F.lit(" = (x) => x"))).when(k == 2, F.concat(F.lit("class C"), n, F.lit(" extends B"), n)).when(k == 3, F.concat(F.lit("import a from 'm"), n, F.lit("'"))).otherwise("plain")

    return V.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("module"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


SOURCES = "sl as (select 'd' || doc_id as module, i - 1 as pos, length(ls[i]) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))"
add("extract_symbols", lambda s, d: bundles.extract_symbols(sources(s, d)), f"with {SOURCES} select module, module || case pos % 5 when 0 then '.w' when 1 then '.v' else '.C' end || n as qualified, case pos % 5 when 2 then 'class' else 'function' end as kind, pos + 1 as line from sl where pos % 5 < 3")
add("extract_edges", lambda s, d: bundles.extract_edges(sources(s, d)), f"""with {SOURCES} select distinct module as src, module || case pos % 5 when 0 then '.w' when 1 then '.v' else '.C' end || n as dst, 'CONTAINS' as type, 0.7::double as confidence from sl where pos % 5 < 3
    union all select distinct module, 'm' || n, 'IMPORTS', 0.7::double from sl where pos % 5 = 3 union all select distinct module || '.C' || n, 'B' || n, 'IMPLEMENTS', 0.55::double from sl where pos % 5 = 2""")


def frames(s: SparkSession, d: str) -> DataFrame:
    frame = lambda path, line: F.concat(F.lit('File "'), path.cast("string"), F.lit('", line '), line.cast("string"), F.lit(", in f\n  x()\n"))
    return V.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Traceback\n"), frame(F.col("c_custkey") - 1, F.col("c_custkey") * 3 % 500), frame(F.col("c_custkey"), F.col("c_custkey") * 7 % 500), F.lit("ValueError")).alias("text"))


FRAMES = "fr as (select c_custkey as id, 0 as at, cast(c_custkey - 1 as varchar) as path, c_custkey * 3 % 500 as line from customer union all select c_custkey, 1, cast(c_custkey as varchar), c_custkey * 7 % 500 from customer)"
add("traceback_anchors", lambda s, d: bundles.traceback_anchors(frames(s, d)), f"with {FRAMES} select * from fr")
add("resolve_anchors", lambda s, d: bundles.resolve_anchors(bundles.traceback_anchors(frames(s, d)), V.spans(s, d).withColumn("path", F.col("path").cast("string"))), f"""with {FRAMES}, spans as (select o_orderkey as symbol, cast(o_custkey as varchar) as path, o_orderkey % 500 as a, o_orderkey % 500 + 1 + o_orderkey % 97 as b from orders),
    r as (select fr.id, fr."at", symbol, row_number() over (partition by fr.id order by fr."at" desc, b - a, a desc, symbol) as rank from fr join spans s on fr.path = s.path and line between a and b) select id, "at", symbol from r where rank = 1""")


def named(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return V.table(s, d, "part").select(p.alias("id"), F.concat(F.lit("pkg."), F.when(p % 3 == 0, F.concat(F.lit("dup"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("Sym"), p.cast("string")))).alias("qualified"))


def prompts(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("see Sym"), text(F.col("o_custkey")), F.lit(", dup"), text(F.col("o_orderkey") % 50), F.lit(" Sym"), text(F.col("o_orderkey") % 200), F.lit(" no")).alias("text"))


NAMED = "sym as (select p_partkey as id, case when p_partkey % 3 = 0 then 'dup' || p_size else 'Sym' || p_partkey end as name from part)"
add("working_set", lambda s, d: bundles.working_set(prompts(s, d), named(s, d)), f"""with {NAMED}, u as (select name, min(id) as symbol from sym group by name having count(*) = 1), w as (select o_orderkey as id, unnest(list_distinct(['Sym' || o_custkey, 'dup' || (o_orderkey % 50), 'Sym' || (o_orderkey % 200)])) as token from orders)
    select w.id, token, symbol from w join u on token = name""")


def touches(s: SparkSession, d: str) -> DataFrame:
    """Paths that tasks have touched, some of them written in another way."""
    path = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "./src/").otherwise("src/"), (F.col("l_partkey") % 20).cast("string"), F.lit(".py"))
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") != 5, path).alias("path"))


add("working_sets", lambda s, d: bundles.working_sets(prompts(s, d), touches(s, d), named(s, d)), f"""with {NAMED}, u as (select name, min(id) as symbol from sym group by name having count(*) = 1), w as (select o_orderkey as id, unnest(list_distinct(['Sym' || o_custkey, 'dup' || (o_orderkey % 50), 'Sym' || (o_orderkey % 200)])) as token from orders)
    select distinct w.id, 'symbol' as kind, cast(symbol as varchar) as anchor from w join u on token = name union all select distinct l_orderkey, 'path', 'src/' || (l_partkey % 20) || '.py' from lineitem where l_linenumber <> 5""")


def sized(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("("), "p_type", F.lit(")")).alias("signature"), F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"))


LEVELS = """lv as (select p_partkey as id, greatest(8, cast(ceil(length(p_name || '(' || p_type || ')') / 4) as bigint)) as sig, p_size * 9 as span from part), l0 as (select id, sig, greatest(sig, span) as impl from lv),
    l1 as (select id, unnest(['signature', 'skeleton', 'slice', 'implementation']) as level, unnest([sig, sig + cast(floor(0.25 * (impl - sig)) as bigint), sig + cast(floor(0.6 * (impl - sig)) as bigint), impl]) as cost, unnest([1.0::double, 1.6::double, 2.2::double, 3.0::double]) as value from l0),
    levels as (select id, max_by(level, value) as level, cost, max(value) as value from l1 group by id, cost)"""
add("level_tokens", lambda s, d: bundles.level_tokens(sized(s, d)), f"with {LEVELS} select * from levels")


def dependencies(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return V.table(s, d, "lineitem").select(
        F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 200 + 1).alias("dst"), F.when(n % 4 == 0, "CALLS").when(n % 4 == 1, "IMPLEMENTS").when(n % 4 == 2, "IMPORTS").otherwise("TESTED_BY").alias("type"),
        F.when(F.col("l_orderkey") % 5 == 0, "ambiguous").when(F.col("l_orderkey") % 5 == 1, "inferred").otherwise("exact").alias("match"), (n / 20 + F.lit(0.5)).alias("confidence"), F.concat(F.lit("dup"), (F.col("l_suppkey") % 50).cast("string")).alias("name"),
    )


def owners(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "part").select(F.col("p_partkey").alias("root"))


def candidates(s: SparkSession, d: str) -> DataFrame:
    return bundles.dependency_candidates(owners(s, d), dependencies(s, d))


DEPENDS = """dep as (select l_partkey as src, (l_partkey * 7 + l_suppkey) % 200 + 1 as dst, case l_linenumber % 4 when 0 then 'CALLS' when 1 then 'IMPLEMENTS' when 2 then 'IMPORTS' else 'TESTED_BY' end as type, case l_orderkey % 5 when 0 then 'ambiguous' when 1 then 'inferred' else 'exact' end as match, l_linenumber / 20 + 0.5::double as confidence, 'dup' || (l_suppkey % 50) as name from lineitem)"""
CANDIDATES = f"""{DEPENDS}, usable as (select src, dst, max(confidence * case type when 'IMPLEMENTS' then 1.0::double when 'CALLS' then 0.85::double else 0.5::double end * case match when 'inferred' then 0.6::double else 1.0::double end) as worth from dep where match <> 'ambiguous' and type <> 'TESTED_BY' group by all),
    c1 as (select src as root, dst as node, 1 as distance, dst as branch, worth as utility from usable where src in (select p_partkey from part) and src <> dst), c2 as (select c.root, u.dst as node, 2 as distance, c.branch, u.worth * 0.6::double as utility from c1 c join usable u on c.branch = u.src where u.dst <> c.root),
    candidates as (select root, node, distance, branch, utility from (select *, row_number() over (partition by root, node order by utility desc, distance, branch) as rank from (select * from c1 union all select * from c2)) where rank = 1)"""
add("dependency_candidates", lambda s, d: candidates(s, d).withColumn("utility", F.round("utility", 9)), f"with {CANDIDATES} select root, node, distance, branch, round(utility, 9) as utility from candidates")
add("ambiguity_hints", lambda s, d: bundles.ambiguity_hints(dependencies(s, d), named(s, d).withColumn("qualified", F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("."), F.element_at(F.split("qualified", r"\."), -1)))), f"""with {DEPENDS}, {NAMED}, n as (select distinct name from dep where match = 'ambiguous'), r as (select n.name, 'p' || id || '.' || sym.name as q, row_number() over (partition by n.name order by 'p' || id || '.' || sym.name) as rank, count(*) over (partition by n.name) as total from n join sym on n.name = sym.name)
    select name, string_agg(q, ',' order by rank) filter (rank <= 5) as candidates, max(total) as total from r group by name""")
add("select_bundle", lambda s, d: bundles.select_bundle(candidates(s, d), bundles.level_tokens(sized(s, d)), 600), f"""with {CANDIDATES}, {LEVELS}, roots as (select root, max(cost) as root_cost from (select distinct root from candidates) r join levels on root = id group by root having max(cost) <= 600),
    w as (select c.*, root_cost, utility * pow(0.6::double, row_number() over (partition by root, branch order by utility desc, node) - 1) as worth from candidates c join roots using (root)),
    s as (select root, node, root_cost, level, cost, cost - coalesce(lag(cost) over l, 0) as step_cost, worth * (value - coalesce(lag(value) over l, 0.0::double)) as step_value from w join levels on node = id window l as (partition by root, node order by cost)),
    g as (select *, round(min(step_value / step_cost) over (partition by root, node order by cost), 12) as gain from s), f as (select *, root_cost + cast(sum(step_cost) over (partition by root order by gain desc, node, cost rows unbounded preceding) as bigint) as spent from g)
    select root, node, max_by(level, cost) as level, max(spent) as spent from f where spent <= 600 group by root, node union all select root, root, 'implementation', root_cost from roots""")
add("materialization_quality", lambda s, d: bundles.materialization_quality(V.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, ("python_ast", "tree_sitter", "regex_heuristic", "other"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("parser"), F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"), (F.col("p_partkey") * 371 % 50000).alias("byte_size"), F.lit(20).alias("stored_lines"))), """with x as (select p_partkey as id, p_partkey * 371 % 50000 as b, p_size as n, ['python_ast', 'tree_sitter', 'regex_heuristic', 'other'][p_partkey % 4 + 1] as parser from part)
    select id, case when b > 32000 or (b > 8000 and 20 < n) then 'truncated' when parser = 'regex_heuristic' then 'declaration_only_heuristic' when parser = 'other' then 'unknown' when b > 8000 then 'unverified' when parser = 'python_ast' then 'complete_ast' else 'complete_tree_sitter' end as quality from x""")
add("coedit_relations", lambda s, d: bundles.coedit_relations(V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("symbol")), dependencies(s, d), V.table(s, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("path"))), f"""with {DEPENDS}, e as (select distinct l_orderkey as task, l_partkey as symbol from lineitem), p as (select x.task, x.symbol as a, y.symbol as b from e x join e y on x.task = y.task and x.symbol <> y.symbol),
    u as (select distinct src, dst from dep where type <> 'TESTED_BY'), d as (select src as a, dst as b from u where src <> dst union select x.src, y.dst from u x join u y on x.dst = y.src where x.src <> y.dst), t as (select src as a, dst as b from dep where type = 'TESTED_BY' union select dst, src from dep where type = 'TESTED_BY'),
    r as (select case when d.a is not null then 'callee' when v.a is not null then 'caller' when t.a is not null then 'test' when x.p_brand = y.p_brand then 'same_file' else 'none' end as relation from p left join d on p.a = d.a and p.b = d.b left join d v on p.a = v.b and p.b = v.a left join t on p.a = t.a and p.b = t.b left join part x on p.a = x.p_partkey left join part y on p.b = y.p_partkey)
    select relation, count(*) as pairs from r group by 1""")


def wanted(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id"))


def pool(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "lineitem").filter("l_linenumber % 3 <> 0").groupBy(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("rank"), (F.min("l_quantity") * 10).cast("bigint").alias("cost"))


RECALLS = """n as (select distinct l_orderkey as task, l_partkey as id from lineitem where l_linenumber <= 3), p0 as (select l_orderkey as task, l_partkey as id, min(l_suppkey) as rank, cast(min(l_quantity) * 10 as bigint) as cost from lineitem where l_linenumber % 3 <> 0 group by all),
    p as (select *, row_number() over (partition by task order by rank, id, cost) as k from p0), b(budget) as (values (300), (800)), walk(task, budget, k, id, used, fits) as (select task, budget, k, id, case when cost <= budget then cost else 0 end, cost <= budget from p, b where k = 1
        union all select p.task, w.budget, p.k, p.id, case when w.used + cost <= w.budget then w.used + cost else w.used end, w.used + cost <= w.budget from walk w join p on p.task = w.task and p.k = w.k + 1),
    recalls as (select n.task, b.budget, count(*) as needed, count(p.id) as reachable, count(w.id) filter (w.fits) as included from n cross join b left join p on p.task = n.task and p.id = n.id left join walk w on w.task = n.task and w.id = n.id and w.budget = b.budget group by all)"""


def recalls(s: SparkSession, d: str) -> DataFrame:
    return bundles.task_recall(wanted(s, d), pool(s, d), (300, 800))


add("support_recall", lambda s, d: bundles.support_recall(recalls(s, d)), f"with recursive {RECALLS} select budget, {big('sum(needed)')} as needed, {big('sum(reachable)')} as reachable, {big('sum(included)')} as included, round(sum(reachable) / sum(needed), 4) as ceiling, round(sum(included) / sum(needed), 4) as recall from recalls group by budget")
add("compile_scores", lambda s, d: bundles.compile_scores(recalls(s, d), V.table(s, d, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 3).alias("regime"))), f"with recursive {RECALLS} select o_custkey % 3 as regime, budget, count(*) as tasks, round(avg(reachable / needed), 4) as mean_ceiling, round(avg(included / needed), 4) as mean_recall from recalls join orders on o_orderkey = task group by all")
add("detail_levels", lambda s, d: compaction.detail_levels(V.tool_outputs(s, d)).groupBy("id", "level").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars")), f"""with {W["tool_outputs"]}, {LINES}, x as (select *, count(*) over (partition by id) as n, min(case when regexp_matches(line, '[:{{]\\s*$') then pos end) over (partition by id) as ends from tlines),
    y as (select *, least(coalesce(ends, 3), 3, n - 1) as h from x), z as (select *, case when pos <= h then 1 when regexp_matches(line, '^\\s*(def |class |if |elif |else|for |while |try|except|finally|with |return|raise|yield|await |function |=>|switch|case )') or regexp_matches(line, '[A-Za-z_$][\\w$]*\\s*\\(') then 2 when pos < least(n, greatest(h + 2, cast(floor(n * 0.6) as bigint))) then 3 else 4 end as least_level from y),
    l(level, k) as (values ('signature', 1), ('skeleton', 2), ('slice', 3), ('implementation', 4)) select id, level, count(*) as n_lines, {big("sum(length(line))")} as chars from z join l on least_level <= k group by all""")
add("cochange_neighbours", lambda s, d: graph.cochange_neighbours(V.table(s, d, "lineitem").join(V.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"), F.col("o_orderdate").alias("ts")), before="1997-01-01"), """with b as (select distinct l_orderkey as basket, l_partkey as item from lineitem join orders on l_orderkey = o_orderkey where o_orderdate < date '1997-01-01'), n as (select basket from b group by basket having count(*) between 2 and 40),
    p as (select x.item, y.item as other, count(*) as together from b x join b y on x.basket = y.basket and x.item <> y.item where x.basket in (select basket from n) group by all), r as (select *, row_number() over (partition by item order by together desc, other) as rank from p) select item, rank, other, together from r where rank <= 5""")
