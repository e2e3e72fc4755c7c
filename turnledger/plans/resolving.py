"""Queries on names, anchors and candidate pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators import bundles, graph, resolution
from turnledger.plans.code import dependencies
from turnledger.plans.registry import big
from turnledger.session import stored
from turnledger.sources import driver_views as V

Q: dict[str, tuple] = {}


def add(name: str, query, sql: str) -> None:
    Q[name] = (query, sql)


def text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def symbols(s: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: a module by size, three classes in each, short names that many or one of them have."""
    p = F.col("p_partkey")
    kind = F.when(p % 11 == 0, "module").when(p % 4 == 0, "method").when(p % 4 == 1, "function").when(p % 4 == 2, "class").otherwise("test")
    short = F.when(p % 5 == 0, text("u", p)).otherwise(text("f", p % 97))
    r = V.table(s, d, "part").select(p.alias("id"), text("m", F.col("p_size")).alias("module"), kind.alias("kind"), short.alias("short"), text("src/p", p % 50, ".py").alias("path"), (p % 100).alias("start_line"), (p % 100 + F.col("p_size")).alias("end_line"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("language"), text("see f", p * 7 % 97, " u", p * 5 % 2000, " self").alias("text"), (F.col("p_size") * 9).cast("bigint").alias("cost"))
    inner = F.when(F.col("kind").isin("method", "test"), text("module", "")).otherwise("")
    return r.withColumn("qualified", F.when(inner != "", F.concat("module", F.lit(".C"), (F.col("id") % 3).cast("string"), F.lit("."), "short")).otherwise(F.concat("module", F.lit("."), "short"))).drop("short")


def edges(s: SparkSession, d: str) -> DataFrame:
    """Order lines as references from their part: its own whole name, a member, a common name, or one that one symbol or none has."""
    n, o, sup = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")
    own = symbols(s, d).select(F.col("id").alias("src"), "module", "qualified")
    r = V.table(s, d, "lineitem").join(own, F.col("l_partkey") == F.col("src"))
    name = F.when(n % 4 == 0, F.col("qualified")).when(n % 4 == 1, text("self.f", sup % 97)).when(n % 4 == 2, text("f", o % 97)).when(o % 2 == 0, text("pkg.u", sup * 5)).otherwise(text("x", sup))
    kind = F.element_at(F.array(*map(F.lit, ("CALLS", "IMPORTS", "IMPLEMENTS", "TESTED_BY"))), (o % 4 + 1).cast("int"))
    sure = F.element_at(F.array(*map(F.lit, (1.0, 0.9, 0.8, 0.7))), (n % 4 + 1).cast("int"))
    return r.select("src", "module", resolution.scope_of("qualified").alias("scope"), name.alias("name"), kind.alias("type"), sure.alias("confidence"))


SYMBOLS = """sym as (select *, case when kind in ('method', 'test') then module || '.C' || (id % 3) || '.' || short else module || '.' || short end as qualified, case when kind in ('method', 'test') then module || '.C' || (id % 3) else module end as parent
    from (select p_partkey as id, 'm' || p_size as module, case when p_partkey % 11 = 0 then 'module' when p_partkey % 4 = 0 then 'method' when p_partkey % 4 = 1 then 'function' when p_partkey % 4 = 2 then 'class' else 'test' end as kind, case when p_partkey % 5 = 0 then 'u' || p_partkey else 'f' || (p_partkey % 97) end as short,
        'src/p' || (p_partkey % 50) || '.py' as path, p_partkey % 100 as a, p_partkey % 100 + p_size as b, p_size, case when p_size % 2 = 0 then 'even' else 'odd' end as language, p_size * 9 as cost from part))"""
RESOLVED = f"""{SYMBOLS}, edge as (select id as src, module, parent as scope, case l_linenumber % 4 when 0 then qualified when 1 then 'self.f' || (l_suppkey % 97) when 2 then 'f' || (l_orderkey % 97) else case when l_orderkey % 2 = 0 then 'pkg.u' || (l_suppkey * 5) else 'x' || l_suppkey end end as name,
        ['CALLS', 'IMPORTS', 'IMPLEMENTS', 'TESTED_BY'][l_orderkey % 4 + 1] as type, [1.0, 0.9, 0.8, 0.7][l_linenumber % 4 + 1]::double as confidence from lineitem join sym on l_partkey = id),
    ex as (select qualified as name, max(id) as x from sym group by 1), cm as (select parent as scope, short, max(id) as c from sym where kind in ('method', 'test') group by all), mm as (select module, short, max(id) as m from sym where kind in ('function', 'class') group by all), sh as (select short, max(id) as i, count(*) as n from sym group by 1),
    look as (select edge.*, split_part(edge.name, '.', -1) as last from edge), hit as (select look.*, x, coalesce(c, m) as scoped, i, n from look left join ex on look.name = ex.name left join cm on look.scope = cm.scope and look.last = cm.short left join mm on look.module = mm.module and look.last = mm.short left join sh on look.last = sh.short),
    kinds as (select *, case when x is not null then 'exact' when scoped is not null then 'scoped' when n = 1 then 'inferred' when n > 1 then 'ambiguous' else 'unresolved' end as match from hit),
    res as (select src, name, type, case match when 'exact' then cast(x as varchar) when 'scoped' then cast(scoped as varchar) when 'inferred' then cast(i as varchar) else match || ':' || last end as dst, match, case when match in ('inferred', 'ambiguous') then n else 0 end as ambiguity,
        round(confidence * case match when 'inferred' then 0.9::double when 'ambiguous' then 0.45::double when 'unresolved' then 0.7::double else 1.0::double end, 3) as confidence from kinds)"""


def resolved(s: SparkSession, d: str) -> DataFrame:
    return resolution.resolve_edges(edges(s, d), symbols(s, d))


add("resolve_scoped_edges", lambda s, d: resolution.with_dependencies(resolved(s, d)), f"""with {RESOLVED} select *, cast(null as boolean) as soft from res
    union all select src, name, 'DEPENDS_ON', dst, match, ambiguity, confidence, match = 'inferred' from res where match in ('exact', 'scoped', 'inferred') and type in ('CALLS', 'IMPLEMENTS', 'IMPORTS')""")
add("resolution_report", lambda s, d: resolution.resolution_report(resolved(s, d), symbols(s, d)), f"""with {RESOLVED}, l as (select language, count(*) as symbols from sym group by 1), g as (select language, count(*) as edges, {", ".join(f"count(*) filter (match = '{m}') as {m}" for m in ("exact", "scoped", "inferred", "ambiguous", "unresolved"))}, round(sum(cast(round(confidence * 1000) as bigint)) / count(*) / 1000, 3) as mean_confidence from res join sym on src = id group by 1)
    select l.language, symbols, edges, exact, scoped, inferred, ambiguous, unresolved, mean_confidence from l join g using (language)""")
add("resolved_candidates", lambda s, d: bundles.dependency_candidates(symbols(s, d).select(F.col("id").cast("string").alias("root")), resolved(s, d).withColumn("src", F.col("src").cast("string"))).withColumn("utility", F.round("utility", 9)), f"""with {RESOLVED}, usable as (select cast(src as varchar) as src, dst, max(confidence * case type when 'IMPLEMENTS' then 1.0::double when 'CALLS' then 0.85::double else 0.5::double end * case match when 'inferred' then 0.6::double else 1.0::double end) as worth from res where match in ('exact', 'scoped', 'inferred') and type <> 'TESTED_BY' group by all),
    c1 as (select src as root, dst as node, 1 as distance, dst as branch, worth as utility from usable where src <> dst), c2 as (select c.root, u.dst as node, 2 as distance, c.branch, u.worth * 0.6::double as utility from c1 c join usable u on c.branch = u.src where u.dst <> c.root)
    select root, node, distance, branch, round(utility, 9) as utility from (select *, row_number() over (partition by root, node order by utility desc, distance, branch) as rank from (select * from c1 union all select * from c2)) where rank = 1""")


def tasks(s: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: some have a traceback and a reference to a line, others a name, with a path or not, a path alone, or only words."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    k = o % 7
    said = F.concat(F.when(k == 0, text('File "x.py", line 3\nFile "/repo/src/p', c % 60, '.py", line ', o % 130, "\n")).otherwise(""), F.when(k <= 1, text("see p", o % 55, ".py:", c % 130, " ")).otherwise(""), F.when(k == 5, text("the Error in u", o * 5 % 3000, " and C1 of m", c % 60)).otherwise("no words"))
    t = resolution.text_signals(V.table(s, d, "orders").select(o.alias("id"), said.alias("text")))
    k = F.col("id") % 7
    name = F.when(k == 2, text("f", F.col("id") % 110)).when(k == 3, text("C1.f", F.col("id") % 110)).when(k == 6, text("m", F.col("id") % 60, ".u", F.col("id") % 100 * 5))
    return t.withColumn("symbol_name", name).withColumn("path", F.when(k.isin(3, 4), text("src/p", F.col("id") % 70, ".py")).otherwise(F.col("path")))


TASKS = """task as (select o_orderkey as id, o_orderkey % 7 as k, case when o_orderkey % 7 = 0 then '/repo/src/p' || (o_custkey % 60) || '.py' end as trace_path, case when o_orderkey % 7 = 0 then o_orderkey % 130 end as trace_line,
        case when o_orderkey % 7 <= 1 then 'p' || (o_orderkey % 55) || '.py' when o_orderkey % 7 in (3, 4) then 'src/p' || (o_orderkey % 70) || '.py' end as path, case when o_orderkey % 7 <= 1 then o_custkey % 130 end as line,
        case o_orderkey % 7 when 2 then 'f' || (o_orderkey % 110) when 3 then 'C1.f' || (o_orderkey % 110) when 6 then 'm' || (o_orderkey % 60) || '.u' || (o_orderkey % 100 * 5) end as name, case when o_orderkey % 7 = 5 then ['Error', 'u' || (o_orderkey * 5 % 3000)] else ['words'] end as words from orders)"""
MATCHES = "{a} = {b} or ends_with({a}, '/' || {b}) or ends_with({b}, '/' || {a})"
add("anchors_by_priority", lambda s, d: resolution.resolve_anchors(tasks(s, d), symbols(s, d)), f"""with {SYMBOLS}, {TASKS}, other as (select *, case when kind in ('class', 'function', 'method', 'interface', 'type') then 0 else 1 end as o, length(qualified) as size from sym),
    asked as (select trace_path as p from task union select path from task), files as (select distinct path as q from sym), pairs as (select p, q from asked join files on {MATCHES.format(a="p", b="q")}),
    tails as (select id, path, o, size, unnest(list_transform(range(1, len(ps) + 1), lambda k: array_to_string(ps[k:], '.'))) as name, unnest(range(1, len(ps) + 1)) as k from (select *, string_split(qualified, '.') as ps from other)),
    open_tails as (select *, k > 1 as part from tails where k = 1 or name not in (select qualified from sym)),
    found as (select t.id, 0 as ord, 'traceback' as anchor, s.id as symbol, [b - a, -a, -size, s.id] as key from task t join pairs on p = trace_path join other s on q = s.path and trace_line between a and b
        union all select t.id, 1, 'path_line', s.id, [b - a, -a, -size, s.id] from task t join pairs on p = t.path join other s on q = s.path and line between a and b
        union all select t.id, 2, case when t.path is null then 'symbol' else 'path_symbol' end, s.id, [case when pairs.q is null then 1 else 0 end, cast(part as int), o, size, s.id] from task t join open_tails s on t.name = s.name left join pairs on p = t.path and q = s.path
        union all select t.id, 3, 'file', s.id, [cast(kind <> 'module' as int), a - b, s.id] from task t join pairs on p = t.path join other s on q = s.path where line is null
        union all select t.id, 4, 'freetext', id_1, key from (select task.id, c.id as id_1, [c.inner_, c.o, c.size, c.id] as key from (select id, unnest(words) as w from task) task join (select id, o, size, unnest(string_split(qualified, '.')) as word, unnest(list_transform(range(1, len(string_split(qualified, '.')) + 1), lambda k: cast(k < len(string_split(qualified, '.')) as int))) as inner_ from other) c on w = c.word where w <> 'Error' and length(w) >= 4) t),
    ranked as (select *, row_number() over (partition by id order by ord, key) as rank from found)
    select task.id, symbol, coalesce(anchor, 'unresolved') as anchor from task left join (select * from ranked where rank = 1) r on task.id = r.id""")


def bought(s: SparkSession, d: str) -> DataFrame:
    return V.table(s, d, "lineitem").join(V.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("task"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("basket"), F.col("o_orderdate").alias("ts"))


def pool_sources(s: SparkSession, d: str, rows: DataFrame) -> tuple[DataFrame, ...]:
    """Customers as tasks whose anchor is their first part; files that were ordered together (``bought``) before 1997 change together."""
    at = symbols(s, d).select(F.col("id").alias("part"), F.col("path").alias("item"))
    together = graph.cochange_neighbours(rows.join(at, "part").select("basket", "item", "ts"), before="1997-01-01", top=3)
    anchors = rows.groupBy("task").agg(F.min("part").alias("anchor"))
    return anchors, symbols(s, d), dependencies(s, d), together.select(F.col("item").alias("path"), "other")


def task_pools(s: SparkSession, d: str) -> DataFrame:
    return resolution.pool_from_sources(*pool_sources(s, d, stored(bought(s, d), "bought")))


POOL = f"""{SYMBOLS}, bought as (select o_custkey as task, l_partkey as part, l_orderkey as basket, o_orderdate as ts from lineitem join orders on l_orderkey = o_orderkey), anchor as (select task, min(part) as anchor from bought group by 1), own as (select task, anchor, s.* from anchor join sym s on anchor = s.id),
    dep as (select l_partkey as src, (l_partkey * 7 + l_suppkey) % 200 + 1 as dst, case l_linenumber % 4 when 0 then 'CALLS' when 1 then 'IMPLEMENTS' when 2 then 'IMPORTS' else 'TESTED_BY' end as type from lineitem), walk as (select distinct src, dst from dep where type <> 'TESTED_BY'),
    b as (select distinct basket, path as item from bought join sym on part = id where ts < date '1997-01-01'), n as (select basket from b group by basket having count(*) between 2 and 40), together as (select x.item, y.item as other, count(*) as c from b x join b y on x.basket = y.basket and x.item <> y.item where x.basket in (select basket from n) group by all),
    co as (select item as path, other from (select *, row_number() over (partition by item order by c desc, other) as rank from together) where rank <= 3),
    said as (select task, unnest(['see', 'f' || (id * 7 % 97), 'u' || (id * 5 % 2000), 'self']) as word from own),
    every as (select task, dst as id, 1 as rank, 'structural' as relation from anchor join walk on anchor = src union all select task, y.dst, 2, 'structural' from anchor join walk x on anchor = x.src join walk y on x.dst = y.src
        union all select task, s.id, 3, 'same_class' from own join sym s on starts_with(s.qualified, own.parent || '.') where own.kind = 'method' union all select task, id, 4, 'identifier' from said join sym on word = short where length(word) >= 3
        union all select task, s.id, 4, 'co_change' from own join co on own.path = co.path join sym s on s.path = co.other union all select task, s.id, 5, 'same_file' from own join sym s on own.path = s.path
        union all select task, dst, 6, 'test' from anchor join dep on anchor = src where type = 'TESTED_BY' union all select task, src, 6, 'test' from anchor join dep on anchor = dst where type = 'TESTED_BY' union all select task, id, 7, 'lexical' from said join sym on word = short where length(word) >= 5),
    pool as (select task, id, min(rank) as rank, min_by(relation, (rank, relation)) as relation from every where (task, id) not in (select task, anchor from anchor) group by all)"""
add("pool_from_sources", lambda s, d: task_pools(s, d), f"with {POOL} select task, id, cast(rank as bigint) as rank, relation from pool")


def pool_recalls(s: SparkSession, d: str) -> DataFrame:
    rows = stored(bought(s, d), "bought")
    return resolution.pool_recall(rows.select("task", F.col("part").alias("id")), *pool_sources(s, d, rows), (300, 2000))


add("pool_recall", lambda s, d: bundles.support_recall(pool_recalls(s, d)), f"""with recursive {POOL}, p as (select task, pool.id, cast(cost as bigint) as cost, row_number() over (partition by task order by rank, pool.id, cost) as k from pool join sym on pool.id = sym.id), g(budget) as (values (300), (2000)),
    fill(task, budget, k, id, used, fits) as (select task, budget, k, id, case when cost <= budget then cost else 0 end, cost <= budget from p, g where k = 1 union all select p.task, w.budget, p.k, p.id, case when w.used + cost <= w.budget then w.used + cost else w.used end, w.used + cost <= w.budget from fill w join p on p.task = w.task and p.k = w.k + 1),
    need as (select distinct task, part as id from bought), r as (select n.task, g.budget, count(*) as needed, count(p.id) as reachable, count(w.id) filter (w.fits) as included from need n cross join g left join p on p.task = n.task and p.id = n.id left join fill w on w.task = n.task and w.id = n.id and w.budget = g.budget group by all)
    select budget, {big("sum(needed)")} as needed, {big("sum(reachable)")} as reachable, {big("sum(included)")} as included, round(sum(reachable) / sum(needed), 4) as ceiling, round(sum(included) / sum(needed), 4) as recall from r group by budget""")
