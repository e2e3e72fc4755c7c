"""Code symbols: extraction from sources, anchors in texts, dependencies, bundles within a token budget, and co-edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions import columns as C
from turnledger.operators.runs import numbered
from turnledger.session import stored

#: How certain kinds of matches and edges count, and the value of each level of detail.
HARD, SOFT, WEIGHTS = ("exact", "scoped"), ("inferred",), {"IMPLEMENTS": 1.0, "CALLS": 0.85, "IMPORTS": 0.5}
VALUES = {"signature": 1.0, "skeleton": 1.6, "slice": 2.2, "implementation": 3.0}
DECAY, SOFT_SHARE, LINE_TOKENS, LEAST_SIGNATURE, SKELETON, SLICE, SHOWN = 0.6, 0.6, 9, 8, 0.25, 0.6, 5
#: About so many first steps of roots are walked on in one task.
FIRST_STEPS = 50_000
#: So many edges from first steps, at most, go to every task; beyond them, about so many second steps are walked in one part.
FEW_STEPS, WALKED = 500_000, 4_000_000
#: Declarations and imports of one line.
FUNCTION = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("
ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
CLASS = r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([A-Za-z_$][\w$.]*))?"
IMPORT = r"""(?:import\s+.*?\s+from\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\))"""
FRAME = r'File "([^"]+)", line (\d+)'
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,}"


def extract_symbols(sources: DataFrame) -> DataFrame:
    """(module, qualified, kind, line) of sources (module, text): functions, arrow functions and classes, by line, from 1."""
    r = sources.select("module", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hit = F.when(F.col("line").rlike(FUNCTION), F.struct(F.lit("function").alias("kind"), F.regexp_extract("line", FUNCTION, 1).alias("name"))).when(F.col("line").rlike(ARROW), F.struct(F.lit("function").alias("kind"), F.regexp_extract("line", ARROW, 1).alias("name"))).when(F.col("line").rlike(CLASS), F.struct(F.lit("class").alias("kind"), F.regexp_extract("line", CLASS, 1).alias("name")))
    return r.withColumn("hit", hit).filter("hit is not null").select("module", F.concat_ws(".", "module", "hit.name").alias("qualified"), "hit.kind", (F.col("pos") + 1).alias("line"))


def extract_edges(sources: DataFrame) -> DataFrame:
    """(src, dst, type, confidence) of the same sources: what a module contains and imports, and what its classes extend."""
    r = sources.select("module", F.explode(F.split("text", "\n")).alias("line"))
    edge = lambda src, dst, kind, sure: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    name = F.when(F.col("line").rlike(FUNCTION), F.regexp_extract("line", FUNCTION, 1)).when(F.col("line").rlike(ARROW), F.regexp_extract("line", ARROW, 1)).when(F.col("line").rlike(CLASS), F.regexp_extract("line", CLASS, 1))
    own = F.concat_ws(".", "module", name)
    source = F.when(F.col("line").rlike(IMPORT), F.concat(*[F.coalesce(F.regexp_extract("line", IMPORT, k), F.lit("")) for k in (1, 2)]))
    base = F.nullif(F.regexp_extract("line", CLASS, 2), F.lit(""))
    every = F.array(F.when(name.isNotNull(), edge(F.col("module"), own, "CONTAINS", 0.7)), F.when(source.isNotNull(), edge(F.col("module"), source, "IMPORTS", 0.7)), F.when(base.isNotNull(), edge(own, base, "IMPLEMENTS", 0.55)))
    return r.select(F.explode(F.array_compact(every)).alias("e")).select("e.*").distinct()


def traceback_anchors(texts: DataFrame) -> DataFrame:
    """(id, at, path, line) of every traceback frame in texts (id, text), in order."""
    frames = F.posexplode(F.regexp_extract_all("text", F.lit(f"({FRAME})"), F.lit(1))).alias("at", "frame")
    return texts.select("id", frames).select("id", "at", F.regexp_extract("frame", FRAME, 1).alias("path"), F.regexp_extract("frame", FRAME, 2).cast("bigint").alias("line"))


def resolve_anchors(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, at, symbol): the last frame of each text that lies in a symbol (spans: id, path, start_line, end_line), the narrowest one."""
    own = spans.select(F.col("id").alias("symbol"), "path", "start_line", "end_line")
    hit = anchors.join(own, "path").filter("line between start_line and end_line")
    order = F.struct(-F.col("at"), F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("symbol"))
    return hit.groupBy("id").agg(F.min_by(F.struct("at", "symbol"), order).alias("r")).select("id", "r.*")


def working_set(mentions: DataFrame, symbols: DataFrame, most: int = 24) -> DataFrame:
    """(id, token, symbol): words of texts (id, text) that name exactly one symbol (id, qualified), by its whole name or its last part; the
    first ``most`` of each text in order of the words."""
    names = symbols.select(F.col("id").alias("symbol"), F.explode(F.array_distinct(F.array(F.col("qualified"), F.element_at(F.split("qualified", r"\."), -1)))).alias("token"))
    unique = names.groupBy("token").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("symbol")).filter("n = 1").drop("n")
    words = mentions.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"), F.lit(1)))).alias("token"))
    found = words.join(unique, "token").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("token")))
    return found.filter(F.col("rank") <= most).select("id", "token", "symbol")


def working_sets(tasks: DataFrame, touched: DataFrame, symbols: DataFrame, most: int = 24) -> DataFrame:
    """(id, kind, anchor): where each task (id, text) works: the paths it has touched (touched: id, path), and the symbols that its text surely
    names. Paths are compared as they are normalized; a path touched often is one anchor."""
    paths = touched.filter("path is not null and path <> ''").select("id", F.lit("path").alias("kind"), C.norm_path(F.col("path")).alias("anchor")).distinct()
    names = working_set(tasks, symbols, most).select("id", F.lit("symbol").alias("kind"), F.col("symbol").cast("string").alias("anchor")).distinct()
    return paths.unionByName(names)


def level_tokens(symbols: DataFrame) -> DataFrame:
    """(id, level, cost, value): what each level of detail of a symbol (id, signature, start_line, end_line) costs; of levels of equal cost
    only the most valuable."""
    sig = F.greatest(F.lit(LEAST_SIGNATURE), F.ceil(F.length("signature") / 4))
    whole = F.greatest(sig, (F.col("end_line") - F.col("start_line") + 1) * LINE_TOKENS)
    part = lambda share: sig + F.floor(F.lit(share) * (whole - sig))
    costs = {"signature": sig, "skeleton": part(SKELETON), "slice": part(SLICE), "implementation": whole}
    each = symbols.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.cast("bigint").alias("cost"), F.lit(VALUES[k]).alias("value")) for k, c in costs.items()])).alias("l")).select("id", "l.*")
    return each.groupBy("id", "cost").agg(F.max_by(F.struct("level", "value"), "value").alias("l")).select("id", "l.level", "cost", "l.value")


def ambiguity_hints(edges: DataFrame, symbols: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(name, candidates, total): symbols that an ambiguous name could mean, the first ``shown`` of them."""
    names = edges.filter("match = 'ambiguous'").select("name").distinct()
    tails = symbols.select("qualified", F.explode(F.array_distinct(F.array(F.col("qualified"), F.element_at(F.split("qualified", r"\."), -1)))).alias("name"))
    hit = names.join(tails, "name").withColumns({"rank": F.row_number().over(Window.partitionBy("name").orderBy("qualified")), "total": F.count("*").over(Window.partitionBy("name"))})
    return hit.filter(F.col("rank") <= shown).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qualified"))), lambda r: r["qualified"]), ",").alias("candidates"), F.max("total").alias("total"))


def dependency_candidates(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node, distance, branch, utility): what roots (root) depend on within two steps of surely resolved edges (src, dst, type, match,
    confidence), each with its best utility and the first step it is reached through. Roots that share nodes share the joins."""
    weight = F.coalesce(*[F.when(F.col("type") == k, F.lit(w)) for k, w in WEIGHTS.items()], F.lit(0.5))
    share = F.when(F.col("match").isin(*SOFT), SOFT_SHARE).otherwise(1.0)
    usable = edges.filter(F.col("match").isin(*HARD, *SOFT) & F.col("type").isin(*WEIGHTS)).select("src", "dst", (F.col("confidence") * weight * share).alias("worth")).groupBy("src", "dst").agg(F.max("worth").alias("worth"))
    usable = stored(usable, "usable")
    first = roots.join(usable, F.col("root") == F.col("src")).filter("dst <> root").select("root", F.col("dst").alias("node"), F.lit(1).alias("distance"), F.col("dst").alias("branch"), F.col("worth").alias("utility"))
    first = stored(first, "first_steps")
    onward = stored(usable.join(first.select(F.col("branch").alias("src")).distinct(), "src", "left_semi").select("src", "dst", (F.col("worth") * DECAY).alias("utility")), "onward")
    if onward.count() > FEW_STEPS:
        return walked_in_parts(first, onward)
    # few edges from first steps go everywhere. They are numbered from the best on, so that the best way to a node is the least of plain numbers; a step to
    # the branch itself has none. All that a root reaches is found and added up where the root's first steps are dealt to
    ways = stored(numbered(onward.withColumn("less", -F.col("utility")), "less", "src", "dst").select("src", "dst", "utility", "place"), "ways")
    own = first.select(F.col("branch").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(None).cast("bigint").alias("place"))
    steps = stored(ways.select("src", "dst", "place").unionByName(own), "steps")
    near = F.when(F.col("place").isNull(), F.col("near"))
    reached = first.select("root", F.col("branch").alias("src"), F.col("utility").alias("near")).repartition(1 + max(16 * first.sparkSession.sparkContext.defaultParallelism, first.count() // FIRST_STEPS), "root").join(few(steps), "src").filter("dst <> root")
    reached = reached.groupBy("root", "dst").agg(F.min("place").alias("place"), F.max(near).alias("near"))
    found = reached.join(few(ways.select("place", "src", "utility")), "place", "left")
    direct = F.col("near").isNotNull() & (F.col("utility").isNull() | (F.col("near") >= F.col("utility")))
    return found.select("root", F.col("dst").alias("node"), F.when(direct, 1).otherwise(2).alias("distance"), F.when(direct, F.col("dst")).otherwise(F.col("src")).alias("branch"), F.when(direct, F.col("near")).otherwise(F.col("utility")).alias("utility"))


def walked_in_parts(first: DataFrame, onward: DataFrame) -> DataFrame:
    """The same for any number of edges (onward: src, dst, utility) from first steps (root, branch, utility). What roots reach is many times their first
    steps, so only these and the edges move: roots near each other make a part of about ``WALKED`` second steps, and each part gets the edges of its
    branches once. A root's best ways are found where its part is."""
    steps = first.groupBy(F.col("branch").alias("src")).agg(F.count("*").alias("roots")).join(onward.groupBy("src").agg(F.count("*").alias("ends")), "src")
    parts = 1 + (steps.agg(F.sum(F.col("roots") * F.col("ends"))).first()[0] or 0) // WALKED
    first = stored(first.select("root", F.col("branch").alias("src"), F.col("utility").alias("near")).repartitionByRange(parts, "root").withColumn("part", F.spark_partition_id()), "parts")
    end = lambda node, utility: F.struct(node.alias("node"), utility.alias("utility"))
    starts = first.select("part", "src", F.struct("root", "near").alias("start"))
    ends = first.select("part", "src").distinct().join(onward, "src").select("part", "src", end(F.col("dst"), F.col("utility")).alias("end"))
    held = starts.unionByName(ends, allowMissingColumns=True).repartitionById(parts, F.col("part")).groupBy("part", "src").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    itself = F.array(end(F.col("src"), F.lit(None).cast("double")))
    ways = held.select("part", "src", F.explode("starts").alias("s"), F.concat(itself, "ends").alias("ends")).select("part", "src", "s.*", F.explode("ends").alias("e")).filter(F.col("e.node") != F.col("root"))
    order = F.struct((-F.coalesce("e.utility", "near")).alias("less"), F.when(F.col("e.utility").isNull(), 1).otherwise(2).alias("distance"), F.col("src").alias("branch"))
    best = ways.select("root", F.col("e.node").alias("node"), "part", order.alias("way")).groupBy("root", "node", "part").agg(F.min("way").alias("way"))
    return best.select("root", "node", "way.distance", "way.branch", (-F.col("way.less")).alias("utility"))


def few(steps: DataFrame) -> DataFrame:
    return F.broadcast(steps)  # at most ``FEW_STEPS`` edges, and as many branches


def select_bundle(candidates: DataFrame, levels: DataFrame, budget: int) -> DataFrame:
    """(root, node, level, spent): for each root its own implementation, then steps of detail of its candidates by value for cost while
    the running cost fits. Siblings of a branch count less by their rank in it; a step never precedes the cheaper ones of its symbol, so
    a larger budget holds all that a smaller one does. Roots that alone exceed the budget have no bundle."""
    # what a step adds and the worst value for cost up to it do not depend on the root, so each symbol's ladder is worked out once
    ladder = Window.partitionBy("id").orderBy("cost")
    steps = levels.withColumns({"step_cost": F.col("cost") - F.coalesce(F.lag("cost").over(ladder), F.lit(0)), "step_value": F.col("value") - F.coalesce(F.lag("value").over(ladder), F.lit(0.0)), "no": F.row_number().over(ladder)})
    steps = steps.withColumn("worst", F.min(F.struct((F.col("step_value") / F.col("step_cost")).alias("ratio"), F.col("step_cost").alias("cost"), F.col("step_value").alias("value"))).over(ladder))
    steps = stored(steps.select(F.col("id").alias("node"), "level", "cost", "step_cost", "no", F.col("worst.cost").alias("worst_cost"), F.col("worst.value").alias("worst_value")), "steps")
    roots = stored(steps.groupBy(F.col("node").alias("root")).agg(F.max("cost").alias("root_cost")).filter(F.col("root_cost") <= budget), "root_costs")
    least = steps.filter("no = 1").agg(F.min("worst_cost")).first()[0] or 1
    # only symbols that are candidates at all have their steps looked up. Candidates, many for each root, are worked out again rather than kept, and
    # stay where they come by root
    steps = stored(steps.join(candidates.select("node").distinct(), "node", "left_semi"), "asked_steps")
    first = steps.filter("no = 1").select("node", F.col("worst_cost").alias("first_cost"), F.col("worst_value").alias("first_value"))
    gain = lambda value, cost: F.round(F.col("worth") * F.col(value) / F.col(cost), 12)
    rank = F.row_number().over(Window.partitionBy("root", "branch").orderBy(F.desc("utility"), "node"))
    c = candidates.select("root", "node", "branch", "utility").join(roots.hint("shuffle_hash"), "root").join(first, "node", "left").withColumn("worth", F.col("utility") * F.pow(F.lit(DECAY), rank - 1))
    # gains fall along a ladder and every first step costs at least ``least``: symbols that rank beyond what the budget holds of first steps cannot fit.
    # The first candidate, whether it fits or not, brings its root along
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc(gain("first_value", "first_cost")), "node"))
    c = c.withColumn("place", place).filter((F.col("place") == 1) | F.col("first_cost").isNotNull() & (F.col("place") <= F.floor((budget - F.col("root_cost")) / least) + 1)).select("root", "node", "root_cost", "worth", (F.col("place") == 1).alias("leads"))
    c = c.join(steps, "node", "left").withColumn("gain", gain("worst_value", "worst_cost"))
    order = Window.partitionBy("root").orderBy(F.desc("gain"), "node", "cost").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("spent", F.col("root_cost") + F.sum("step_cost").over(order)).withColumn("spent", F.when(F.col("step_cost").isNotNull() & (F.col("spent") <= budget), F.col("spent"))).filter("leads or spent is not null")
    chosen = c.groupBy("root", "node").agg(F.max_by("level", F.when(F.col("spent").isNotNull(), F.col("cost"))).alias("level"), F.max("spent").alias("spent"), F.max(F.when(F.col("leads"), F.col("root_cost"))).alias("root_cost"))
    row = lambda node, level, spent: F.struct(F.col(node).alias("node"), level.alias("level"), F.col(spent).alias("spent"))
    found = F.array(F.when(F.col("spent").isNotNull(), row("node", F.col("level"), "spent")), F.when(F.col("root_cost").isNotNull(), row("root", F.lit("implementation"), "root_cost")))
    return chosen.select("root", F.explode(F.array_compact(found)).alias("r")).select("root", "r.*")


def materialization_quality(symbols: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(id, quality) of symbols (id, parser, start_line, end_line, byte_size, stored_lines): whether a stored body is surely whole."""
    full = F.col("byte_size") <= most_chars
    short = ~full & (F.col("stored_lines") < F.col("end_line") - F.col("start_line") + 1)
    cut = (F.col("byte_size") > 4 * most_chars) | short
    known = F.when(F.col("parser") == "python_ast", "complete_ast").when(F.col("parser") == "tree_sitter", "complete_tree_sitter")
    return symbols.select("id", F.when(cut, "truncated").when(F.col("parser") == "regex_heuristic", "declaration_only_heuristic").when(known.isNotNull(), F.when(full, known).otherwise("unverified")).otherwise("unknown").alias("quality"))


def coedit_relations(edited: DataFrame, edges: DataFrame, paths: DataFrame, max_hop: int = 2) -> DataFrame:
    """(relation, pairs) over all ordered pairs of symbols that one task edited (task, symbol): a depends on b, b on a, a test of b or the
    other way, the same file, or none. What a symbol can be at all (start or end of a dependency or a test) comes with it, so that pairs
    without any edge are counted where they meet; only the others are looked up, and walked from one end towards the other."""
    walk = stored(edges.filter(F.col("type").isin(*WEIGHTS)).select("src", "dst").distinct(), "edges")
    tested = stored(edges.filter("type = 'TESTED_BY'").select("src", "dst").distinct(), "tests")
    ends = [(walk, "src", 1), (walk, "dst", 2), (tested, "src", 4), (tested, "dst", 8)]
    roles = reduce(DataFrame.unionByName, [t.select(F.col(c).alias("symbol"), F.lit(bit).alias("role")) for t, c, bit in ends]).groupBy("symbol").agg(F.bit_or("role").alias("roles"))
    facts = stored(paths.select("symbol", "path").join(roles, "symbol", "full"), "facts")
    e = edited.select("task", "symbol").distinct().join(facts, "symbol", "left")
    side = lambda c: e.select("task", F.col("symbol").alias(c), F.col("path").alias(f"path_{c}"), F.coalesce("roles", F.lit(0)).alias(f"roles_{c}"))
    has = lambda c, bit: F.col(f"roles_{c}").bitwiseAND(bit) > 0
    linked = reduce(lambda x, y: x | y, [has(x, start) & has(y, 2 * start) for start in (1, 4) for x, y in ("ab", "ba")])
    same = F.coalesce(F.col("path_a") == F.col("path_b"), F.lit(False))
    pairs = side("a").join(side("b"), "task").filter("a < b")  # each pair once; both its orders are told apart at the end
    counted = stored(pairs.groupBy(F.when(linked, F.col("a")).alias("a"), F.when(linked, F.col("b")).alias("b"), same.alias("same")).agg(F.count("*").alias("n")), "pairs")

    own = counted.filter("a is not null")
    asked = own.select("a", "b").distinct()
    turned = lambda rows: rows.select(F.col("b").alias("a"), F.col("a").alias("b"))
    front, down = asked.unionByName(turned(asked)).withColumn("node", F.col("a")), None
    for hop in range(1, max_hop + 1):
        front = stored(front, "front")
        hit = front.join(walk, (F.col("node") == F.col("src")) & (F.col("b") == F.col("dst"))).select("a", "b")
        down = hit if down is None else down.unionByName(hit)
        front = front.join(walk, F.col("node") == F.col("src")).select("a", "b", F.col("dst").alias("node")).distinct() if hop < max_hop else front
    down = stored(down.distinct(), "depends")
    tests = tested.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    flag = lambda rows, name: rows.withColumn(name, F.lit(True))
    found = own.join(flag(down, "down"), ["a", "b"], "left").join(flag(turned(down), "up"), ["a", "b"], "left").join(flag(tests.unionByName(turned(tests)).distinct(), "tests"), ["a", "b"], "left")
    other = F.when(F.col("same"), "same_file").otherwise("none")
    told = lambda one, two: F.when(F.col(one), "callee").when(F.col(two), "caller").when(F.col("tests"), "test").otherwise(other)
    every = found.select(F.explode(F.array(told("down", "up"), told("up", "down"))).alias("relation"), "n").unionByName(counted.filter("a is null").select(other.alias("relation"), (2 * F.col("n")).alias("n")))
    return every.groupBy("relation").agg(F.sum("n").alias("pairs"))


def filled(pool: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """(task, budget, id): what each budget takes of a task's pool (task, id, rank, cost) by rank; one that does not fit is passed over and cheaper
    ones may follow. A task's pool is folded in one row."""
    return folded(pool, budgets).select("task", "budget", F.explode("ids").alias("id"))


def folded(pool: DataFrame, budgets: tuple[int, ...], begun: DataFrame | None = None) -> DataFrame:
    """(task, budget, used, ids): the same as one row for each task and budget, with what it costs. ``begun`` has such rows of a pool that comes before."""
    rows = pool.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "cost"))).alias("items")).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    none = F.array().cast("array<bigint>")
    used, ids = F.lit(0).cast("bigint"), none
    if begun is not None:
        rows = rows.join(begun, ["task", "budget"], "full")
        used, ids = F.coalesce("used", used), F.coalesce("ids", none)
    fits = lambda s, x: s["used"] + x["cost"] <= F.col("budget")
    take = lambda s, x: F.struct((s["used"] + F.when(fits(s, x), x["cost"]).otherwise(0)).cast("bigint").alias("used"), F.when(fits(s, x), F.concat(s["ids"], F.array(x["id"].cast("bigint")))).otherwise(s["ids"]).alias("ids"))
    start = F.struct(used.alias("used"), ids.alias("ids"))
    fold = F.when(F.col("items").isNull(), start).otherwise(F.aggregate("items", start, take))
    return rows.select("task", "budget", fold.alias("t")).select("task", "budget", "t.*")


def recalled(needed: DataFrame, taken: DataFrame, budgets: tuple[int, ...], by: str = "task") -> DataFrame:
    """Per task and budget: needed symbols (task, id, and there: not null where the pool holds it), those that are there, and those taken (by, budget, id)."""
    hit = [F.max(F.when(F.col("budget") == b, 1)).alias(f"hit{k}") for k, b in enumerate(budgets)]
    found = needed.join(taken.groupBy(by, "id").agg(*hit), [by, "id"], "left")  # needed symbols once, not for each budget
    counts = found.groupBy("task").agg(F.count("*").alias("needed"), F.count("there").alias("reachable"), *[F.count(f"hit{k}").alias(f"n{k}") for k in range(len(budgets))])
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"n{k}").alias("included")) for k, b in enumerate(budgets)])
    return counts.select("task", "needed", "reachable", F.explode(each).alias("e")).select("task", "e.budget", "needed", "reachable", "e.included")


def task_recall(needed: DataFrame, pool: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """Per task and budget: needed (task, id) symbols, those that the pool (task, id, rank, cost) holds at all, and those within the budget, taken
    by rank (``filled``)."""
    n = needed.select("task", "id").distinct().join(pool.select("task", "id").distinct().withColumn("there", F.lit(1)), ["task", "id"], "left")
    return recalled(n, filled(pool, budgets), budgets)


def support_recall(recalls: DataFrame) -> DataFrame:
    """Per budget over all tasks: what of the needed symbols the pools hold at all, and within the budget."""
    s = recalls.groupBy("budget").agg(*[F.sum(c).alias(c) for c in ("needed", "reachable", "included")])
    return s.withColumns({"ceiling": F.round(F.col("reachable") / F.col("needed"), 4), "recall": F.round(F.col("included") / F.col("needed"), 4)})


def compile_scores(recalls: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per regime (task, regime) and budget: tasks, and the means over them of ceiling and recall."""
    r = recalls.join(regimes, "task")
    return r.groupBy("regime", "budget").agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("reachable") / F.col("needed")), 4).alias("mean_ceiling"), F.round(F.avg(F.col("included") / F.col("needed")), 4).alias("mean_recall"))
