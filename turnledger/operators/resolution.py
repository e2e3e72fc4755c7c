"""Names to symbols: edges by scope, anchors of tasks by their strongest signal, and candidate pools from their relations.

Symbols are (id, qualified, kind, module, path, start_line, end_line). Their look-up tables have one row for each name in its scope and are
written once, so a frequent name on the asking side meets one row and can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators import bundles, graph
from turnledger.operators.usage import LINE_BLOCK, line_blocks
from turnledger.session import stored

#: What is left of an edge's certainty when its name is a single guess, ambiguous or unknown; kinds of symbols by scope;
#: edges that become dependencies; matches that do, and those of them that are only guesses.
INFERRED, AMBIGUOUS, UNRESOLVED = 0.9, 0.45, 0.7
CLASS_KINDS, MODULE_KINDS, DEFINED = ("method", "test"), ("function", "class"), ("class", "function", "method", "interface", "type")
DEPENDING, DEPENDABLE, SOFT = ("CALLS", "IMPLEMENTS", "IMPORTS"), ("exact", "scoped", "inferred"), ("inferred",)
#: A traceback's frame, a reference to a line of a file, an identifier, and identifiers that say nothing of a place.
FRAME, FILE_LINE, IDENTIFIER = r'File "([^"]+)", line (\d+)', r"([\w./-]+\.py):(\d+)", r"[A-Za-z_][A-Za-z0-9_]{2,}"
STOP = (
    "the and for with this that from into your when will been have has are was were error errors bug issue fix test tests should would could return "
    "returns value values true false none null self cls def class async await import object list dict str int bool type kind name path line code file "
    "files data field fields model models django python method function call calls"
).split()
#: Ranks of the relations of a candidate, closest first, and the relations of each layer; a layer holds those before it.
RANKS = {"structural": (1, 2), "same_class": 3, "identifier": 4, "co_change": 4, "same_file": 5, "test": 6, "lexical": 7}
LAYERS = ("structural", "local", "task")
#: Ranks and relations from the closest on; equal ranks go by name.
PLACES = sorted((rank, name) for name, ranks in RANKS.items() for rank in (ranks if isinstance(ranks, tuple) else (ranks,)))


def last_part(name: str | Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def scope_of(name: str | Column) -> Column:
    """All but the last part of a dotted name; null where it has one part."""
    return F.nullif(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), F.lit(""))


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, name, type, dst, match, ambiguity, confidence) of every edge (src, module, scope, name, type, confidence).

    A name is looked up as it is (exact); then its last part among the methods and tests of the edge's class ``scope``, then among the
    functions and classes of its module (scoped); then among all short names: one symbol is a guess (inferred), several are not chosen from
    (ambiguous, ``dst`` says so), none is unresolved. Of symbols that share a name in a scope the greatest id counts. The confidence is the
    edge's own, less a fixed share for guesses, to three places.
    """
    s = symbols.select("id", "qualified", "kind", "module", last_part("qualified").alias("short"), scope_of("qualified").alias("parent"))
    table = lambda rows, keys, name: stored(rows.groupBy(*[F.col(a).alias(b) for a, b in keys.items()]).agg(F.max("id").alias(name), F.count("*").alias("n")), name)
    exact = table(s, {"qualified": "name"}, "exact_id").drop("n")
    member = table(s.filter(F.col("kind").isin(*CLASS_KINDS)), {"parent": "scope", "short": "short"}, "class_id").drop("n")
    sibling = table(s.filter(F.col("kind").isin(*MODULE_KINDS)), {"module": "module", "short": "short"}, "module_id").drop("n")
    short = table(s, {"short": "short"}, "short_id")
    e = edges.withColumn("short", last_part("name")).join(exact, "name", "left").join(member, ["scope", "short"], "left").join(sibling, ["module", "short"], "left").join(short, "short", "left")
    scoped = F.coalesce("class_id", "module_id")
    match = F.when(F.col("exact_id").isNotNull(), "exact").when(scoped.isNotNull(), "scoped").when(F.col("n") == 1, "inferred").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    is_ = lambda m: F.col("match") == m
    dst = F.when(is_("exact"), F.col("exact_id").cast("string")).when(is_("scoped"), scoped.cast("string")).when(is_("inferred"), F.col("short_id").cast("string")).otherwise(F.concat("match", F.lit(":"), "short"))
    share = F.when(is_("inferred"), INFERRED).when(is_("ambiguous"), AMBIGUOUS).when(is_("unresolved"), UNRESOLVED).otherwise(1.0)
    return e.withColumn("match", match).select("src", "name", "type", dst.alias("dst"), "match", F.when(F.col("match").isin("inferred", "ambiguous"), F.col("n")).otherwise(0).cast("bigint").alias("ambiguity"), F.round(F.col("confidence") * share, 3).alias("confidence"))


def with_dependencies(resolved: DataFrame) -> DataFrame:
    """Resolved edges and the DEPENDS_ON edges that follow from them, with ``soft``: true for a dependency that rests on a guess, which no
    bundle must hold. Ambiguous and unresolved names give none."""
    derived = resolved.filter(F.col("match").isin(*DEPENDABLE) & F.col("type").isin(*DEPENDING)).withColumn("type", F.lit("DEPENDS_ON"))
    return resolved.withColumn("soft", F.lit(None).cast("boolean")).unionByName(derived.withColumn("soft", F.col("match").isin(*SOFT)))


def resolution_report(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per language (symbols: id, language): symbols, edges from them, edges by match, and the mean confidence to three places. The mean is taken over
    whole thousandths, so it does not depend on the order of rows."""
    own = symbols.select(F.col("id").alias("src"), "language")
    found = resolved.join(own, "src")
    n = lambda m: F.sum(F.when(F.col("match") == m, 1).otherwise(0)).alias(m)
    mean = F.round(F.sum(F.round(F.col("confidence") * 1000).cast("bigint")) / F.count("*") / 1000, 3)
    edges = found.groupBy("language").agg(F.count("*").alias("edges"), *map(n, ("exact", "scoped", "inferred", "ambiguous", "unresolved")), mean.alias("mean_confidence"))
    return symbols.groupBy("language").agg(F.count("*").alias("symbols")).join(edges, "language", "left").fillna(0, ["edges", "exact", "scoped", "inferred", "ambiguous", "unresolved"])


def text_signals(texts: DataFrame) -> DataFrame:
    """(id, text) with what a text says of a place: trace_path and trace_line (its last frame), path and line (its first reference to a line)."""
    frame = F.try_element_at(F.regexp_extract_all("text", F.lit(f"({FRAME})"), F.lit(1)), F.lit(-1))
    none = lambda c: F.nullif(c, F.lit(""))
    frames = F.size(F.regexp_extract_all("text", F.lit(FRAME), F.lit(1))) > 0
    at = lambda k: none(F.when(frames, F.regexp_extract(frame, FRAME, k)))
    return texts.select("id", "text", at(1).alias("trace_path"), at(2).cast("bigint").alias("trace_line"), none(F.regexp_extract("text", FILE_LINE, 1)).alias("path"), none(F.regexp_extract("text", FILE_LINE, 2)).cast("bigint").alias("line"))


def best_symbol(order: list[Column]) -> Column:
    return F.min_by("symbol", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))


def least(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """(keys, rank, symbol): of each key's symbols the one with the least whole number ``rank``, then the least itself. Both aggregates hold plain
    numbers, so they are hashed; the least of a struct would sort all rows before it drops any."""
    best = rows.groupBy(*keys, rank.cast("bigint").alias("rank")).agg(F.min("symbol").alias("symbol"))
    return best.groupBy(*keys).agg(F.min_by("symbol", "rank").alias("symbol"), F.min("rank").alias("rank"))


def in_order(flags: list[Column], size: Column) -> Column:
    """Flags (null before 0 before 1), then a size, as one whole number."""
    high = F.lit(0).cast("bigint")
    for f in flags:
        high = high * 3 + F.coalesce(f.cast("bigint"), F.lit(-1)) + 1
    return high * F.lit(1 << 32) + size


def resolve_anchors(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, symbol, anchor) of each task (id, text, trace_path, trace_line, path, line, symbol_name): the first signal that leads to a symbol.

    In order: the traceback's last frame; path and line; a symbol's name (whole or its last parts; with a path, symbols of that path come
    first); a path alone (its module, else its longest symbol); words of the text (last part of a name before other parts, definitions before
    others, short names first). Paths match when one ends in the other. Without any, ``anchor`` is unresolved.

    Symbols meet only names and words that a task has, and those with the same lines of a file become one, before lines, paths and tasks meet them.
    """
    s = stored(symbols.select(F.col("id").alias("symbol"), "qualified", "kind", "path", "start_line", "end_line", F.length("qualified").alias("size"), (~F.col("kind").isin(*DEFINED)).cast("int").alias("other")), "symbols")
    t = stored(tasks.select("id", "text", "trace_path", "trace_line", "path", "line", "symbol_name"), "tasks")
    asked = t.select(F.explode(F.array("trace_path", "path")).alias("path")).filter("path is not null").distinct()
    pairs = stored(graph.suffix_path_join(asked, s.select("path").filter("path is not null").distinct()).select(F.col("path").alias("asked_path"), F.col("other").alias("path")), "paths")
    span = F.col("end_line") - F.col("start_line")
    lines = s.filter("path is not null and start_line is not null and end_line is not null")

    places = t.select(F.explode(F.array(F.struct(F.col("trace_path").alias("path"), F.col("trace_line").alias("line")), F.struct("path", "line"))).alias("p")).select(F.col("p.path").alias("asked_path"), "p.line").filter("asked_path is not null and line is not null").distinct()
    spans = stored(least(lines, ["path", "start_line", "end_line"], F.coalesce(-F.col("size"), F.lit(-(1 << 32)))), "spans")
    blocks = spans.withColumn("block", F.explode(line_blocks(F.col("start_line"), F.col("end_line"))))
    hit = places.withColumn("block", F.floor(F.col("line") / LINE_BLOCK)).join(pairs, "asked_path").join(blocks, ["path", "block"]).filter("line between start_line and end_line")
    at = stored(hit.groupBy(F.col("asked_path").alias("path"), "line").agg(best_symbol([span, -F.col("start_line"), F.col("rank"), F.col("symbol")]).alias("symbol")), "at")

    parts = F.split("qualified", r"\.")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, k, F.size(parts)), ".").alias("name"), (k > 1).cast("int").alias("part"))))
    by_name = t.filter("symbol_name is not null").select("id", F.col("symbol_name").alias("name"), F.col("path").alias("asked_path"))
    names = stored(by_name.select("name").distinct(), "names")
    named = s.select("symbol", "path", "other", "size", tails.alias("t")).select("symbol", "path", "other", "size", "t.*").join(names, "name", "left_semi")
    named = stored(least(named, ["name", "path", "part"], in_order([F.col("part"), F.col("other")], F.col("size"))), "named")
    anywhere = stored(least(named, ["name"], F.col("rank")).join(named.groupBy("name").agg(F.min("part").alias("part")), "name").drop("rank"), "anywhere")
    usable = named.join(anywhere.select("name", "part"), ["name", "part"], "left_semi")  # a whole name leaves no choice
    in_path = stored(least(usable.join(pairs, "path"), ["name", "asked_path"], F.col("rank")).drop("rank"), "in_path")

    shortness = F.lit(1 << 31) - span
    files = least(lines, ["path"], in_order([(F.col("kind") != "module").cast("int")], shortness))
    whole_file = stored(least(files.join(pairs, "path"), ["asked_path"], F.col("rank")).select(F.col("asked_path").alias("path"), "symbol"), "files")

    said = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"), F.lit(1))), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*STOP))
    spoken = t.select("id", F.explode(said).alias("word"))
    heard = stored(spoken.select("word").distinct(), "heard")
    pieces = s.select("symbol", "other", "size", F.posexplode(parts).alias("k", "word"), F.size(parts).alias("parts")).join(heard, "word", "left_semi").withColumn("inner", (F.col("k") + 1 < F.col("parts")).cast("int"))
    words = stored(least(pieces, ["word"], in_order([F.col("inner"), F.col("other")], F.col("size"))), "words")
    free = least(spoken.join(words, "word"), ["id"], F.col("rank"))

    #: Signals from the strongest on; a task has at most one symbol by each, and of the two by name only one.
    anchors = ("traceback", "path_line", "symbol", "path_symbol", "file", "freetext")
    found = lambda rows, order: rows.select("id", (F.lit(order) if isinstance(order, int) else order).alias("order"), "symbol")
    every = found(t.join(at.withColumnsRenamed({"path": "trace_path", "line": "trace_line"}), ["trace_path", "trace_line"]), 0)
    every = every.unionByName(found(t.join(at, ["path", "line"]), 1))
    near = by_name.join(in_path, ["name", "asked_path"], "left").join(anywhere.select("name", F.col("symbol").alias("far")), "name").withColumn("symbol", F.coalesce("symbol", "far"))
    every = every.unionByName(found(near, F.when(F.col("asked_path").isNull(), 2).otherwise(3)))
    every = every.unionByName(found(t.filter("line is null").join(whole_file, "path"), 4)).unionByName(found(free, 5))
    first = every.groupBy("id").agg(F.min_by("symbol", "order").alias("symbol"), F.min("order").alias("order"))
    name = F.get(F.array(*map(F.lit, anchors)), F.col("order"))
    return t.select("id").join(first, "id", "left").select("id", "symbol", F.coalesce(name, F.lit("unresolved")).alias("anchor"))


def alike(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with the same anchors have the same pool: (task, like) of every task, and the anchors (task, anchor) of those that stand for others."""
    sets = stored(anchors.filter("task is not null and anchor is not null").groupBy("task").agg(F.array_sort(F.collect_set("anchor")).alias("anchors")), "anchors")
    first = stored(sets.groupBy("anchors").agg(F.min("task").alias("like")), "alike")
    return sets.join(first, "anchors").select("task", "like"), first.select(F.col("like").alias("task"), F.explode("anchors").alias("anchor"))


def relations(a: DataFrame, symbols: DataFrame, edges: DataFrame, co_changed: DataFrame, layer: str = "task") -> list[tuple[DataFrame, DataFrame]]:
    """What relates tasks to symbols, closest first: for each relation the keys of tasks (task, key) and of symbols (key, id, place). Long identifiers
    are identifiers of a closer rank already, so the task layer has no join of its own for them."""
    own = a.join(symbols.select(F.col("id").alias("anchor"), "qualified", "kind", "path", "text"), "anchor")
    place = lambda name, rank=None: F.lit(PLACES.index((rank or RANKS[name], name)))
    keys = lambda rows, key: rows.select("task", F.col(key).alias("key")).filter("key is not null").distinct()
    held = lambda rows, key, at: rows.select(F.col(key).alias("key"), "id", at.alias("place"))
    reach = graph.reachable(edges, a.select(F.col("anchor").alias("node")).distinct(), max(RANKS["structural"]), DEPENDING).filter("hop > 0")
    hops = F.when(F.col("hop") == 1, place("structural", 1)).otherwise(place("structural", 2))
    found = [(keys(a, "anchor"), held(reach.withColumnRenamed("node", "id"), "root", hops))]
    if layer != "structural":
        prefixes = symbols.select("id", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("qualified", r"\."))), lambda k: F.array_join(F.slice(F.split("qualified", r"\."), 1, k), ".")), lambda p: p != F.col("qualified"))).alias("scope"))
        methods = own.filter("kind = 'method'").select("task", scope_of("qualified").alias("scope"))
        names = symbols.select("id", last_part("qualified").alias("word"))
        words = own.select("task", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({IDENTIFIER})"), F.lit(1)))).alias("word"))
        files = own.select("task", "path").distinct()
        found += [(keys(methods, "scope"), held(prefixes, "scope", place("same_class"))), (keys(words, "word"), held(names, "word", place("identifier"))), (keys(files, "path"), held(symbols, "path", place("same_file")))]
        if layer == "task":
            other = files.join(co_changed.select("path", "other"), "path")
            tests = edges.filter("type = 'TESTED_BY'").select("src", "dst").distinct()
            both = tests.select(F.col("src").alias("anchor"), F.col("dst").alias("id")).unionByName(tests.select(F.col("dst").alias("anchor"), F.col("src").alias("id")))
            found += [(keys(other, "other"), held(symbols, "path", place("co_change"))), (keys(a, "anchor"), held(both, "anchor", place("test")))]
    return found


def related(pairs: list[tuple[DataFrame, DataFrame]], a: DataFrame) -> DataFrame:
    """(task, id, place): the closest place of each symbol that a task's keys lead to. The rows of a task come together once, and places are plain numbers."""
    return closest([own.join(held, "key").select("task", "id", "place") for own, held in pairs], a)


def closest(every: list[DataFrame], a: DataFrame) -> DataFrame:
    pool = every[0]
    for rows in every[1:]:
        pool = pool.unionByName(rows)
    return pool.repartition("task").groupBy("task", "id").agg(F.min("place").alias("place")).join(a.withColumnRenamed("anchor", "id"), ["task", "id"], "left_anti")


def placed(best: DataFrame) -> DataFrame:
    """(task, id, rank, relation) of places."""
    at = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in PLACES]), F.col("place") + 1)
    return best.select("task", "id", at(0).cast("bigint").alias("rank"), at(1).alias("relation"))


def spread(symbols: DataFrame) -> DataFrame:
    """Symbols dealt over the cores: each meets many tasks, so that few of them are much work."""
    return symbols.repartition(4 * symbols.sparkSession.sparkContext.defaultParallelism, "id")


def pool_from_sources(anchors: DataFrame, symbols: DataFrame, edges: DataFrame, co_changed: DataFrame, layer: str = "task") -> DataFrame:
    """(task, id, rank, relation): symbols related to a task's anchors (task, anchor), each with its closest relation; anchors themselves are none.

    Layers are nested: ``structural`` has what anchors reach in one or two steps of CALLS, IMPORTS and IMPLEMENTS edges; ``local`` adds members
    of a method's class, symbols named in an anchor's text (symbols: text) and those of its file; ``task`` adds files that changed with an anchor's file
    (co_changed: path, other), tests, and long identifiers. Every relation is an equi join on what it shares. Pools are worked out once for all tasks
    with the same anchors, and dealt out to these at last.
    """
    members, a = alike(anchors)
    best = placed(related(relations(a, spread(symbols), edges, co_changed, layer), a)).withColumnRenamed("task", "like")
    return members.join(best, "like").select("task", "id", "rank", "relation")


def pool_recall(needed: DataFrame, anchors: DataFrame, symbols: DataFrame, edges: DataFrame, co_changed: DataFrame, budgets: tuple[int, ...], layer: str = "task") -> DataFrame:
    """``bundles.task_recall`` of needed (task, id) symbols in the pools of ``pool_from_sources`` (symbols also: cost, not negative), without the pools.

    Of symbols that cost the same a budget takes the first ones, at most as many as it can pay: room only shrinks, so after one that does not fit
    none of that cost does. Thus of those that share a key and a place, only the first ``budget / cost`` (and as many as a task has anchors) can
    be taken; the others change nothing. The closest relation goes first. Where it leaves little room, the others are asked for no more than that
    room can pay (and as many as are taken already), and where it leaves none, for nothing. Whether a needed symbol is in the pool is asked of
    the keys of both.
    """
    members, a = alike(anchors)
    a = stored(a, "standing")
    symbols = stored(symbols.select("id", "qualified", "kind", "path", "text", "cost"), "symbols")
    pairs = [(stored(own, "keys"), held) for own, held in relations(a, spread(symbols), edges, co_changed, layer)]
    most, own_most = max(budgets), a.groupBy("task").count().agg(F.max("count")).first()[0] or 0
    first = Window.partitionBy("key", "place", "cost").orderBy("id")
    costs = symbols.select("id", "cost").filter(F.col("cost") <= most)
    can_pay = lambda room, more: (F.col("cost") <= 0) | (F.col("no") <= F.floor(room / F.col("cost")) + more)
    payable = lambda held: held.join(costs, "id").withColumn("no", F.row_number().over(first)).filter(can_pay(F.lit(most), own_most))

    def offered(pool: DataFrame) -> DataFrame:
        ranked = pool.join(costs, "id").withColumn("rank", F.element_at(F.array(*[F.lit(r) for r, _ in PLACES]), F.col("place") + 1))
        return ranked.withColumn("no", F.row_number().over(Window.partitionBy("task", "cost").orderBy("rank", "id"))).filter(can_pay(F.lit(most), 0)).select("task", "id", "rank", "cost")

    (own, held), *others = pairs
    taken = begun = stored(bundles.folded(offered(related([(own, payable(held).select("key", "id", "place"))], a)), budgets), "begun")
    if others:
        room = begun.groupBy("task").agg(F.max(F.col("budget") - F.col("used")).alias("room"), F.max(F.size("ids")).alias("taken"))
        room = a.select("task").distinct().join(room, "task", "left").select("task", F.coalesce("room", F.lit(most)).alias("room"), F.coalesce("taken", F.lit(0)).alias("taken"))
        room = stored(room.filter(F.col("room") >= (costs.agg(F.min("cost")).first()[0] or 0)), "room")
        fits = (F.col("cost") <= F.col("room")) & can_pay(F.col("room"), F.col("taken") + own_most)
        rest = closest([own.join(room, "task").join(payable(held), "key").filter(fits).select("task", "id", "place") for own, held in others], a)
        rest = rest.join(begun.select("task", F.explode("ids").alias("id")).distinct(), ["task", "id"], "left_anti")  # passed over once, never fits again
        taken = bundles.folded(offered(rest), budgets, begun)
    taken = taken.select(F.col("task").alias("like"), "budget", F.explode("ids").alias("id"))

    n = stored(needed.select("task", "id").distinct().join(members, "task", "left"), "needed")
    asked = n.filter("like is not null").select(F.col("like").alias("task"), "id").distinct().join(symbols.select("id"), "id", "left_semi").join(a.withColumnRenamed("anchor", "id"), ["task", "id"], "left_anti")
    asked = stored(asked, "asked")
    # where an anchor is the key a task has few of them, and a symbol any number; all other keys are few for a symbol
    anchored = (0, len(pairs) - 1) if layer == "task" else (0,)
    by_task = lambda own, held: asked.join(own, "task").join(held.select("key", "id"), ["key", "id"], "left_semi")
    by_symbol = lambda own, held: asked.join(held.select("key", "id"), "id").join(own, ["task", "key"], "left_semi")
    there = [(by_task if k in anchored else by_symbol)(own, held).select("task", "id") for k, (own, held) in enumerate(pairs)]
    reached = there[0]
    for rows in there[1:]:
        reached = reached.unionByName(rows)
    reached = reached.distinct().select(F.col("task").alias("like"), "id", F.lit(1).alias("there"))
    return bundles.recalled(n.join(reached, ["like", "id"], "left"), taken, budgets, "like")
