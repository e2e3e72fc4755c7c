"""Graph jobs by joins: reachability, proximity, co-change and path matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored

#: About so many pairs are added up in one task.
PAIRS = 250_000


def reachable(edges: DataFrame, roots: DataFrame, max_hop: int = 3, types: tuple[str, ...] | None = None) -> DataFrame:
    """(root, node, hop): the fewest hops, up to ``max_hop``, along edges of the given types. Nodes once found are not walked again."""
    e = stored((edges if types is None else edges.filter(F.col("type").isin(*types))).select("src", "dst").distinct(), "edges")
    found = front = stored(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop")).distinct(), "front")
    for hop in range(1, max_hop + 1):
        new = front.join(e, front["node"] == e["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = stored(new.join(found, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), "front")
        found = found.unionByName(front)
    return found


def proximity(edges: DataFrame, roots: DataFrame, max_hop: int = 3, decay: float = 0.6) -> DataFrame:
    """(node, score): the best product of decay, edge weight and confidence (1 where edges have none) over walks of at most ``max_hop``
    steps, either way."""
    edges = edges.withColumn("weight", F.col("weight") * F.col("confidence")) if "confidence" in edges.columns else edges
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    both = stored(both, "edges")
    found = front = roots.select("node", F.lit(1.0).alias("score")).distinct()
    for _ in range(max_hop):
        front = front.join(both, front["node"] == both["src"]).groupBy("dst").agg(F.max(F.col("score") * decay * F.col("weight")).alias("score")).select(F.col("dst").alias("node"), "score")
        front = stored(front, "front")
        found = found.unionByName(front)
    return found.groupBy("node").agg(F.round(F.max("score"), 6).alias("score"))


def cochange_pairs(baskets: DataFrame, largest: int = 40, top: int = 100) -> DataFrame:
    """Pairs of items most often in one basket; baskets over ``largest`` items say nothing and are left out by definition."""
    return together(baskets, largest).orderBy(F.desc("together"), "item", "other").limit(top)


def cochange_neighbours(baskets: DataFrame, largest: int = 40, top: int = 5, before: str | None = None) -> DataFrame:
    """(item, rank, other, together): for each item those most often in a basket with it; only baskets ``before`` a time (column ts), if given."""
    pairs, parts = counted_together(baskets if before is None else baskets.filter(F.col("ts") < F.lit(before)), largest)
    orders = F.explode(F.array(F.struct("item", "other"), F.struct(F.col("other").alias("item"), F.col("item").alias("other")))).alias("p")
    both = pairs.select(orders, "together").select("p.*", "together").repartition(parts, "item")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("together"), "other"))).filter(F.col("rank") <= top)


def together(baskets: DataFrame, largest: int) -> DataFrame:
    """(item, other, together): how many baskets hold both."""
    return counted_together(baskets, largest)[0]


def counted_together(baskets: DataFrame, largest: int) -> tuple[DataFrame, int]:
    """``together``, and in how many parts its pairs are dealt. Pairs are many more than the rows that they come from, and those pack well, so partitions
    by size would give a task any number of pairs: parts are as many as pairs, known from the baskets' sizes, need. Baskets of at most ``largest`` items
    are one row each; the pairs of a part are added up before they leave it."""
    b = baskets.filter("basket is not null and item is not null").select("basket", "item").distinct()
    n = b.groupBy("basket").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= largest))
    b = stored(b.join(n, "basket"), "baskets")
    total = b.agg(F.sum(F.col("n") - 1)).collect()[0][0] or 0
    parts = 1 + total // 2 // PAIRS
    whole = b.withColumn("part", F.pmod(F.hash("basket"), F.lit(parts))).repartitionById(parts, F.col("part")).groupBy("part", "basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pair = F.explode(F.flatten(F.transform("items", lambda x, k: F.transform(F.slice("items", k + 2, F.size("items")), lambda y: F.struct(x.alias("item"), y.alias("other")))))).alias("p")
    local = whole.select("part", pair).select("part", "p.*").groupBy("part", "item", "other").agg(F.count("*").alias("n"))
    return local.repartition(parts, "item", "other").groupBy("item", "other").agg(F.sum("n").alias("together")), parts


def resolve_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of certain references to symbols: exact, then unique short name, else ambiguous or unresolved, with what is left of their certainty.
    ``resolution.resolve_edges`` also looks into scopes."""
    exact = symbols.groupBy(F.col("qualified").alias("name")).agg(F.min("id").alias("exact_id"))
    short = symbols.groupBy(F.col("short").alias("name")).agg(F.min("id").alias("short_id"), F.count("*").alias("n_short"))
    r = references.join(exact, "name", "left").join(short, "name", "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("n_short") == 1, "unique").when(F.col("n_short") > 1, "ambiguous").otherwise("unresolved")
    return r.withColumn("resolution", kind).select("src", "name", "resolution", F.when(F.col("resolution") == "exact", F.col("exact_id")).when(F.col("resolution") == "unique", F.col("short_id")).alias("dst"), F.when(F.col("resolution") == "exact", 1.0).when(F.col("resolution") == "unique", 0.9).when(F.col("resolution") == "ambiguous", 0.45).otherwise(0.7).alias("confidence"))


def suffix_path_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of paths where either ends in the other at a ``/``: suffixes of one side meet the other's whole path."""
    parts = F.split("path", "/")
    suffixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias(c)
    a = left.select("path", suffixes("suffix")).join(right.select(F.col("path").alias("other")), F.col("suffix") == F.col("other")).select("path", "other")
    b = right.select(F.col("path").alias("other"), suffixes("suffix")).join(left.select("path"), F.col("suffix") == F.col("path")).select("path", "other")
    return a.unionByName(b).distinct()


def index_report(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def pareto_front(points: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Points that no other beats on one axis without losing on the other. One aggregate for each x; ranges of x and the greatest y of the
    ranges above give the running maximum, so no task sorts all distinct x."""
    best = points.groupBy(x).agg(F.max(y).alias("best"))
    ranged = stored(best.repartitionByRange(F.desc(x)).withColumn("part", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("part").agg(F.max("best").alias("top"))
    tops = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("over"))  # one row for each range
    inside = F.max("best").over(Window.partitionBy("part").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    above = F.greatest(F.col("inside"), F.col("over"))
    front = ranged.withColumn("inside", inside).join(F.broadcast(tops), "part").filter(above.isNull() | (F.col("best") > above)).select(x, F.col("best").alias(y))
    return points.join(front, [x, y]).select(key, x, y)
