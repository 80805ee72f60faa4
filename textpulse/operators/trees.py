"""Decision trees grown and used as tables.

A tree is a table of nodes: ``(node, depth, feature, kind, threshold, categories, known, other, n, prediction, impurity,
gain, left, right)``; inner nodes have a feature, leaves have none. A number goes left up to the threshold, a category if
it is one of the categories, or with ``other`` if it is none of the known ones. The root is 1, the children of node i are
2 i and 2 i + 1. Growing it takes one aggregate per level over ``(node, feature, bin)``, so that the rows never leave their tasks and the
driver gets one row per node; using it routes rows level by level through a broadcast of the nodes, of which there
are fewer than 2 to the power of the depth.

Candidate thresholds of a number are quantiles of a bounded sample drawn by a hash of the row's key; a feature with few
distinct values in it is taken as categories, which are ordered by their mean target in each node. A value that the
sample does not hold is a category of its own. Equal gains go to the first feature and the smallest left side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textpulse.operators.sampling import draw
from textpulse.session import local_rows, stage

#: Rows drawn to find thresholds and categories.
SAMPLE_ROWS = 10_000
#: Digits of a gain that count, so that two splits that part the rows alike have the same gain.
GAIN_DIGITS = 9

_NODES = (
    "node long, depth int, feature int, kind string, threshold double, categories array<double>, known array<double>, other boolean, "
    "n long, prediction double, impurity double, gain double, left long, right long"
)


@dataclass
class Tree:
    nodes: DataFrame
    #: ``(feature, kind, edges)``: the thresholds or categories that were tried.
    bins: DataFrame
    #: Names of the features, in their order.
    features: list[str]


def _bin_table(sample: DataFrame, bins: int, max_categories: int) -> DataFrame:
    """``(feature, kind, edges)``: thresholds, or the values of a feature with few, in order."""
    values = sample.groupBy("feature").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    distinct = F.array_distinct("xs")
    n = F.size("xs")
    ranks = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.get(F.col("xs"), F.ceil(n * i / F.lit(float(bins))).cast("int") - 1))
    few = F.size(distinct) <= max_categories
    return values.select(
        "feature", F.when(few, "category").otherwise("number").alias("kind"), F.when(few, distinct).otherwise(F.array_distinct(ranks)).alias("edges")
    )


def _bin(x: Column, kind: Column, edges: Column) -> Column:
    """A number's bin is how many thresholds lie below it, a category's its place; an unknown one is in bin -1."""
    below = F.size(F.filter(edges, lambda e: e < x))
    place = F.array_position(edges, x).cast("int") - 1
    return F.when(kind == "number", below).otherwise(F.coalesce(place, F.lit(-1)))


def _impurity(n: Column, s: Column, q: Column, classes: bool) -> Column:
    """Gini impurity of a class with s ones among n, or the variance of numbers with sum s and sum of squares q."""
    mean = F.try_divide(s, n)
    return 2 * mean * (1 - mean) if classes else F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))


def _best_splits(binned: DataFrame, kinds: DataFrame, classes: bool, min_rows: int) -> DataFrame:
    """One row per node: its n, s, q and, where some split gains, the best one."""
    entry = F.posexplode("bins").alias("feature", "bin")
    cells = binned.select("node", "y", entry).groupBy("node", "feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")
    )
    cells = cells.join(F.broadcast(kinds.select("feature", "kind")), "feature")
    # Categories stand in the order of their mean, numbers in that of their bins.
    place = F.when(F.col("kind") == "category", F.round(F.col("s") / F.col("n"), GAIN_DIGITS)).otherwise(F.col("bin").cast("double"))
    by = W.partitionBy("node", "feature")
    upto = by.orderBy("place", "bin").rowsBetween(W.unboundedPreceding, 0)
    sums = cells.withColumn("place", place)
    sums = sums.withColumns({f"l{c}": F.sum(c).over(upto) for c in "nsq"} | {f"t{c}": F.sum(c).over(by) for c in "nsq"})
    sums = sums.withColumn("side", F.collect_list("bin").over(upto))
    rest = {c: F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq"}
    whole = _impurity(F.col("tn"), F.col("ts"), F.col("tq"), classes)
    left, right = _impurity(F.col("ln"), F.col("ls"), F.col("lq"), classes), _impurity(rest["n"], rest["s"], rest["q"], classes)
    allowed = (F.col("ln") >= min_rows) & (rest["n"] >= min_rows)
    gain = F.when(allowed, F.round(whole - F.col("ln") / F.col("tn") * left - rest["n"] / F.col("tn") * right, GAIN_DIGITS))
    scored = sums.withColumn("impurity", whole).withColumn("gain", gain)
    order = F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("ln"), -F.col("bin"))
    best = F.max_by(F.struct("tn", "ts", "impurity", "gain", "feature", "kind", "bin", "side"), order).alias("best")
    return scored.groupBy("node").agg(best).select("node", "best.*")


def grow_tree(
    df: DataFrame, features: list[str], target: str, key: str, classes: bool = True, depth: int = 5, bins: int = 32,
    max_categories: int = 10, min_rows: int = 1, seed: int = 1, sample_rows: int = SAMPLE_ROWS,
) -> Tree:
    """Grow a tree for a target of 0 and 1 (Gini) or a number (variance).

    ``features`` are columns of numbers or of lists of numbers, which count as one feature per place. Rows with a null
    feature or target teach nothing. A split needs ``min_rows`` rows on both sides and a gain.
    """
    spark = df.sparkSession
    listed = F.flatten(F.array(*[_as_list(df, c) for c in features]))
    rows = df.select(F.col(key).alias("key"), F.col(target).cast("double").alias("y"), listed.alias("x"))
    rows = stage(rows.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())), "tree-rows")
    total = rows.count()
    if not total:
        raise ValueError("no rows to learn from")
    share = min(1.0, sample_rows / total)
    sample = rows.where(draw("key", seed, "bins") < share).select(F.posexplode("x").alias("feature", "x"))
    kinds = stage(_bin_table(sample, bins, max_categories), "bins")
    edges = {r["feature"]: (r["kind"], r["edges"]) for r in kinds.collect()}  # features x bins numbers
    if not edges:
        raise ValueError("the sample holds no rows")
    table = kinds.agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "kind", "edges"))), lambda t: F.struct(t["kind"].alias("kind"), t["edges"].alias("edges")))).scalar()
    held = rows.withColumn("table", table)
    binned = held.select("key", "y", F.zip_with("x", "table", lambda x, t: _bin(x, t["kind"], t["edges"])).alias("bins"))
    current = stage(binned, "binned").withColumn("node", F.lit(1).cast("long"))
    out = []
    for level in range(depth + 1):
        splits = _best_splits(current, kinds, classes, min_rows).orderBy("node").collect()  # at most 2 ** level rows
        inner = []
        for r in splits:
            ends = level == depth or r["gain"] is None or r["gain"] <= 0
            mean = r["ts"] / r["tn"]
            told = (r["tn"], float(mean > 0.5) if classes else mean, r["impurity"])
            if ends:
                out.append((r["node"], level, *[None] * 6, *told, None, None, None))
                continue
            kind, found = edges[r["feature"]]
            side = sorted(r["side"])
            number = (float(found[r["bin"]]), None, None, None) if kind == "number" else ()
            test = number or (None, [float(found[b]) for b in side if b >= 0], [float(x) for x in found], -1 in side)
            out.append((r["node"], level, r["feature"], kind, *test, *told, r["gain"], 2 * r["node"], 2 * r["node"] + 1))
            inner.append((r["node"], r["feature"], kind, r["bin"], side))
        if not inner:
            break
        nodes = F.broadcast(local_rows(spark, inner, "node long, feature int, kind string, bin int, side array<int>"))
        met = current.join(nodes, "node")
        mine = F.get("bins", F.col("feature"))
        left = F.when(F.col("kind") == "number", mine <= F.col("bin")).otherwise(F.array_contains("side", mine))
        # Not stored: the next level goes through the nodes so far again, a broadcast join each.
        current = met.select("key", "y", "bins", (2 * F.col("node") + F.when(left, 0).otherwise(1)).alias("node"))
    return Tree(local_rows(spark, out, _NODES), kinds, _names(df, features, edges))


def _as_list(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.cast("array<double>") if df.schema[name].dataType.typeName() == "array" else F.array(column.cast("double"))


def _names(df: DataFrame, features: list[str], edges: dict) -> list[str]:
    """Names of the places: that of the column, with the place for lists."""
    lists = [c for c in features if df.schema[c].dataType.typeName() == "array"]
    rest = len(edges) - (len(features) - len(lists))
    if len(lists) > 1:
        return [f"feature {i}" for i in range(len(edges))]
    return [name for c in features for name in ([f"{c}[{i}]" for i in range(rest)] if c in lists else [c])]


def route(df: DataFrame, nodes: DataFrame, features: list[str], depth: int) -> DataFrame:
    """Adds ``leaf`` and ``prediction``: each row goes through the nodes level by level, one broadcast join each.

    The nodes are any table of that form, so a stored tree serves as well as a fresh one.
    """
    listed = F.flatten(F.array(*[_as_list(df, c) for c in features]))
    # There are fewer than 2 ** (depth + 1) nodes.
    inner = F.broadcast(nodes.where(F.col("feature").isNotNull()).select("node", "feature", "kind", "threshold", "categories", "known", "other"))
    rows = df.withColumn("__x", listed).withColumn("node", F.lit(1).cast("long"))
    for _ in range(depth):
        met = rows.join(inner, "node", "left")
        x = F.get("__x", F.col("feature"))
        named = F.array_contains("categories", x) | (F.col("other") & ~F.array_contains("known", x))
        left = F.when(F.col("kind") == "number", x <= F.col("threshold")).otherwise(named)
        down = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        rows = met.withColumn("__next", down).select(*df.columns, "__x", F.col("__next").alias("node"))
    leaves = F.broadcast(nodes.select("node", "prediction"))
    return rows.join(leaves, "node").select(*df.columns, F.col("node").alias("leaf"), "prediction")


def importances(tree: Tree) -> DataFrame:
    """``(feature, name, importance)``: gain times rows of a feature's splits, as shares of all."""
    names = local_rows(tree.nodes.sparkSession, list(enumerate(tree.features)), "feature int, name string")
    sums = tree.nodes.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum(F.col("gain") * F.col("n")).alias("total"))
    every = sums.agg(F.sum("total")).scalar()
    return sums.join(F.broadcast(names), "feature").select("feature", "name", (F.col("total") / every).alias("importance"))


def tree_text(tree: Tree) -> DataFrame:
    """``(line, text)``: the tree as text, a line per node, children below their parent."""
    names = local_rows(tree.nodes.sparkSession, list(enumerate(tree.features)), "feature int, name string")
    listed = F.array_join(F.transform("categories", lambda c: F.format_string("%.6f", c)), ", ")
    test = F.when(F.col("kind") == "number", F.format_string("%s <= %.6f", "name", "threshold")).otherwise(F.concat("name", F.lit(" in "), listed))
    says = F.when(F.col("feature").isNull(), F.format_string("predict %.6f (n %d)", "prediction", "n")).otherwise(F.concat(F.lit("if "), test, F.format_string(" (n %d)", "n")))
    lead = F.when((F.col("node") > 1) & (F.col("node") % 2 == 1), "else ").otherwise("")
    # A parent and its left child stand at the same place of the last level; the parent comes first.
    deepest = tree.nodes.agg(F.max("depth")).scalar()
    place = F.col("node") * F.pow(F.lit(2.0), deepest - F.col("depth"))
    lines = tree.nodes.join(F.broadcast(names), "feature", "left").withColumn("place", place)
    order = W.partitionBy(F.lit(1)).orderBy("place", "depth")  # one row per node
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), lead, says)
    return lines.select((F.row_number().over(order) - 1).alias("line"), text.alias("text"))
