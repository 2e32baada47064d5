"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations alone.

A token budget flows down a tree domain > language > source.  At each node it is split by weight; a child takes
at most its capacity (its tokens times the epochs allowed), and what it cannot take goes to its siblings.  Only
what all siblings together cannot take stays with the parent, whose own siblings then share it.  A leaf
fills its budget with whole epochs and a prefix of one more, in an order seeded by epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, stored

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of a document's order that part a leaf into bins; bins before the budget's end count whole.
BIN_DIGITS = 3
#: Leaves up to which tables of the tree are broadcast.
SMALL_TREE = 20_000
TOKEN = r"[^\x20\x09-\x0D]+"
DEC = "decimal(38,0)"


@dataclass(frozen=True)
class MixPlan:
    """weights: for each level, name to weight (a positive whole number); names not listed weigh `default`.
    share: the budget as a fraction of all tokens (numerator, denominator).  epochs: most times a text is used."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 3, "curated": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}})
    default: int = 1
    share: tuple[int, int] = (3, 5)
    epochs: int = 2
    seed: str = "mix-1"


def domain_of(source: Column) -> Column:
    """The production tree's domains: even-numbered sources are `web`, others `curated`, none `unknown`."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(source.isNull(), "unknown").when(F.substring(number, -1, 1).isin("0", "2", "4", "6", "8"), "web").otherwise("curated")


def weight_of(plan: MixPlan, level: str) -> Column:
    known = plan.weights.get(level) or {}
    listed = F.lit(None).cast("int")
    for name, weight in known.items():
        listed = F.when(F.col(level) == name, F.lit(weight)).otherwise(listed)
    return F.coalesce(listed, F.lit(plan.default)).cast(DEC)


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add `budget` to nodes (parent columns, name, weight, capacity, given): given split by weight under capacities.

    Whole-number water-filling: children by capacity / weight; the first ones, for which the even rate suffices,
    take their capacity, and the rest share what remains by weight, rounded down.
    """
    ahead = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).cast("double"), F.col(name))
    before, after = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(0, Window.unboundedFollowing)
    zero = F.lit(0).cast(DEC)
    step = nodes.withColumn("used", F.coalesce(F.sum("capacity").over(before), zero).cast(DEC)).withColumn("left_weight", F.sum("weight").over(after).cast(DEC))
    step = step.withColumn("fits", F.col("capacity") * F.col("left_weight") <= (F.col("given") - F.col("used")) * F.col("weight"))
    # The children that are full form a prefix of this order; the first other one sets the rate for the rest.
    whole = Window.partitionBy(*parent)
    step = step.withColumn("rest", F.min(F.when(~F.col("fits"), F.struct("used", "left_weight"))).over(whole))
    even = F.expr("((given - rest.used) * weight) div rest.left_weight")
    return step.withColumn("budget", F.when(F.col("fits"), F.col("capacity")).otherwise(even).cast(DEC)).drop("used", "left_weight", "fits", "rest")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    tree = leaves.withColumn("capacity", (F.col("tokens") * plan.epochs).cast(DEC))
    given = tree.agg(F.expr(f"(coalesce(sum(tokens), 0) * {plan.share[0]}) div {plan.share[1]}").cast(DEC).alias("want"), F.coalesce(F.sum("capacity"), F.lit(0)).cast(DEC).alias("can")).select(F.least("want", "can").alias("given"))
    above, parent = given, []
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        nodes = tree.groupBy(*path).agg(F.sum("capacity").cast(DEC).alias("capacity"), F.sum("tokens").alias("tokens"))
        # Names are not null here, and the tree has as many nodes as there are sources, far below the rows.
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above))
        nodes = split_budget(nodes.withColumn("weight", weight_of(plan, level)), parent or [F.lit(0)], level)
        above, parent = nodes.select(*path, F.col("budget").alias("given"), *(["tokens"] if level == LEVELS[-1] else [])), path
    return above.select(*LEVELS, "tokens", F.col("given").cast("long").alias("budget"))


def by_leaf(rows: DataFrame, table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Join rows with a table of one row per leaf: broadcast when it has at most SMALL_TREE rows, else with hot leaves apart."""
    if sizes.count() <= SMALL_TREE:
        return rows.join(F.broadcast(table), list(LEVELS))
    return hot_join(rows, table.join(sizes, list(LEVELS)), list(LEVELS), "n", "inner").drop("n")


def mix(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, copies, text_key.

    copies is how often the mixture uses the text.  A leaf's budget gives b // t whole epochs of its t tokens, and the
    documents that begin before the remaining b % t tokens in the seeded order of the next epoch are used
    once more.  Null language or source is the leaf `unknown`; texts without words are never used.
    A row is placed by its doc_id, so rows that share one are used together or not at all.
    """
    plan = plan or MixPlan()
    lang, source = docs["lang"].cast("string"), docs["source"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(lang, F.lit("unknown")).alias("lang"), F.coalesce(source, F.lit("unknown")).alias("source"), F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(TOKEN)).cast("long").alias("n_tokens"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text_key"))
    rows = stored(rows, "mix-rows")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    budgets = stored(leaf_budgets(leaves, plan).withColumn("whole", F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")
    sizes = leaves.select(*LEVELS, "n")
    placed = by_leaf(rows, budgets.select(*LEVELS, "whole", "rest"), sizes)
    placed = placed.withColumn("place", F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = placed.withColumn("bin", F.substring("place", 1, BIN_DIGITS))
    # Tokens before each bin, from sums of bins: no task ever sees a whole leaf's rows in order.
    bins = placed.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = stored(bins.withColumn("before", F.coalesce(F.sum("bin_tokens").over(ahead), F.lit(0))), "mix-bins")
    edge = bins.join(budgets.select(*LEVELS, "rest"), list(LEVELS)).filter("before < rest AND rest < before + bin_tokens").select(*LEVELS, "bin", "before")
    # Each leaf has at most one bin in which the budget ends; only its rows are put in order.
    last = edge.select(*LEVELS, F.col("bin").alias("edge_bin"), F.col("before").alias("edge_before"))
    full = bins.join(budgets.select(*LEVELS, "rest"), list(LEVELS)).filter("before + bin_tokens <= rest").groupBy(*LEVELS).agg(F.max("bin").alias("full_bin"))
    limits = stored(budgets.select(*LEVELS).join(last, list(LEVELS), "left").join(full, list(LEVELS), "left"), "mix-limits")
    marked = by_leaf(placed, limits, sizes)
    inner = marked.filter(F.col("bin") == F.col("edge_bin"))
    # Rows of one place (a repeated doc_id) start together: the default frame takes peers whole.
    upto, peers = Window.partitionBy(*LEVELS).orderBy("place"), Window.partitionBy(*LEVELS, "place")
    inner = inner.withColumn("start", F.col("edge_before") + F.sum("n_tokens").over(upto) - F.sum("n_tokens").over(peers)).withColumn("extra", (F.col("start") < F.col("rest")).cast("int"))
    outer = marked.filter(~F.col("bin").eqNullSafe(F.col("edge_bin"))).withColumn("extra", F.coalesce(F.col("bin") <= F.col("full_bin"), F.lit(False)).cast("int"))
    both = inner.drop("start").unionByName(outer)
    return both.select("doc_id", "domain", "lang", "source", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long").alias("copies"), "text_key")


def mixed_documents(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """The documents that the mixture uses, with all columns of docs and `copies`, how often each is used."""
    used = mix(docs, plan).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"), F.col("copies").alias("__copies")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    found = keyed.join(used, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    return found.select(*[f"`{c}`" for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))
