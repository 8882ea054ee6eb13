"""Mixing sources to target weights: a token budget goes down a tree, and each leaf gives a prefix of seeded epochs.

The budget is divided among domains, each share among its languages and each of these among its sources, by
weight.  Where a child holds less than its share, the shortage goes to its siblings by weight before the
parent counts as short itself; a parent's share never exceeds what its leaves hold, so ancestors only see
what no sibling could take.  A leaf's documents are ordered by a seeded hash, anew in each epoch, and
taken from the front until its budget is used up.  All amounts are whole tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Documents that a slice of a leaf is to hold; only the slice in which the budget ends is sorted.
SLICE_DOCUMENTS = 4_000


@dataclass(frozen=True)
class MixPlan:
    """Weights are whole numbers; names without one get `other` (0 leaves them out)."""

    domain_of_source: dict[str, str] = field(default_factory=lambda: {"src0": "crawl", **{f"src{i}": "reference" for i in range(1, 10)}})
    other_domain: str = "community"
    domains: dict[str, int] = field(default_factory=lambda: {"crawl": 40, "reference": 35, "community": 25})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    #: Budget as per cent of all tokens, how often a document may be taken, and the seed of the order.
    budget_percent: int = 80
    max_epochs: int = 2
    seed: int = 11


def whitespace_tokens(text: Column) -> Column:
    """Words between single spaces, a native stand-in for tokens; a null or empty text has none."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.size(F.split(text, " "))).cast("long")


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    if not weights:
        return F.lit(other).cast("long")
    return F.coalesce(F.create_map(*[F.lit(x) for p in weights.items() for x in p])[name], F.lit(other)).cast("long")


def share_out(children: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Divide `budget` (the parent's) among children of capacity `held`; adds `given`.

    Children in order of capacity by weight: those that cannot take their share of what is left are filled,
    the others divide the rest by weight, rounded down."""
    w = children.withColumn("_w", weight).withColumn("_fill", F.when(F.col("_w") > 0, F.col("held") / F.col("_w")))
    # Children without weight stand last and get nothing: nothing is left when their turn comes.
    order = Window.partitionBy(*parents).orderBy(F.asc_nulls_last("_fill"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = w.withColumn("_left", F.col("budget") - F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("_weights", F.sum("_w").over(onward))
    # decimals: a budget times a weight may exceed a long
    full = (F.col("_w") > 0) & (F.col("held").cast("decimal(38,0)") * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("_w"))
    marked = left.withColumn("_full", full)
    whole = Window.partitionBy(*parents).orderBy(F.asc_nulls_last("_fill"), name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_left = F.first(F.when(~F.col("_full"), F.col("_left")), ignorenulls=True).over(whole)
    first_weights = F.first(F.when(~F.col("_full"), F.col("_weights")), ignorenulls=True).over(whole)
    divided = F.expr("cast(cast(_first_left as decimal(38,0)) * _w div nullif(_first_weights, 0) as bigint)")
    shared = marked.withColumn("_first_left", first_left).withColumn("_first_weights", first_weights)
    given = F.when(F.col("_full"), F.col("held")).otherwise(F.coalesce(F.greatest(divided, F.lit(0).cast("long")), F.lit(0).cast("long")))
    return shared.withColumn("given", given).drop("_w", "_fill", "_left", "_weights", "_full", "_first_left", "_first_weights")


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, tokens, documents of each leaf, with its `budget`."""
    held = leaves.withColumn("held", F.when(_weight(F.col("source"), plan.sources, plan.other) > 0, F.col("tokens") * plan.max_epochs).otherwise(0))
    languages = held.groupBy("domain", "lang").agg(F.sum("held").alias("held"), F.sum("tokens").alias("tokens"))
    languages = languages.withColumn("held", F.when(_weight(F.col("lang"), plan.languages, plan.other) > 0, F.col("held")).otherwise(0))
    domains = languages.groupBy("domain").agg(F.sum("held").alias("held"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("held", F.when(_weight(F.col("domain"), plan.domains, plan.other) > 0, F.col("held")).otherwise(0))
    every = Window.partitionBy("root")  # one row for each domain
    budget = F.floor(F.sum(F.col("tokens").cast("decimal(38,0)")).over(every) * plan.budget_percent / 100).cast("long")
    top = share_out(domains.withColumn("root", F.lit(0)).withColumn("budget", budget), ["root"], "domain", _weight(F.col("domain"), plan.domains, plan.other))
    middle = share_out(languages.join(top.select("domain", F.col("given").alias("budget")), "domain"), ["domain"], "lang", _weight(F.col("lang"), plan.languages, plan.other))
    low = share_out(held.join(middle.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"]), ["domain", "lang"], "source", _weight(F.col("source"), plan.sources, plan.other))
    return low.select("domain", "lang", "source", "tokens", "documents", F.col("given").alias("budget"))


def _ticket(plan: MixPlan, epoch: Column, identity: Column) -> Column:
    """32 hexadecimal digits that order the documents of a leaf in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), identity))


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def select_mixture(
    docs: DataFrame, plan: MixPlan | None = None, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tokens: Column | None = None, with_hash: bool = False
) -> DataFrame:
    """`key`, domain, lang, source, epoch, tokens, leaf_budget of everything that is taken, a row for each time.

    A document is taken when the tokens up to and with it, in its leaf's order of the epoch, are within
    what the budget leaves for that epoch.  The order is that of a hash of the key and the text, so rows that
    share a key, or have none, have places of their own; rows equal in both stand side by side, travel as one row
    with their number, and as many of them are taken as fit.  Null languages and sources are the leaf "unknown";
    null texts have no tokens, and documents without tokens are not taken; no rows give no rows.  `with_hash`
    adds the text's MD5 as text_md5, to tell rows of one key apart."""
    plan = plan or MixPlan()
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    count = whitespace_tokens(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), unknown(lang).alias("lang"), unknown(source).alias("source"), count.alias("_tokens"), text_md5(F.col(text)).alias("_hash"))
    domain = F.coalesce(F.create_map(*[F.lit(x) for p in plan.domain_of_source.items() for x in p])[F.col("source")], F.lit(plan.other_domain)) if plan.domain_of_source else F.lit(plan.other_domain)
    leaf = ["domain", "lang", "source"]
    rows = rows.withColumn("domain", domain).filter(F.col("_tokens") > 0)
    # Texts are read once; equal rows are put together before they travel.
    rows = stage(rows.groupBy(*leaf, "_key", "_hash", "_tokens").agg(F.count(F.lit(1)).alias("_copies")), "mixture-rows")
    held = F.col("_tokens") * F.col("_copies")
    # A few rows for each source and language: staged, so that no step works them out again.
    leaves = stage(rows.groupBy(*leaf).agg(F.sum(held).alias("tokens"), F.count(F.lit(1)).alias("documents")), "leaves")
    budgets = stage(leaf_budgets(leaves, plan).filter(F.col("budget") > 0), "budgets")
    # Each epoch of a leaf has the leaf's tokens as its room; the last one what is left.
    epochs = budgets.select(*leaf, F.col("budget").alias("leaf_budget"), F.col("tokens").alias("_held"), "documents", F.explode(F.sequence(F.lit(0), F.lit(plan.max_epochs - 1))).alias("epoch"))
    rooms = epochs.withColumn("_room", F.least(F.col("_held"), F.col("leaf_budget") - F.col("epoch") * F.col("_held"))).filter(F.col("_room") > 0)
    rooms = stage(rooms.withColumn("_slices", F.ceil(F.col("documents") / SLICE_DOCUMENTS).cast("long")), "rooms")

    identity = F.concat_ws(":", F.coalesce(F.col("_key").cast("string"), F.lit("")), "_hash")
    offered = rows.join(rooms, leaf).withColumn("_ticket", _ticket(plan, F.col("epoch"), identity))
    place = F.conv(F.substring("_ticket", 1, 8), 16, 10).cast("long")
    offered = offered.withColumn("_slice", F.floor(place * F.col("_slices") / F.lit(1 << 32)).cast("long"))
    # Tokens by slice, added up along the leaf: slices that end within the room are taken whole.
    sums = offered.groupBy(*leaf, "epoch", "_slice").agg(F.sum(held).alias("_sum"), F.first("_room").alias("_r"))
    along = Window.partitionBy(*leaf, "epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_end", F.sum("_sum").over(along)).withColumn("_before", F.col("_end") - F.col("_sum")).filter(F.col("_before") < F.col("_r"))
    ends = stage(ends.select(*leaf, "epoch", "_slice", "_end", "_before"), "slices")
    marked = offered.join(ends, [*leaf, "epoch", "_slice"])
    whole = marked.filter(F.col("_end") <= F.col("_room")).withColumn("_taken", F.col("_copies"))
    inside = Window.partitionBy(*leaf, "epoch", "_slice").orderBy("_ticket", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_room") - F.col("_before") - (F.sum(held).over(inside) - held)
    cut = marked.filter(F.col("_end") > F.col("_room")).withColumn("_taken", F.least(F.col("_copies"), F.floor(left / F.col("_tokens")).cast("long"))).filter("_taken > 0")
    taken = whole.unionByName(cut).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_taken"))))
    more = [F.col("_hash").alias("text_md5")] if with_hash else []
    return taken.select(F.col("_key").alias(key), *leaf, "epoch", F.col("_tokens").alias("tokens"), "leaf_budget", *more)
