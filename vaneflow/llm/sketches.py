"""Near-duplicate components from SetSketch registers.

A document's set of word shingles is sketched into registers ``floor(1 - log_b(x))``, clamped, where x is
the least of exponentially spaced hash values: registers of a union are the maxima of registers, and two
sets agree in a register about as often as their Jaccard similarity.  Bands of registers propose pairs, the
joint likelihood of all registers discards hopeless ones, and the full sets confirm the rest.

Copies of a set form a class and only its least document goes on.  In a band bucket nobody is paired with
everybody.  Its hub, the member that shares most buckets with others and so lies most central, is checked
against the rest, and those linked to it are settled.  Members that still lie in different components meet
by an exact prefix filter over what each differs in from the hub: two sets that are not both linked to it are
similar only where they share a large part of these differences, so only those are paired that share one of
the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .wordhash import each_words, mix, seeds, shingles, space_words

#: Four registers a band and 28 bands: a pair of similarity 0.8 is missed with probability 4e-7.
ROWS, BANDS = 4, 28
BASE, RATE, TOP = 1.02, 20.0, 4_095
#: Pairs are discarded when the similarity asked for is e^16 times less likely than the likeliest one.
LEAST_LOG_RATIO = -16.0


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers of distinct 64-bit elements."""
    odd, add = seeds(m, 50_000) | np.uint64(1), seeds(m, 90_000)
    least = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(elements), 4_096):
        np.minimum(least, (elements[a : a + 4_096, None] * odd + add).min(axis=0), out=least)
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def log_likelihood_ratio(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """log of likelihood at similarity `least` against the likeliest similarity under it; 0 where that is `least` or more.

    Given both sizes, a register of a exceeds that of b with probability p(u - v J), where u and v are the
    shares of the sizes and p(x) = -log_b(1 - x (b - 1) / b); the rest are ties."""
    above, below = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    ties = ra.shape[1] - above - below
    u = na / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: float) -> np.ndarray:
        pa_, pb_ = p(u - (1 - u) * j), p((1 - u) - u * j)
        return above * np.log(np.maximum(pa_, 1e-12)) + below * np.log(np.maximum(pb_, 1e-12)) + ties * np.log(np.maximum(1 - pa_ - pb_, 1e-12))

    at = log_likelihood(least)
    best = np.max([log_likelihood(j) for j in np.linspace(0, least, 33)], axis=0)
    return at - best


def _sketches(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """v, n (set size), f1 and f2 (of the set), registers, bands, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, factor, m = space_words(), seeds(ROWS, 7), ROWS * BANDS
        band_seed = seeds(BANDS, 300)
        for batch in batches:
            n, f1, f2, regs, bands = [], [], [], [], []
            for words in each_words(batch.column(1).to_pylist(), table):
                elements = np.unique(shingles(words, k))
                n.append(len(elements))
                f1.append(int(elements.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(mix(elements ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)))
                if len(elements):
                    r = registers(elements, m)
                    regs.append(r.tobytes())
                    bands.append(mix((r.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) @ factor + band_seed).astype(np.int64))
                else:
                    regs.append(None)
                    bands.append(np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["v", "n", "f1", "f2", "registers", "bands"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"v {dict(docs.dtypes)[key]}, n long, f1 long, f2 long, registers binary, bands array<long>")


def _sets(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """v, f1, f2 and the whole shingle set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = space_words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                sets = [np.unique(shingles(w, k)) for w in each_words(texts[a : a + 500], table)]
                f1 = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in sets]
                f2 = [int(mix(x ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(sets)), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))], names=["v", "f1", "f2", "elements"]
                )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"v {dict(docs.dtypes)[key]}, f1 long, f2 long, elements array<long>")


def _likely(pairs: DataFrame, vertices: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (u, v) whose sizes allow the similarity and whose registers do not speak against it."""
    least = numerator / denominator
    side = lambda c: vertices.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.least("n_u", "n_v") * denominator >= F.greatest("n_u", "n_v") * numerator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1) for c in ("r_u", "r_v"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_u", "n_v"))
            keep = pa.array(log_likelihood_ratio(ra, rb, na, nb, least) >= LEAST_LOG_RATIO)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    kind = dict(vertices.dtypes)["v"]
    return sized.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(run, f"u {kind}, v {kind}")


def _confirm(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    side = lambda c: sets.select(F.col("v").alias(c), F.col("elements").alias(f"e_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("e_u", "e_v"))
    union = F.size("e_u") + F.size("e_v") - shared
    return both.filter(shared.cast("long") * denominator >= union.cast("long") * numerator).select("u", "v")


def _split(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold different components."""
    mixed = members.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter(F.col("a") != F.col("b")).select("band")
    return members.join(mixed, "band", "left_semi")


def _differences(near: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """What every (hub, v) differs in: d, the symmetric difference of both sets (own: not in the hub), and its slack.

    slack is (numerator + denominator) |d| - (denominator - numerator) n, so that v and the hub are similar
    while slack <= (denominator - numerator) n_hub."""
    side = lambda c: sets.select(F.col("v").alias(c), F.col("elements").alias(f"e_{c}"))
    part = lambda a, b, own: F.transform(F.array_except(a, b), lambda e: F.struct(e.alias("e"), F.lit(own).alias("own")))
    d = F.concat(part("e_v", "e_hub", True), part("e_hub", "e_v", False))
    both = near.join(side("hub"), "hub").join(side("v"), "v").select("hub", "v", "root", "hub_root", F.size("e_v").cast("long").alias("n"), F.size("e_hub").alias("n_hub"), d.alias("d"))
    return both.withColumn("slack", F.size("d") * (numerator + denominator) - F.col("n") * (denominator - numerator))


def _meet_in_differences(near: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (u, v) of different components around one hub that can be similar, by an exact prefix filter.

    Sets v and w are similar if and only if their differences from the hub share
    (slack_v + slack_w) / 2 (numerator + denominator) shingles or more.  That is at least one, as two
    components are not both linked to the hub, so the rarest shingles of both differences have to meet: for
    the set of less slack those left by a partner of no less slack (and, where it belongs to the hub's
    component, of one not linked to the hub), for the other those left by a partner whose whole difference
    is shared.  What only one set of the group has or lacks is never shared: own and lost count the rest, by
    its two parts, and they and the places of the first shingle met bound what a pair can share."""
    total, gap = numerator + denominator, denominator - numerator
    of = stage(_differences(near, sets, numerator, denominator), "differences")
    single = of.select("hub", "v", "slack", "root", "hub_root", "n", "n_hub", F.size("d").alias("size"), F.inline("d"))
    frequency = single.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    partner = F.when(F.col("root") == F.col("hub_root"), F.greatest("slack", F.col("n_hub") * gap + 1)).otherwise(F.col("slack"))
    shares_low = F.greatest(F.lit(1), F.ceil((F.col("slack") + partner) / (2 * total) - 1e-9))
    shares_high = F.greatest(F.lit(1), F.ceil((F.col("slack") - F.floor(F.col("n") * denominator / numerator + 1e-9) * gap) / total - 1e-9))
    each = Window.partitionBy("hub", "v")
    count = lambda c: F.sum(F.when((F.col("df") > 1) & c, 1).otherwise(0)).over(each)
    ranked = single.join(frequency, ["hub", "e"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = ranked.withColumns({"at": F.row_number().over(each.orderBy("df", "e")), "lost": count(~F.col("own")), "own": count(F.col("own"))}).withColumns({"low": F.col("size") - shares_low + 1, "high": F.col("size") - shares_high + 1})
    ranked = ranked.filter((F.col("df") > 1) & (F.col("at") <= F.greatest("low", "high")))
    prefix = F.array_sort(F.collect_list(F.struct("df", "e", "at")))
    head = lambda end: F.transform(F.filter("prefix", lambda x: x["at"] <= F.col(end)), lambda x: x["e"])
    facts = ["v", "slack", "root", "n", "own", "lost"]
    heads = ranked.groupBy("hub", *facts, "low", "high").agg(prefix.alias("prefix"))
    heads = stage(heads.select("hub", *facts, head("low").alias("low"), head("high").alias("high")), "prefixes")
    side = lambda role: heads.select("hub", F.posexplode(role).alias(f"at_{role}", "e"), role, *[F.col(c).alias(f"{c}_{role}") for c in facts])
    a, b = side("low"), side("high")
    ordered = F.struct("slack_low", "v_low") < F.struct("slack_high", "v_high")
    after = lambda role: F.col(f"own_{role}") + F.col(f"lost_{role}") - F.col(f"at_{role}")
    most = F.least(F.least("own_low", "own_high") + F.least("lost_low", "lost_high"), after("low"), after("high"))
    fits = (F.least("n_low", "n_high") * denominator >= F.greatest("n_low", "n_high") * numerator) & (F.col("slack_low") + F.col("slack_high") <= most * (2 * total))
    first = F.element_at(F.array_intersect("low", "high"), 1) == a["e"]
    met = a.join(b, (a["hub"] == b["hub"]) & (a["e"] == b["e"]) & (F.col("root_low") != F.col("root_high")) & ordered & fits & first)
    return met.select(F.least("v_low", "v_high").alias("u"), F.greatest("v_low", "v_high").alias("v"))


def near_duplicates(docs: DataFrame, *, k: int = 5, numerator: int = 80, denominator: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles, component_id, kept of every document: linked when denominator * shared >= numerator * union.

    Words are cut at ASCII white space after lower-casing A-Z; a set holds the distinct k-word shingles, or
    the whole sequence where there are fewer words.  Null, empty and blank texts have an empty set and are
    linked with nothing.  component_id is the least key reachable over links; kept marks it.  Rows that
    repeat a key count as one document (of different texts, that with the least set fingerprint); rows
    without a key are returned with no component and kept.  No rows give no rows; other columns are not read."""
    sketched = stage(_sketches(docs, k, key, text), "sketches")
    keyed = sketched.filter(F.col("v").isNotNull())
    chosen = keyed.groupBy("v").agg(F.min(F.struct("n", "f1", "f2")).alias("s")).select("v", "s.*")
    one = stage(chosen, "documents-of-sets")
    classes = stage(one.filter(F.col("n") > 0).groupBy("n", "f1", "f2").agg(F.min("v").alias("rep")), "classes")
    vertices = stage(keyed.join(classes.select("n", "f1", "f2", F.col("rep").alias("v")), ["v", "n", "f1", "f2"]).dropDuplicates(["v"]), "vertices")

    bands = vertices.select("v", "n", F.explode("bands").alias("band"))
    met = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    joined = bands.join(met, "band")
    central = joined.groupBy("v").agg(F.sum("size").alias("central"))
    members = stage(joined.drop("size").join(central, "v"), "buckets")
    involved = central.select(F.col("v").alias(key))
    texts = docs.select(F.col(key), F.col(text)).join(involved, key, "left_semi")
    sets = stage(_sets(texts, k, key, text).join(vertices.select("v", "f1", "f2"), ["v", "f1", "f2"], "left_semi").dropDuplicates(["v"]), "sets")

    hubs = members.groupBy("band").agg(F.max(F.struct("central", "v")).alias("hub"))
    met = members.join(hubs, "band").select(F.col("hub.v").alias("u"), "v").filter(F.col("u") != F.col("v"))
    pairs = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    likely = stage(_likely(pairs, vertices, numerator, denominator), "likely")
    links = stage(_confirm(likely, sets, numerator, denominator), "links")
    roots = components(links)
    # A hub has met all members of its buckets; what is left are the others, where they lie apart.
    rest = members.join(hubs.select("band", F.col("hub.v").alias("v")), ["band", "v"], "left_anti").select("band", "v", "n")
    left = stage(_split(rest.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))), "open")
    if not left.isEmpty():  # mostly hubs have settled all: nothing is planned for the second meeting then
        near = left.join(hubs.select("band", F.col("hub.v").alias("hub")), "band").select("hub", "v", "root").distinct()
        near = near.join(roots.select(F.col("v").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
        more = _meet_in_differences(near, sets, numerator, denominator).distinct().join(likely, ["u", "v"], "left_anti")
        links = links.union(stage(_confirm(stage(more, "open"), sets, numerator, denominator), "links"))
        roots = components(links)

    rep_roots = classes.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("root"))
    out = one.join(rep_roots, ["n", "f1", "f2"], "left").select(F.col("v").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "v").alias("component_id"))
    keyless = sketched.filter(F.col("v").isNull()).select(F.col("v").alias(key), F.col("n").alias("n_shingles"), F.col("v").alias("component_id"))
    return out.union(keyless).withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col(key)))
