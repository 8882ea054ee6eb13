"""Quality classifier: a sparse ensemble of rules that compiles into one Spark column.

Trees are grown over text statistics; every path from a root to a node is a conjunctive rule, an interval
per statistic.  A lasso-penalised logistic fit over the rules keeps few of them, and those become a column
expression, so scoring is a projection of the scan: no model object, no Python, no shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: At most about so many labelled rows are used for fitting (a hash sample of them, if there are more).
FIT_ROWS = 50_000
TREES, DEPTH, SEED = 12, 3, 17
LASSO = 0.0005
THRESHOLD = 0.3

#: Frequent words of four languages; how many of them a text has tells prose from lists.
COMMON_WORDS = "the of and to in is that for with as de la el en y los que un una le les et des der die das und von den mit ist".split()


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, all finite, also of an empty or null one (then of an empty one)."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / chars
    words = F.split(text, " ")
    lines = F.split(text, "\n")
    return {
        "log_chars": F.log1p(F.length(text)),
        "upper_share": without("[A-Z]+"),
        "symbol_share": without(r"[!#$%&*+/<=>@^_`|~\\{}\[\]]+"),
        "pipe_share": without(r"\|+"),
        "digit_share": without("[0-9]+"),
        "stop_share": without(r"[.,;:?]+"),
        "mean_word": F.length(text) / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "log_lines": F.log1p(F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "common_words": F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in COMMON_WORDS]))).cast("double"),
        "non_ascii_share": (F.octet_length(text) - F.length(text)) / chars,
    }


FEATURES = ["log_chars", "upper_share", "symbol_share", "pipe_share", "digit_share", "stop_share", "mean_word", "distinct_words", "log_lines", "distinct_lines", "common_words", "non_ascii_share"]


@dataclass(frozen=True)
class Rule:
    """low < statistic <= high for each statistic of the rule."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self, inside: str = "") -> Column:
        """The rule over columns of the statistics' names, or over the fields of the column `inside`."""
        test = F.lit(True)
        for name, low, high in self.bounds:
            value = F.col(inside)[name] if inside else F.col(name)
            if low > -math.inf:
                test = test & (value > low)
            if high < math.inf:
                test = test & (value <= high)
        return test


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    terms: tuple[tuple[Rule, float], ...]

    def score(self, inside: str = "") -> Column:
        """Probability of label 1 from the statistics."""
        logit = F.lit(float(self.intercept))
        for rule, weight in self.terms:
            logit = logit + F.when(rule.column(inside), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def tree_rules(tree, features: list[str]) -> set[Rule]:
    """The path to each node but the root, repeated tests of a statistic merged into one interval."""
    rules: set[Rule] = set()

    def walk(node, box: dict[str, tuple[float, float]]) -> None:
        if box:
            rules.add(Rule(tuple(sorted((f, *b) for f, b in box.items()))))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, at = features[split.featureIndex()], float(split.threshold())
        low, high = box.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), box | {name: (low, min(high, at))})
        walk(node.rightChild(), box | {name: (max(low, at), high)})

    walk(tree._call_java("rootNode"), {})
    return rules


def fit_rules(labelled: DataFrame, features: list[str], label: str = "quality", *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Rules and weights from rows of statistics with a 0/1 label, a bounded number as `learn` gives them.

    With one class only, or no rows, the model is the constant share of label 1 (0.5 without rows)."""
    known = labelled.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or ones in (0, n):
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), ())
    sample = known.coalesce(4).cache()
    try:
        grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird", labelCol="label", featuresCol="x", minInstancesPerNode=5).fit(
            VectorAssembler(inputCols=features, outputCol="x").transform(sample)
        )
        rules = sorted(set().union(*(tree_rules(t, features) for t in grown.trees)), key=lambda r: r.bounds)
        if not rules:
            return RuleModel(math.log(ones / (n - ones)), ())
        active = sample.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(active).select("label", "x")
        fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=30).fit(vectors)
        terms = tuple((r, float(w)) for r, w in zip(rules, fit.coefficients.toArray(), strict=True) if w)
        return RuleModel(float(fit.intercept), terms)
    finally:
        sample.unpersist()


def held_out(key: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the key as text is a multiple of 5 (false for a null key)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """One label for each key: rows without one are left out, repeated keys take the majority (ties: 1)."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))


def learn(scanned: DataFrame, labels: DataFrame, key: str, label: str, fit_rows: int = FIT_ROWS) -> RuleModel:
    """The model of `scanned` (key and statistics), learnt from about `fit_rows` labelled rows at most that are not held out.

    Labels are thinned by a hash of their key before they meet the rows; what they meet is a bounded
    sample, written once, and all steps of the fit read that."""
    known = _labels(labels, key, label).filter(~held_out(F.col("_key")))
    bound = int((1 << 32) * min(1.0, fit_rows / max(1, known.count())))
    chosen = stage(known.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 32)) < bound), "labels")
    sample = stage(scanned.join(chosen, F.col(key) == F.col("_key")).select(*FEATURES, "_label"), "sample")
    return fit_rules(sample, FEATURES, "_label")


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """`key`, held_out, score (0 to 1), predicted (score >= 0.3) of every row, and its statistics.

    Null and empty texts are scored as an empty text; repeated rows and null keys give a row each; labels
    that are null or of no row are ignored; other columns of `docs` are not read; no rows give no rows."""
    statistics = text_statistics(F.col(text))
    scanned = stage(docs.select(F.col(key), *[c.alias(n) for n, c in statistics.items()]), "statistics")
    model = learn(scanned, labels, key, label)
    out = scanned.withColumn("_score", model.score())
    return out.select(key, held_out(F.col(key)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of `docs` that are predicted good, all their columns unchanged."""
    # Stored with the rows: a filter would work out each statistic again for every rule that tests it.
    box = "_quality_" + "_".join(docs.columns)  # a name that no column has
    statistics = F.struct(*[c.alias(n) for n, c in text_statistics(F.col(text)).items()])
    scanned = stage(docs.withColumn(box, statistics), "statistics")
    model = learn(scanned.select(F.col(key), *[F.col(box)[n].alias(n) for n in FEATURES]), labels, key, label)
    return scanned.filter(model.score(box) >= THRESHOLD).drop(box)
