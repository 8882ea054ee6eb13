"""Secrets: a ledger of content-addressed blobs says what has been scanned; findings join back to all paths.

A version of a file is a row (path, text).  Its blob is the SHA-256 of the text, so copies and unchanged
versions are one blob.  Only pairs of blob and rule version that the ledger lacks are scanned."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .spans import SPAN, span_list, spans_where

KINDS = ["assign", "access", "hex", "pem", "webtoken"]
BASE_KINDS = 3

ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
WEBTOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"

#: A blob in more than one of so many paths is hot; there are at most as many. Tasks that share the paths of one.
HOT_SHARE, SALTS = 1_000, 64
#: The least length of what is assigned.
ASSIGNED = 6


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    order: int

    @property
    def stamp(self) -> str:
        return f"{self.name}@{self.version}"


RULES = tuple(Rule(name, 1, i) for i, name in enumerate(KINDS))


def rule_spans(rule: Rule, text: Column) -> Column:
    if rule.name == "assign":
        valid = lambda t: F.length(F.regexp_extract(t, ASSIGN_VALUE, 1)) >= ASSIGNED
        return spans_where(text, text.rlike(r"(?i)(?:pass|secret|token|api_?key)"), ASSIGN, rule.order, valid)
    if rule.name == "access":
        return spans_where(text, text.contains("AKIA"), ACCESS, rule.order)
    if rule.name == "hex":
        return spans_where(text, text.rlike(HEX), HEX, rule.order)
    if rule.name == "pem":
        return spans_where(text, text.contains("-----BEGIN "), PEM, rule.order)
    return spans_where(text, text.contains("eyJ"), WEBTOKEN, rule.order)


def blobs(versions: DataFrame, path: str, text: str) -> DataFrame:
    """path and blob of every version; a null text is the empty blob."""
    return versions.select(F.col(path), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], path: str) -> DataFrame:
    """One path for each blob with the stamps of the rules it was not scanned with; blobs without any are left out."""
    every = F.array(*[F.lit(r.stamp) for r in rules])
    one = paths.groupBy("blob").agg(F.min(path).alias(path))
    if ledger is None:
        return one.withColumn("todo", every)
    known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))  # at most one entry per rule version
    left = one.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))))
    return left.filter(F.size("todo") > 0).drop("known")


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, *, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """blob, todo (stamps scanned now) and spans of each blob that had a pair of blob and rule left to scan.

    Append (blob, each of todo) to the ledger and the spans to the findings once this has been written."""
    paths = blobs(versions, path, text)
    todo = unseen(paths, ledger, rules, path).select(F.col(path).alias("_path"), F.col("blob").alias("_blob"), "todo")
    texts = versions.select(F.col(path).alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_blob", F.sha2("text", 256))
    due = texts.join(todo, (texts["_blob"] == todo["_blob"]) & texts["_path"].eqNullSafe(todo["_path"])).select(texts["_blob"].alias("blob"), "text", "todo")
    parts = [F.when(F.array_contains("todo", r.stamp), rule_spans(r, F.col("text"))).otherwise(F.array().cast(SPAN)) for r in rules]
    scanned = due.select("blob", "todo", F.concat(*parts).alias("spans"))
    return scanned.dropDuplicates(["blob"])  # a path that is repeated with its text


def ledger_rows(scanned: DataFrame) -> DataFrame:
    return scanned.select("blob", F.explode("todo").alias("rule"))


def findings_by_path(versions: DataFrame, findings: DataFrame, *, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob and spans of every version: findings (blob, spans), old and new, joined back to all paths.

    The paths of a hot blob, one that more than a thousandth of all have, are spread by a salt, and the findings of
    these blobs, a thousand at most, go to every salt."""
    hit = findings.filter(F.size("spans") > 0)
    merged = hit.select("blob", F.explode("spans").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("spans"))  # of one text
    paths = blobs(versions, path, text)
    counted = stage(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    total = versions.select(path).count()
    hot = F.broadcast(counted.filter(F.col("n") * HOT_SHARE > total).select(F.col("blob").alias("hot_blob")))  # at most HOT_SHARE rows
    salted = paths.join(hot, F.col("blob") == F.col("hot_blob"), "left")
    salt = F.when(F.col("hot_blob").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = salted.withColumn("salt", salt).drop("hot_blob")
    every = F.when(F.col("hot_blob").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = merged.join(hot, F.col("blob") == F.col("hot_blob"), "left").withColumn("salt", F.explode(every)).drop("hot_blob")
    met = salted.join(dealt, ["blob", "salt"], "left")
    return met.select(path, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def secret_digest(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, *, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the base spans and list of all spans of every version.

    A null text counts as empty and has no spans; repeated rows and null paths give a row each; other
    columns are not read; no rows give no rows.  With a ledger, `findings` hold what it has already found."""
    new = scan_unseen(versions, ledger, path=path, text=text).select("blob", "spans")
    every = new if findings is None else new.unionByName(findings.select("blob", "spans"))
    found = findings_by_path(versions, every, path=path, text=text)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select(path, *[number(k) for k in KINDS[:BASE_KINDS]], F.sha2(span_list(base, KINDS), 256).alias("base_sha256"), span_list(F.col("spans"), KINDS).alias("spans"), "blob")
