"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, digits, span_list, spans_where

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = 4

#: Written so that each match begins where a run of its characters begins, or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Two letters, two check digits and 11 to 30 more characters, in one piece or in groups of four.
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
#: A number in three parts that looks like many others: only its surroundings tell what it is.
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Prior score of a confirmed span, and words (lower-case) that raise it within the characters before it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
CONTEXT = {
    "email": ["mail", "contact", "@"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "credit", "visa", "payment"],
    "phone": ["phone", "call", "tel", "mobile"],
    "iban": ["iban", "bank", "account"],
    "ssn": ["ssn", "social security", "tax id"],
}
#: The least score of a span of the method's own kinds; base spans stay whatever theirs.
LEAST_OWN_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.5


def _ip_parts(text: Column) -> Column:
    # Long parts are out of range whatever their digits, unless they are led by zeros.
    return F.forall(F.split(text, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(text, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255
    )


def luhn(text: Column) -> Column:
    """12 to 19 digits whose Luhn sum, doubling every second digit from the right, is a multiple of ten."""
    d = F.reverse(digits(text))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, 1).cast("int")
        twice = F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
        return acc + twice

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def mod97(text: Column) -> Column:
    """The first four characters moved behind, letters as 10 to 35, the number leaves 1 on division by 97."""
    s = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(s, 5, 1_000), F.substring(s, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, 1))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def pii_spans(text: Column) -> Column:
    """Confirmed spans of one text, all kinds, as an array of (start, stop, kind, text, score)."""
    has = lambda pattern: text.rlike(pattern)
    found = F.concat(
        spans_where(text, text.contains("@"), EMAIL, 0),
        spans_where(text, has(r"[0-9]\.[0-9]++\.[0-9]"), IP, 1, _ip_parts),
        spans_where(text, has(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, 2, luhn),
        spans_where(text, has(r"\+[0-9]"), PHONE, 3, lambda t: F.length(digits(t)).between(9, 15)),
        spans_where(text, has(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), IBAN, 4, mod97),
        spans_where(text, has(r"[0-9]-[0-9]{2}-[0-9]"), SSN, 5),
    )
    scored = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["text"].alias("text"), _score(text, s).alias("score")))
    return F.filter(scored, lambda s: (s["kind"] < BASE_KINDS) | (s["score"] >= LEAST_OWN_SCORE))


def _score(text: Column, span: Column) -> Column:
    prior = F.element_at(F.array(*[F.lit(PRIOR[k]) for k in KINDS]), span["kind"] + 1)
    words = F.element_at(F.array(*[F.lit("|".join(CONTEXT[k])) for k in KINDS]), span["kind"] + 1)
    begin = F.greatest(F.lit(0).cast("long"), span["start"] - CONTEXT_CHARS)
    before = F.lower(F.substring(text, (begin + 1).cast("int"), (span["start"] - begin).cast("int")))
    near = F.exists(F.split(words, r"\|"), lambda w: F.contains(before, w))
    return F.round(F.when(near, prior + (1 - prior) * CONTEXT_GAIN).otherwise(prior), 6)


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, text, spans: array of (kind, start, stop, text, score), code points, stop exclusive, by start and kind.

    Kinds are matched apart, so spans of different kinds may overlap.  A span's score is that of its kind, raised by
    words before it; the method's own kinds need LEAST_OWN_SCORE.  A null text counts as empty and has no
    spans; rows stay one to one, repeated ones and null keys included; other columns are not read."""
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    raw = whole.withColumn("spans", pii_spans(F.col("text")))
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["text"].alias("text"), s["score"].alias("score"))))
    named = F.transform(ordered, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), s["score"].alias("score")))
    return raw.select(key, "text", named.alias("spans"))


def pii_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest of the base spans, list of all spans and, in the same order, of their scores, of every row."""
    found = find_pii(docs, key=key, text=text)
    code = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int") - 1
    coded = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), code(s).alias("kind"), s["text"].alias("text"))).cast(SPAN)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(coded, lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        key,
        *[number(k) for k in KINDS[:BASE_KINDS]],
        F.sha2(span_list(base, KINDS), 256).alias("base_sha256"),
        span_list(coded, KINDS).alias("spans"),
        *[number(k) for k in KINDS[BASE_KINDS:]],
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def mask_pii(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", least_score: float = 0.0) -> DataFrame:
    """`docs` with every span of `least_score` or more replaced by its kind in brackets; of overlapping spans the first, longest one names it.

    Texts without spans, null texts and all other columns stay as they are; `n_chars` follows the text."""
    spans = F.filter(pii_spans(F.coalesce(F.col(text), F.lit(""))), lambda s: s["score"] >= least_score)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = F.struct((-s["back"]).alias("at"), F.concat(state["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out"))
        longer = F.struct(F.greatest(state["at"], -s["back"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], new).otherwise(longer)

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(ordered, zero, step, lambda s: F.concat(s["out"], F.substring(F.col(text), (s["at"] + 1).cast("int"), 1 << 30)))
    out = docs.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(F.col(text)).cast(dict(docs.dtypes)[n_chars])))
    return out.select(docs.columns)
