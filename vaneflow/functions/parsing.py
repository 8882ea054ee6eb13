"""Column expressions that type raw text: numbers, times, titles, identifiers, surface-report remarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of a missing reading, and the trace marker with its numeric value.
NULL_MARKERS = ("M", "")
TRACE_MARKER = "T"
TRACE_INCHES = 0.0001

# Observation columns by type.
OBS_NUMERIC = (
    "lon", "lat", "elevation", "tmpf", "dwpf", "relh", "drct", "sknt", "p01i", "alti", "mslp", "vsby", "gust",
    "skyl1", "skyl2", "skyl3", "skyl4", "ice_accretion_1hr", "ice_accretion_3hr", "ice_accretion_6hr",
    "peak_wind_gust", "peak_wind_drct", "feel", "snowdepth",
)
OBS_TEXT = ("station", "skyc1", "skyc2", "skyc3", "skyc4", "wxcodes", "metar")
OBS_TIME = ("valid", "peak_wind_time")
OBS_TRACE = ("p01i", "ice_accretion_1hr", "ice_accretion_3hr", "ice_accretion_6hr")

# Spellings of a city mapped to one name.
CITY_ALIASES = {
    "nyc": "New York City",
    "ny": "New York City",
    "new york": "New York City",
    "la": "Los Angeles",
    "d.c.": "Washington D.C.",
    "dc": "Washington D.C.",
    "sf": "San Francisco",
}


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_markers(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(~c.isin(*NULL_MARKERS), c)


def lenient_double(c: Column | str) -> Column:
    """Text to double; anything unreadable, and NaN, is null."""
    number = F.trim(as_column(c)).try_cast("double")
    return F.when(~F.isnan(number), number)


def trace_double(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(c == TRACE_MARKER, F.lit(TRACE_INCHES)).otherwise(lenient_double(c))


def utc_minute(c: Column | str) -> Column:
    return F.try_to_timestamp(as_column(c), F.lit("yyyy-MM-dd HH:mm"))


def type_observations(raw: DataFrame) -> DataFrame:
    """All-text observation rows to typed rows; columns that are absent stay absent."""
    typed = []
    for name in raw.columns:
        c = null_markers(name)
        if name in OBS_TRACE:
            c = trace_double(c)
        elif name in OBS_NUMERIC:
            c = lenient_double(c)
        elif name in OBS_TIME:
            c = utc_minute(c)
        typed.append(c.alias(name))
    return raw.select(*typed)


def first_present(*cols: Column | str) -> Column:
    return F.coalesce(*[as_column(c) for c in cols])


def station_code(c: Column | str) -> Column:
    """Upper-case, trimmed, four-letter K codes reduced to three letters."""
    return F.regexp_replace(F.upper(F.trim(as_column(c))), r"^K(?=.{3}$)", "")


def forecast_station_code(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(F.length(c) == 3, F.concat(F.lit("K"), c)).otherwise(c)


def bucket_bounds(title: Column | str, convention: str = "infinite") -> Column:
    """Bucket title to struct(kind, lo, hi, center); degrees may be negative (`-5--4°F`).

    `infinite`: open tails are +-infinity and their centre lies one degree beyond the edge.
    `continuity`: half-degree correction on every finite edge and +-999 for open tails."""
    title = as_column(title)
    rng_lo = F.regexp_extract(title, r"^(-?\d+)-(-?\d+)°F$", 1).try_cast("double")
    rng_hi = F.regexp_extract(title, r"^(-?\d+)-(-?\d+)°F$", 2).try_cast("double")
    below = F.regexp_extract(title, r"^(-?\d+)°F or below$", 1).try_cast("double")
    above = F.regexp_extract(title, r"^(-?\d+)°F or higher$", 1).try_cast("double")
    if convention == "infinite":
        low_end, high_end, shift = F.lit(float("-inf")), F.lit(float("inf")), 0.0
    else:
        low_end, high_end, shift = F.lit(-999.0), F.lit(999.0), 0.5
    kind = (
        F.when(rng_lo.isNotNull(), "range").when(below.isNotNull(), "or_below").when(above.isNotNull(), "or_higher")
    )
    lo = F.when(rng_lo.isNotNull(), rng_lo - shift).when(below.isNotNull(), low_end).when(above.isNotNull(), above - shift)
    hi = F.when(rng_lo.isNotNull(), rng_hi + shift).when(below.isNotNull(), below + shift).when(above.isNotNull(), high_end)
    center = F.when(rng_lo.isNotNull(), (rng_lo + rng_hi) / 2).when(below.isNotNull(), below - 1).when(
        above.isNotNull(), above + 1
    )
    return F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi"), center.alias("center"))


def signed_bucket_edges(title: Column | str) -> Column:
    """Looser title form that allows negative degrees and any case: struct(kind, lo_f, hi_f)."""
    title = as_column(title)
    first = F.regexp_extract(title, r"(-?\d+)", 1).try_cast("int")
    higher, lower = title.ilike("%or higher%"), title.ilike("%or below%")
    lo = F.when(higher | lower, first).otherwise(F.regexp_extract(title, r"(-?\d+)-", 1).try_cast("int"))
    hi = F.when(higher | lower, first).otherwise(F.regexp_extract(title, r"-?\d+-(-?\d+)", 1).try_cast("int"))
    kind = F.when(higher, "or_higher").when(lower, "or_below").otherwise("range")
    return F.struct(kind.alias("kind"), lo.alias("lo_f"), hi.alias("hi_f"))


def slug_date(slug: Column | str) -> Column:
    """Date spelled inside a slug (`...-on-april-1-2026-...`); impossible dates are null.

    The slug's words are taken apart; the date is the month, day and year behind the first "on" that two
    numbers follow."""
    words = F.split(as_column(slug), "-")
    number = lambda i: F.get(words, i).try_cast("int")
    spelled = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: (F.get(words, i) == "on") & number(i + 2).isNotNull() & number(i + 3).isNotNull())
    at = F.get(spelled, F.lit(0))
    month, day, year = (F.get(words, at + k) for k in (1, 2, 3))
    text = F.concat_ws("-", F.initcap(month), F.lpad(day, 2, "0"), year)
    parsed = F.to_date(F.try_to_timestamp(text, F.lit("MMMM-dd-yyyy")))
    ok = (F.length(day) <= 2) & (F.length(year) == 4) & (year >= "2000")
    return F.when(ok, parsed)


def slug_strike(slug: Column | str) -> Column:
    """Strike suffix of a slug to struct(kind, lo, hi): `-50-51f`, `-49forbelow`, `-60forhigher`."""
    slug = as_column(slug)
    lo = F.regexp_extract(slug, r"-(\d+)-(\d+)f$", 1).try_cast("int")
    hi = F.regexp_extract(slug, r"-(\d+)-(\d+)f$", 2).try_cast("int")
    below = F.regexp_extract(slug, r"-(\d+)forbelow$", 1).try_cast("int")
    above = F.regexp_extract(slug, r"-(\d+)forhigher$", 1).try_cast("int")
    kind = F.when(lo.isNotNull(), "range").when(below.isNotNull(), "or_below").when(above.isNotNull(), "or_higher")
    return F.struct(kind.alias("kind"), F.coalesce(lo, above).alias("lo"), F.coalesce(hi, below).alias("hi"))


#: Small words inside a city's name.
NAME_PARTICLES = ("de", "da", "do", "del", "la", "of")


def city_from_question(question: Column | str) -> Column:
    """The name behind "temperature in": its first word and the capitalised words that follow, known short names spelled out.

    Words may hold dots, hyphens and apostrophes; a small word belongs to the name where a capitalised one follows."""
    text = F.regexp_replace(as_column(question), r"\s+", " ")
    rest = F.coalesce(F.get(F.split(text, "(?i)temperature in "), 1), F.lit(""))
    word, particles = r"[\p{L}.'’-]*", "|".join(NAME_PARTICLES)
    name = F.regexp_extract(rest, rf"^(\p{{L}}{word}(?: (?:(?:{particles}) )?\p{{Lu}}{word})*)", 1)
    city = F.regexp_replace(name, r"\.+$", "")
    aliases = F.create_map(*[F.lit(x) for pair in CITY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.lower(city)), city)


def _thunder_minute(text: Column, event: str) -> Column:
    """Minute at which thunder began (B) or ended (E): two digits, or hour and minute, in groups like TSB05E30."""
    groups = F.filter(F.split(text, r"\s+"), lambda w: w.rlike("^TS([BE]([0-9]{2}){1,2})+$"))
    return F.right(F.regexp_extract(F.array_join(groups, " "), event + "([0-9]+)", 1), F.lit(2)).try_cast("long")


def _signed_tenths(sign: Column, digits: Column) -> Column:
    return F.when(sign == "1", -1.0).otherwise(1.0) * digits.try_cast("double") / 10


def remark_fields(report: Column | str) -> dict[str, Column]:
    """Sixteen fields decoded from a raw surface report; flags are false and numbers null when absent.

    Groups of the remark section (public observing handbook): T temperature and dewpoint in tenths,
    SLP pressure, 1/2/4 temperature extremes, 5 pressure tendency, 6/7 precipitation, 4/ snow depth."""
    text = F.coalesce(as_column(report), F.lit(""))
    body = F.regexp_extract(text, r"^(.*?)(?:\sRMK\b|$)", 1)
    remarks = F.regexp_extract(text, r"\sRMK\s(.*)$", 1)

    def group(pattern: str, i: int = 1, source: Column = remarks) -> Column:
        return F.nullif(F.regexp_extract(source, pattern, i), F.lit(""))

    def tenths(pattern: str, first: int = 1) -> Column:
        return _signed_tenths(group(pattern, first), group(pattern, first + 1))

    t_group = r"(?:^|\s)T([01])(\d{3})([01])(\d{3})(?:\s|$)"
    main = r"\s(M?)(\d{2})/(M?)(\d{2})?(?:\s|$)"

    def whole(i: int) -> Column:
        value = group(main, i + 1, body).try_cast("double")
        return F.when(group(main, i, body) == "M", -value).otherwise(value)

    # Five-digit groups by their first digit; of the pressure tendency the second one says how the pressure went.
    fives = F.filter(F.split(text, r"\s+"), lambda w: w.startswith("5") & (F.length(w) == 5) & w.rlike("^[0-9]+$") & (F.substring(w, 2, 1) < "9"))
    tendency = F.get(fives, 0)
    slp = group(r"(?:^|\s)SLP(\d{3})(?:\s|$)").try_cast("double")
    depth = r"(?:^|\s)4/(\d{3})(?:\s|$)"
    ext24 = r"(?:^|\s)4([01])(\d{3})([01])(\d{3})(?:\s|$)"
    return {
        "temp_c": F.coalesce(tenths(t_group, 1), whole(1)),
        "dewpt_c": F.coalesce(tenths(t_group, 3), whole(3)),
        "slp_mb_rmk": F.when(slp > 500, 900 + slp / 10).otherwise(1000 + slp / 10),
        "max_temp_6hr_c": tenths(r"(?:^|\s)1([01])(\d{3})(?:\s|$)"),
        "min_temp_6hr_c": tenths(r"(?:^|\s)2([01])(\d{3})(?:\s|$)"),
        "max_temp_24hr_c": tenths(ext24, 1),
        "min_temp_24hr_c": tenths(ext24, 3),
        "precip_6hr_in": group(r"(?:^|\s)6(\d{4})(?:\s|$)").try_cast("double") / 100,
        "precip_24hr_in": group(r"(?:^|\s)7(\d{4})(?:\s|$)").try_cast("double") / 100,
        "snowdepth_in_rmk": group(depth).try_cast("double"),
        "press_tendency_3hr_mb": F.right(tendency, F.lit(3)).try_cast("double") / 10,
        "press_tendency_3hr_code": F.substring(tendency, 2, 1).try_cast("long"),
        "presrr": text.rlike(r"\bPRESRR\b"),
        "presfr": text.rlike(r"\bPRESFR\b"),
        "tsb_minute": _thunder_minute(text, "B"),
        "tse_minute": _thunder_minute(text, "E"),
    }
