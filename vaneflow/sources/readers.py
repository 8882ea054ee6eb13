"""Readers with declared schemas: observation and forecast CSV, market, fill, price and book JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import first_present, lenient_double, type_observations
from ..functions.pricing import fill_fields
from ..session import stage

LEVELS = "ARRAY<STRUCT<price: STRING, size: STRING>>"
MARKET_SCHEMA = """slug STRING, conditionId STRING, question STRING, outcomes STRING, outcomePrices STRING, clobTokenIds STRING,
 groupItemTitle STRING, groupItemThreshold STRING, volumeNum DOUBLE, volume STRING, closed BOOLEAN, createdAt STRING, endDate STRING"""
FILL_EVENT = """STRUCT<makerAssetId: STRING, takerAssetId: STRING, makerAmountFilled: STRING, takerAmountFilled: STRING,
 timestamp: STRING, maker: STRING, taker: STRING, fee: STRING, transactionHash: STRING, orderHash: STRING>"""
POINTS = "ARRAY<STRUCT<t: LONG, p: DOUBLE>>"
HISTORY_SCHEMA = f"slug STRING, condition_id STRING, yes_token_id STRING, closed BOOLEAN, fetched_at STRING, history_max_h60 {POINTS}, history_1d_min1 {POINTS}"
BOOK_SCHEMA = f"""event_type STRING, type STRING, asset_id STRING, timestamp STRING, _received_at STRING, bids {LEVELS}, asks {LEVELS},
 price_changes ARRAY<STRUCT<asset_id: STRING, price: STRING, size: STRING, side: STRING, best_bid: STRING, best_ask: STRING>>,
 price STRING, size STRING, side STRING, _corrupt STRING"""


def _raw_csv(spark: SparkSession, path, columns: Sequence[str] | None, **options: str) -> DataFrame:
    reader = spark.read.option("header", True).option("comment", "#").option("recursiveFileLookup", True).options(**options)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` STRING" for c in columns))
    return reader.csv(path)


def read_observations(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Observation CSV: `#` preamble, everything as text, then null markers and lenient casts."""
    raw = _raw_csv(spark, path, columns)
    return type_observations(raw.withColumnRenamed("valid(UTC)", "valid"))


def read_forecast_csv(spark: SparkSession, path, columns: Sequence[str], integers: Sequence[str], extremes: str = "n_x") -> DataFrame:
    """Forecast CSV as text with lenient integer casts and the lead in hours."""
    from ..functions.calendar import lead_hours

    raw = _raw_csv(spark, path, columns)
    times = {c: F.try_to_timestamp(F.col(c)) for c in ("runtime", "ftime")}
    numbers = {c: lenient_double(c).try_cast("int") for c in integers}
    return raw.withColumns(times | numbers).withColumn("lead_hours", lead_hours("runtime", "ftime"))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of each file below `path` that is no comment."""
    lines = (
        spark.read.option("recursiveFileLookup", True).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
        .filter((F.col("at") == 0) & ~F.col("value").startswith("#"))
        .withColumn("i", F.monotonically_increasing_id())
    )
    return lines.groupBy("file").agg(F.min_by("value", "i").alias("header"))


def read_csv_union_by_name(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose columns drift, all as text: the union of their columns by name, in one scan of the data.

    Lines meet the header of their file and are taken apart by its names.  Only the distinct names reach the
    driver, as the columns of the result; the headers stay a table.  Empty fields are null."""
    headers = stage(csv_headers(spark, path), "headers")
    names = F.transform(F.split("header", ","), lambda n: F.trim(F.regexp_replace(n, '^"|"$', "")))
    named = headers.select("file", "header", names.alias("names"))
    found = sorted(r[0] for r in named.select(F.explode("names")).distinct().collect())
    width = named.agg(F.max(F.size("names"))).first()[0] or 1
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).join(named, "file").filter(F.col("value") != F.col("header"))
    parsed = F.from_csv("value", ", ".join(f"_{i} STRING" for i in range(width)))
    rows = data.select("names", parsed.alias("p")).select("names", F.array(*[F.col(f"p._{i}") for i in range(width)]).alias("v"))
    place = lambda n: F.array_position("names", n).cast("int")
    return rows.select(*[F.when(place(n) > 0, F.get("v", place(n) - 1)).alias(n) for n in found])


def read_parquet_tree(spark: SparkSession, root: str, schema: str, glob: str | None = None) -> DataFrame:
    """Hive-partitioned Parquet below `root`; filters on the partition columns prune folders."""
    reader = spark.read.schema(schema).option("basePath", root)
    return reader.parquet(f"{root}/{glob}" if glob else root)


def json_list(col: str, element: str = "string"):
    """JSON text holding a list; broken text gives an empty list."""
    return F.coalesce(F.from_json(F.col(col), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per market, indented or not, or a list of them per file; lists that arrive as text are parsed."""
    raw = spark.read.schema(MARKET_SCHEMA).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    tokens = json_list("clobTokenIds")
    prices = F.transform(json_list("outcomePrices"), lambda p: p.try_cast("double"))
    return raw.select(
        "slug", F.col("conditionId").alias("condition_id"), "question", json_list("outcomes").alias("outcomes"),
        prices.alias("outcome_prices"), tokens.alias("clob_token_ids"), F.get(tokens, 0).alias("yes_token_id"),
        F.get(tokens, 1).alias("no_token_id"), F.col("groupItemTitle").alias("group_item_title"),
        F.col("groupItemThreshold").try_cast("long").alias("group_item_threshold"),
        first_present("volumeNum", F.col("volume").try_cast("double")).alias("volume_num"), "closed",
        F.try_to_timestamp("createdAt").alias("created_at"), F.try_to_timestamp("endDate").alias("end_date"),
    )


def read_fill_documents(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Documents that map a token to its list of exchange events, flattened.

    One document per file (or per line, without `whole_files`).  The slug is the file's name without its
    ending; files in a `slug=...` folder take it from there.  Broken documents give no rows."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=whole_files)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/slug=([^/]+)/", 1)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    events = F.from_json("value", f"MAP<STRING, ARRAY<{FILL_EVENT}>>")
    per_token = raw.select(F.coalesce(F.nullif(folder, F.lit("")), name).alias("slug"), F.explode(events).alias("token", "events"))
    return per_token.select("slug", "token", F.explode("events").alias("e")).select("slug", "token", "e.*")


def type_fills(events: DataFrame, markets: DataFrame) -> DataFrame:
    """Raw exchange events to typed fills seen from the taker; swaps and zero amounts are dropped."""
    ids = markets.select("slug", "condition_id", "yes_token_id", "no_token_id")
    fields = fill_fields("makerAssetId", "takerAssetId", F.col("makerAmountFilled").try_cast("long"),
                         F.col("takerAmountFilled").try_cast("long"), "yes_token_id", "no_token_id")
    typed = events.join(ids, "slug").withColumns(fields).withColumn(
        "timestamp", F.timestamp_seconds(F.col("timestamp").try_cast("long")))
    return typed.filter(F.col("price").isNotNull()).drop("yes_token_id", "no_token_id", "token")


def read_price_history(spark: SparkSession, path: str, series: str = "history_max_h60") -> DataFrame:
    """One of the two series embedded in each document; points without time or price are skipped."""
    raw = spark.read.schema(HISTORY_SCHEMA).option("recursiveFileLookup", True).json(path)
    points = raw.select("slug", "condition_id", "yes_token_id", F.col("closed").alias("closed_at_fetch"), F.try_to_timestamp("fetched_at").alias("fetched_at"), F.explode(series).alias("x"))
    return points.filter("x.t IS NOT NULL AND x.p IS NOT NULL").select(
        "slug", F.timestamp_seconds("x.t").alias("timestamp"), F.col("x.p").alias("p_yes"), "condition_id", "yes_token_id", "closed_at_fetch", "fetched_at")


def read_book_messages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Order-book JSON lines; unreadable lines are skipped and the event type comes from either field."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.schema(BOOK_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True).json(path)
    )
    return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt").withColumn("event_type", F.coalesce("event_type", "type")).drop("type")


def select_sources(df: DataFrame, column: str, wanted: DataFrame | Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """Restrict to listed values, to a table of values, or to the first n in order."""
    if isinstance(wanted, DataFrame):
        df = df.join(wanted, column, "left_semi")
    elif wanted is not None:
        df = df.filter(F.col(column).isin(*wanted))
    return df if first is None else df.orderBy(column).limit(first)


#: Widths in degrees of the tiles of the pyramid, finest first; each divides the next, and the last spans the globe.
TILES = (0.5, 4.0, 32.0, 512.0)


def nearest_grid_point(
    stations: DataFrame, grid: DataFrame, station: str, cell: Sequence[str], lat: str = "lat", lon: str = "lon", tiles: Sequence[float] = TILES,
) -> DataFrame:
    """Grid cell with the least squared lat/lon distance to each station; 0-360 longitudes are re-based.

    The grid is laid into a pyramid of tiles that hold the box of their points.  Stations go down from the top: of
    the tiles below those kept, a station keeps the ones whose box may hold a point as near as the farthest
    corner of the best box.  So a station meets a few tiles of each level wherever it lies, and at last
    the points of a few of the finest; the result is exact.  Of equally near cells the least is taken."""
    def rebased(df):
        return df.withColumn(lon, F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon)))

    points = rebased(grid).select(F.struct(*cell).alias("_cell"), F.col(lat).alias("_glat"), F.col(lon).alias("_glon"))
    points = points.withColumns({"_ty": F.floor(F.col("_glat") / tiles[0]), "_tx": F.floor(F.col("_glon") / tiles[0])})
    box = [F.min("_s").alias("_s"), F.max("_n").alias("_n"), F.min("_w").alias("_w"), F.max("_e").alias("_e")]
    levels = [points.select("_ty", "_tx", F.col("_glat").alias("_s"), F.col("_glat").alias("_n"), F.col("_glon").alias("_w"), F.col("_glon").alias("_e")).groupBy("_ty", "_tx").agg(*box)]
    for fine, coarse in zip(tiles, tiles[1:]):
        ratio = round(coarse / fine)
        levels.append(levels[-1].groupBy(F.floor(F.col("_ty") / ratio).alias("_ty"), F.floor(F.col("_tx") / ratio).alias("_tx")).agg(*box))
    y, x = F.col(lat), F.col(lon)
    near = F.pow(F.greatest(F.col("_s") - y, y - F.col("_n"), F.lit(0.0)), 2) + F.pow(F.greatest(F.col("_w") - x, x - F.col("_e"), F.lit(0.0)), 2)
    far = F.pow(F.greatest(F.abs(y - F.col("_s")), F.abs(y - F.col("_n"))), 2) + F.pow(F.greatest(F.abs(x - F.col("_w")), F.abs(x - F.col("_e"))), 2)
    places = rebased(stations).select(station, lat, lon)
    # The top has the four tiles around the origin at most.
    corner = F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    kept = places.withColumn("_py", F.explode(corner)).withColumn("_px", F.explode(corner))
    for k in reversed(range(len(tiles))):
        ratio = round(tiles[k + 1] / tiles[k]) if k + 1 < len(tiles) else 1
        table = levels[k].withColumns({"_py": F.floor(F.col("_ty") / ratio), "_px": F.floor(F.col("_tx") / ratio)})
        met = kept.join(table, ["_py", "_px"]).withColumns({"_near": near, "_far": far})
        best = met.groupBy(station).agg(F.min("_far").alias("_best"))
        # The margin covers the rounding of both distances.
        kept = met.join(best, station).filter(F.col("_near") <= F.col("_best") * (1 + 1e-9) + 1e-12).select(station, lat, lon, F.col("_ty").alias("_py"), F.col("_tx").alias("_px"))
    d2 = F.pow(F.col("_glat") - y, 2) + F.pow(F.col("_glon") - x, 2)
    met = kept.join(points.withColumnRenamed("_ty", "_py").withColumnRenamed("_tx", "_px"), ["_py", "_px"]).withColumn("d2", d2)
    return met.groupBy(station).agg(F.min(F.struct("d2", "_cell")).alias("_m")).select(station, "_m._cell.*", "_m.d2")
