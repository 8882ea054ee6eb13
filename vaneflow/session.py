"""Session settings, scratch space and typed access to the driver tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "events": "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    "embeddings": "vec_id LONG, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id LONG, url STRING, html STRING",
    "benchmark": "item_id LONG, text STRING",
    "labels": "doc_id LONG, quality INT, toxic INT",
    "conversations": "conv_id LONG, turn LONG, role STRING, text STRING",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (safe to repeat)."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to `tune`."""
    builder = (
        SparkSession.builder.master(master)
        .appName("vaneflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_STAGED: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage: `spark.checkpoint.dir`, else a folder in the warehouse.

    The setting is trusted.  Without it, a warehouse on a local path is only used when the master is
    local too; on a cluster every machine would write to a disk of its own, so that is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return fallback_root(spark.sparkContext.master, warehouse)


def fallback_root(master: str, warehouse: str) -> str:
    """The scratch folder below `warehouse`, refused where machines of a cluster would not share it."""
    local_master = master == "local" or master.startswith("local[")
    local_path = warehouse.startswith("file:") or "://" not in warehouse
    if local_path and not local_master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse.rstrip('/')}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; `release` removes it."""
    path = f"{scratch_root(spark).rstrip('/')}/vaneflow/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged_paths(spark: SparkSession) -> list[str]:
    """The scratch folders handed out so far."""
    return list(_STAGED.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch folders, all that were handed out or those given; call it when results that read them are written."""
    held = _STAGED.setdefault(spark.sparkContext.applicationId, [])
    for path in list(held) if paths is None else paths:
        if path in held:
            held.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that several steps need to the shared folder and read it back.

    It is then computed once, later steps read only the columns they use, and a lost executor costs
    no more than its own tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """Stage independent intermediates at the same time, so small ones do not wait for each other."""
    with ThreadPoolExecutor(len(frames)) as pool:
        jobs = {name: pool.submit(stage, df, name) for name, df in frames.items()}
        return {name: job.result() for name, job in jobs.items()}


class Tables:
    """The driver tables of one scale factor, each read with its declared schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)
