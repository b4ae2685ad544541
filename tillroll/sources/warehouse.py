"""The published tables: ``sales`` (partitioned by ``invoice_month``) and the
three summaries, built once per process from the input tables.

The build is the reference's batch job re-expressed for Spark:
read -> clean -> write a new version -> check what was written -> publish.
Query jobs then read the published parquet, so filters on ``invoice_month``
prune partitions and every query scans only the columns it uses. The tables
live in the shared folder named by ``spark.checkpoint.dir``, so they survive
lost executors and cut the lineage back to the raw joins.
"""

from __future__ import annotations

import functools
import hashlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import marts, quality
from ..operators.clean import SALES_COLUMNS, build_sales
from ..session import scratch_path
from . import files
from .invoices import month_parts, order_spread, sheets

SALES_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("unit_price", T.DecimalType(12, 2)),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("revenue", T.DecimalType(18, 2)),
        T.StructField("is_cancellation", T.BooleanType()),
        T.StructField("is_product", T.BooleanType()),
        T.StructField("is_outlier", T.BooleanType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("invoice_month", T.StringType()),
        T.StructField("copies", T.LongType()),
    ]
)

TABLE_NAMES = ("sales", "dim_month", "dim_product", "dim_customer")


class Warehouse:
    """Readers over one published version."""

    def __init__(self, spark: SparkSession, target: str, version: str, stamp: str | None = None):
        self.spark, self.target, self.version, self.stamp = spark, target, version, stamp
        self._derived: dict[str, str] = {}
        self._tables: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.target}/version={self.version}/{name}"

    def derived(self, name: str, build) -> DataFrame:
        """A table Spark derives from the published ones (e.g. the evidence
        log), written once beside them on first use and read back after.
        Many checks read it, so it is computed once instead of per query.
        Each process writes its own copy under a fresh folder, so a process
        sharing the version never sees a folder being replaced."""
        with _LOCK:
            if name not in self._derived:
                path = self.path(f"derived/{name}/run={files.new_version()}")
                build(self).write.mode("errorifexists").parquet(path)
                self._derived[name] = path
                self._tables[f"derived/{name}"] = self.spark.read.parquet(path)
            return self._tables[f"derived/{name}"]

    def table(self, name: str) -> DataFrame:
        """Reader over a published table. A version never changes after it is
        published, so one DataFrame per table is kept and reused: the folder
        listing (one directory per month) happens once, not per query."""
        with _LOCK:
            df = self._tables.get(name)
            if df is None:
                if name == "sales":
                    df = read_sales(self.spark, self.path("sales"))
                elif name == "sales_lineage":
                    df = read_sales(self.spark, self.path("sales"), with_copies=True)
                else:
                    df = self.spark.read.parquet(self.path(name))
                self._tables[name] = df
            return df

    @property
    def sales(self) -> DataFrame:
        return self.table("sales")

    @property
    def dim_month(self) -> DataFrame:
        return self.table("dim_month")

    @property
    def dim_product(self) -> DataFrame:
        return self.table("dim_product")

    @property
    def dim_customer(self) -> DataFrame:
        return self.table("dim_customer")


def read_sales(spark: SparkSession, path: str, with_copies: bool = False) -> DataFrame:
    """Declared schema: no inference pass, and the partition column stays text.
    ``copies`` (identical raw lines behind each row) is lineage, hidden unless asked."""
    df = spark.read.schema(SALES_SCHEMA).parquet(path)
    return df.select(*SALES_COLUMNS, *(["copies"] if with_copies else []))


def publish_checks(wh: Warehouse, baseline: dict[str, float] | None) -> DataFrame:
    """All four tables against each other, and the facts against the agreed
    figures of their input, if there are any."""
    ok = quality.smoke_checks(wh.sales, wh.dim_month).select("ok")
    ok = ok.unionByName(quality.summary_checks(wh.sales, wh.dim_product, wh.dim_customer))
    if baseline:
        ok = ok.unionByName(quality.baseline_check(wh.sales, int(baseline["rows"]), baseline["revenue"]).select("ok"))
    return ok


def build(spark: SparkSession, sf_dir: str, target: str, baseline_path: str | None = None, accept: bool = False) -> Warehouse:
    """Clean, write a version, check it, publish it. Returns readers over it.

    ``baseline_path`` holds the agreed row count and revenue of this input. A
    build that differs from them is not published, unless ``accept`` says that
    the change is meant. The first published build, or an accepted one, sets them.
    """
    publication = files.Publication(spark, target)
    # Within each month folder, rows are clustered by country and product, so
    # parquet row-group statistics let market and product filters skip data.
    # The month prefix is the order the partitioned writer needs anyway.
    sales = build_sales(
        sheets(spark, sf_dir), month_parts(spark, sf_dir), keep_copies=True, spread=order_spread(spark, sf_dir)
    ).sortWithinPartitions("invoice_month", "country", "stock_code")
    paths = publication.write({"sales": sales}, {"sales": ["invoice_month"]})
    written = read_sales(spark, paths["sales"])
    publication.write({
        "dim_month": marts.dim_month(written),
        "dim_product": marts.dim_product(written),
        "dim_customer": marts.dim_customer(written),
    })
    wh = Warehouse(spark, target, publication.version)
    baseline = files.read_baseline(spark, baseline_path) if baseline_path and not accept else None
    publication.commit(publish_checks(wh, baseline), list(TABLE_NAMES))
    if baseline_path and baseline is None:
        files.record_baseline(spark, baseline_path, quality.baseline_figures(wh.sales).first().asDict(), replace=accept)
    return wh


_LOCK = threading.RLock()
_BUILT: dict[str, Warehouse] = {}


def _rebind(old: Warehouse, spark: SparkSession) -> Warehouse:
    """Readers for an already published version in a new session."""
    wh = Warehouse(spark, old.target, old.version, old.stamp)
    wh._derived = dict(old._derived)
    for name, path in wh._derived.items():
        wh._tables[f"derived/{name}"] = spark.read.parquet(path)
    return wh


# Every module the build imports, relative to the package: a change to any of
# them gives a new target, so a version built by older code is never reused.
_BUILD_MODULES = (
    "sources/invoices.py", "sources/tables.py", "sources/files.py", "sources/warehouse.py",
    "operators/clean.py", "operators/marts.py", "operators/quality.py", "operators/rankings.py",
    "functions/calendar.py", "functions/money.py", "session.py",
)


@functools.lru_cache(maxsize=1)
def _code_fingerprint() -> str:
    """A hash of the modules that shape the published tables."""
    h = hashlib.sha1()
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for module in _BUILD_MODULES:
        with open(os.path.join(package, module), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()


def _local_fingerprint(sf_dir: str) -> str | None:
    """Content stamp of local inputs: file sizes and modification times of every
    input table. ``None`` for remote inputs."""
    if "://" in sf_dir and not sf_dir.startswith("file:"):
        return None
    root = sf_dir[len("file:"):] if sf_dir.startswith("file:") else sf_dir
    h = hashlib.sha1(os.path.abspath(root).encode())
    from .tables import TABLES, table_path

    seen = [n for n in TABLES if os.path.exists(table_path(root, n))]
    if not seen:  # a path of the default file system, which only Spark can list
        return None
    for name in seen:
        path = table_path(root, name)
        walk = [(path, [], [""])] if os.path.isfile(path) else os.walk(path)
        for base, _, names in walk:
            for n in sorted(names):
                st = os.stat(os.path.join(base, n) if n else base)
                h.update(f"{name}|{n}|{st.st_size}|{st.st_mtime_ns}".encode())
    return h.hexdigest()[:20]


def warehouse(spark: SparkSession, sf_dir: str, rebuild: bool = False, accept: bool = False) -> Warehouse:
    """The published warehouse for ``sf_dir``, built on first use and then
    shared by every query.

    A version is immutable once published. Local inputs are stamped (file sizes
    and modification times) on every call, so changed inputs under the same path
    are built anew, also within one process. Across processes, a version already
    published under the stamp of inputs and build code is reused. Within a
    process, a later session (e.g. after ``spark.stop()``) re-binds readers.
    ``rebuild=True`` always builds and publishes a new version (benchmarks time
    the build this way). ``accept=True`` publishes figures that differ from the
    input's baseline.
    """
    key = os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir.rstrip("/")
    with _LOCK:
        inputs = _local_fingerprint(sf_dir)
        if inputs is None:
            stamp = hashlib.sha1(f"{key}|{spark.sparkContext.applicationId}|{os.getpid()}".encode()).hexdigest()[:20]
        else:
            stamp = hashlib.sha1(f"{inputs}|{_code_fingerprint()}".encode()).hexdigest()[:20]
        wh = _BUILT.get(key)
        if wh is not None and inputs is not None and wh.stamp != stamp:
            wh = None
        if wh is not None and wh.spark is not spark:
            wh = _BUILT[key] = _rebind(wh, spark)
        if wh is None or rebuild:
            target = scratch_path(spark, "tillroll-warehouse", stamp)
            baseline = scratch_path(spark, "tillroll-baselines", f"{inputs}.json") if inputs else None
            version = None if rebuild else files.latest_version(spark, target)
            if version is None:
                try:
                    version = build(spark, sf_dir, target, baseline, accept).version
                except files.PublishConflict:  # the same input, published by another process
                    version = files.latest_version(spark, target)
            wh = _BUILT[key] = Warehouse(spark, target, version, stamp)
        return wh
