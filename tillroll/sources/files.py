"""File sinks and sources: CSV / JSON round trips and validated, versioned publish.

Publishing never overwrites what readers use. Every build goes to its own
``version=<id>`` folder under the target; checks run against what was written
(read back, not the in-memory plan); only when they pass is the next numbered
record put into the target's ``_published`` log. A record is created only if
its number is free, so of two writers that started from the same version one
publishes and the other gets ``PublishConflict``. Readers resolve the record
with the highest number, so a failed build leaves the previous output in place
and older versions stay readable.

The conditional create is a hard link on local disk and a create without
overwrite elsewhere (HDFS and the stores that support it).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUBLISH_LOG = "_published"
LOG_SCHEMA = T.StructType(
    [
        T.StructField("sequence", T.LongType(), False),
        T.StructField("version", T.StringType(), False),
        T.StructField("published_at", T.DoubleType(), False),
        T.StructField("tables", T.ArrayType(T.StringType()), False),
    ]
)


class PublishError(RuntimeError):
    """A build failed its checks; nothing was published."""


class PublishConflict(PublishError):
    """Another writer published since this build began; nothing was published."""


def new_version() -> str:
    return time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + "-" + uuid.uuid4().hex[:8]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _write_text(fs, where, text: str, overwrite: bool) -> None:
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, only if there is none; False if there is."""
    fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    try:
        if fs.getUri().getScheme() != "file":
            _write_text(fs, where, text, False)
            return True
        jvm = spark._jvm
        beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
        _write_text(fs, beside, text, True)
        try:
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(where), local(beside))
            return True
        finally:
            fs.delete(beside, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def _put_in_place(spark: SparkSession, beside: str, path: str) -> None:
    """Put a written folder at ``path``. An earlier one is set aside first and
    comes back if the new one cannot take its place, so it is never lost."""
    fs, new = _file_system(spark, beside)
    old, aside = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"could not set the earlier export aside: {path}")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"could not put the export in place: {path}")
    if had:
        fs.delete(aside, True)


#: One dialect both ways: quotes are doubled, line breaks inside values are escaped.
_CSV = {"quote": '"', "escape": '"', "quoteAll": "true", "lineSep": "\n"}


def _escaped(c: Column) -> Column:
    """Line breaks as ``\\n`` and ``\\r``, a backslash doubled: a row stays on one line."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _unescaped(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def export_csv(df: DataFrame, path: str) -> str:
    """Write with a header beside ``path``, then put it in place whole: an export
    that fails leaves the earlier one as it was. Line breaks in text values are
    escaped, so that readers can split a file of any size."""
    text = {f.name for f in df.schema if f.dataType == T.StringType()}
    beside = f"{path}.{uuid.uuid4().hex}"
    rows = df.select(*[_escaped(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns])
    rows.write.option("header", True).options(**_CSV).csv(beside)
    _put_in_place(df.sparkSession, beside, path)
    return path


def import_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, required: list[str], multi_line: bool = False
) -> DataFrame:
    """Read CSV by column name, whatever the order, and cast to the declared
    schema; a malformed row or value fails. Columns of the schema that are
    neither required nor in the file are NULL. Files are split among tasks;
    ``multi_line`` is for files of other writers whose values hold real line
    breaks (nothing is unescaped then, and a file is one task)."""
    raw = spark.read.option("header", True).options(**_CSV, mode="FAILFAST", multiLine=str(multi_line).lower()).csv(path)
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"{path}: missing required columns {missing}")

    def value(f: T.StructField) -> Column:
        if f.name not in raw.columns:
            return F.lit(None)
        c = F.col(f"`{f.name}`")
        return _unescaped(c) if f.dataType == T.StringType() and not multi_line else c

    return raw.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema])


def export_json(df: DataFrame, path: str) -> str:
    """Like ``export_csv``: written beside ``path`` and put in place whole."""
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.json(beside)
    _put_in_place(df.sparkSession, beside, path)
    return path


def import_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_version(
    frames: Mapping[str, DataFrame],
    target: str,
    version: str,
    partition_by: Mapping[str, list[str]] | None = None,
) -> dict[str, str]:
    """Write each frame as parquet under ``target/version=<version>/<name>``.

    Independent frames are written as concurrent jobs (one driver thread
    each), so small jobs such as the summary tables share the executors
    instead of running one after another."""
    def write(name: str, df: DataFrame) -> str:
        path = f"{target}/version={version}/{name}"
        writer = df.write.mode("errorifexists")
        cols = (partition_by or {}).get(name)
        if cols:
            writer = writer.partitionBy(*cols)
        writer.parquet(path)
        return path

    if len(frames) == 1:
        return {name: write(name, df) for name, df in frames.items()}
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        futures = {name: pool.submit(write, name, df) for name, df in frames.items()}
        return {name: f.result() for name, f in futures.items()}


def published_versions(spark: SparkSession, target: str) -> DataFrame:
    """The publish log, newest first."""
    log = spark.read.schema(LOG_SCHEMA).json(f"{target}/{PUBLISH_LOG}")
    return log.where("version IS NOT NULL").orderBy(F.desc("sequence"))


def _last_record(spark: SparkSession, target: str):
    try:
        return published_versions(spark, target).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no log yet
            return None
        raise


def latest_version(spark: SparkSession, target: str) -> str | None:
    row = _last_record(spark, target)
    return row["version"] if row else None


class Publication:
    """One build on its way to be published: write, check, commit."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target, self.version = spark, target, new_version()
        last = _last_record(spark, target)
        self.after = (last["sequence"] or 0) if last else 0

    def write(self, frames: Mapping[str, DataFrame], partition_by: Mapping[str, list[str]] | None = None) -> dict[str, str]:
        return write_version(frames, self.target, self.version, partition_by)

    def commit(self, checks: DataFrame, tables: list[str]) -> None:
        """Publish if every row of ``checks`` is ok and nobody else published
        since this build began. ``checks`` has a boolean column ``ok``."""
        bad = checks.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("bad")).first()
        if not bad["n"] or bad["bad"]:
            raise PublishError(f"checks failed for {self.target} version {self.version}; previous output kept")
        record = {"sequence": self.after + 1, "version": self.version, "published_at": time.time(), "tables": list(tables)}
        if not put_new(self.spark, f"{self.target}/{PUBLISH_LOG}/{self.after + 1:012d}.json", json.dumps(record) + "\n"):
            raise PublishConflict(f"{self.target} was published by another writer; version {self.version} is not")


def validated_publish(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    target: str,
    checks: Callable[[Mapping[str, DataFrame]], DataFrame],
    partition_by: Mapping[str, list[str]] | None = None,
    readers: Mapping[str, Callable[[str], DataFrame]] | None = None,
) -> tuple[str, dict[str, str]]:
    """Write a new version beside the current one, check it, then publish.

    ``checks`` receives the written tables (read back) and returns a check
    DataFrame with a boolean ``ok`` column. Any false or null (or no rows) raises
    ``PublishError``, a publish by another writer meanwhile ``PublishConflict``;
    the log is left untouched then.
    """
    publication = Publication(spark, target)
    paths = publication.write(frames, partition_by)
    read = readers or {}
    written = {n: (read[n](p) if n in read else spark.read.parquet(p)) for n, p in paths.items()}
    publication.commit(checks(written).select("ok"), list(frames))
    return publication.version, paths


# ---- baselines ---------------------------------------------------------------------------

def read_baseline(spark: SparkSession, path: str) -> dict[str, float] | None:
    """The agreed figures of one input (a handful of metrics), or None."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    rows = spark.read.schema("metric string, expected double").json(path).where("metric IS NOT NULL").collect()
    return {r["metric"]: r["expected"] for r in rows}


def record_baseline(spark: SparkSession, path: str, figures: Mapping[str, float], replace: bool = False) -> bool:
    """Agree on figures; False if there is a baseline already (and it is kept)."""
    text = "".join(json.dumps({"metric": m, "expected": v}) + "\n" for m, v in figures.items())
    if not replace:
        return put_new(spark, path, text)
    fs, where = _file_system(spark, path)
    _write_text(fs, where, text, True)
    return True
