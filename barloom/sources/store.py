"""Bars in versioned Parquet folders: reads, writes, range upserts, deletes, sizes, compaction.

A table's partitions are asset, resolution, provider, symbol_bucket and month, so that one symbol's month lies in one
folder of its bucket. No file is ever changed: a write lays new folders below data/version=…, lists what each of its
files holds in _segments, lists the table's folders in _manifests, and takes effect by one small file in _log, which
names that list. Readers go by the last of these files, so they see all of a write or nothing, and go on seeing the
folders they began with. Rows that belong to a table but are no bars (provenance, issues) count from the same commit on.

Writers may run at once. One whose folders were changed under it gets a Conflict; others go on from the newer list.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import FIELDS, by_day

PARTITIONS = ("asset", "resolution", "provider", "symbol_bucket", "month")
BUCKETS = 64
_FOLDER = "asset string, resolution string, provider string, symbol_bucket int, month string"
_ROWS = "symbol string, ts timestamp, " + ", ".join(f"{f} double" for f in FIELDS) + f", {_FOLDER}"
_MANIFEST = _FOLDER + ", version string"
_SEGMENTS = f"symbol string, {_FOLDER}, file string, size long, rows long, first_ts timestamp, last_ts timestamp, version string"
_lock = threading.Lock()


class Conflict(RuntimeError):
    """Another writer changed a folder that this one read."""


def bucket(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


def with_partitions(bars: DataFrame, asset: str, resolution: str, provider: str) -> DataFrame:
    return bars.withColumns({"asset": F.lit(asset), "resolution": F.lit(resolution), "provider": F.lit(provider), "symbol_bucket": bucket(F.col("symbol")), "month": F.date_format("ts", "yyyy-MM")})


# --- files ----------------------------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that is there in full or not at all; False where one of its name is there already."""
    jvm = spark.sparkContext._jvm
    at, fs = _path(spark, path)
    tmp, _ = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    with _lock:
        if fs.exists(at):
            fs.delete(tmp, False)
            return False
        try:
            context.rename(tmp, at, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            fs.delete(tmp, False)
            if fs.exists(at):
                return False
            raise
    return True


def _text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# --- commits --------------------------------------------------------------------------------------------------------


def head(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The number of the last commit and the name of its list of folders; 0 and None for a new table."""
    found = [n for n in _names(spark, f"{path.rstrip('/')}/_log") if not n.startswith(".")]
    return (int(found[-1]), _text(spark, f"{path.rstrip('/')}/_log/{found[-1]}").split("\t")[1]) if found else (0, None)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(version) of every write that took effect."""
    log = f"{path.rstrip('/')}/_log"
    return spark.read.text(log).select(F.split("value", "\t")[0].alias("version")) if exists(spark, log) else spark.createDataFrame([], "version string")


def is_committed(spark: SparkSession, path: str, version: str) -> bool:
    return not committed(spark, path).where(F.col("version") == version).isEmpty()


def folders(spark: SparkSession, path: str, manifest: str | None = "") -> DataFrame:
    """(partition columns, version): the table's folders, of the last commit or of the list that is named."""
    name = head(spark, path)[1] if manifest == "" else manifest
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/_manifests/{name}") if name else spark.createDataFrame([], _MANIFEST)


def _write_version(rows: DataFrame, path: str, version: str, rows_per_file: int = 0, deal: list[Column] | None = None) -> DataFrame:
    """Lay rows under a version and list what its files hold; returns that list. Nobody reads it before the commit.

    Rows are dealt into ranges of folder, symbol and time, so tasks are of one size whatever a folder holds: a large one
    is written by several, small ones share one. deal: what sends rows to tasks by hash, where ranges aren't wanted.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    order = [*PARTITIONS, "symbol", "ts"]
    dealt = rows.repartition(*PARTITIONS, *deal) if deal else rows.repartitionByRange(*order)
    w = dealt.sortWithinPartitions(*order).select("symbol", "ts", *FIELDS, *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS)
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(f"{path}/data/version={version}")
    laid = spark.read.schema(_ROWS).option("basePath", f"{path}/data/version={version}").parquet(f"{path}/data/version={version}")
    held = laid.groupBy("symbol", *PARTITIONS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    held.write.mode("overwrite").parquet(f"{path}/_segments/version={version}")
    return spark.read.schema(_SEGMENTS.removesuffix(", version string")).parquet(f"{path}/_segments/version={version}")


def _commit(spark: SparkSession, path: str, version: str, laid: DataFrame | None, replaced: DataFrame | None, base: tuple[int, str | None] | None = None) -> None:
    """Put a version into effect: its folders for the replaced ones (those of the same name, where none are given).

    base: the commit that the writer read from; if a replaced folder has another version since, that is a Conflict.
    """
    path = path.rstrip("/")
    fresh = (laid.select(*PARTITIONS).distinct() if laid is not None else folders(spark, path, None).select(*PARTITIONS)).withColumn("version", F.lit(version))
    gone = fresh.select(*PARTITIONS) if replaced is None else replaced.select(*PARTITIONS)
    on = list(PARTITIONS)
    while True:
        number, name = head(spark, path)
        live = folders(spark, path, name)
        if base is not None and base[0] != number:
            was, now = (folders(spark, path, m).join(gone, on, "left_semi") for m in (base[1], name))
            if not was.exceptAll(now).isEmpty() or not now.exceptAll(was).isEmpty():
                raise Conflict(f"folders of {path} were changed by another writer")
        manifest = f"{version}-{number + 1}"
        live.join(gone, on, "left_anti").unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifests/{manifest}")
        if _publish(spark, f"{path}/_log/{number + 1:012d}", f"{version}\t{manifest}"):
            return
        drop(spark, f"{path}/_manifests/{manifest}")


def _beside(beside: dict[str, DataFrame] | None, path: str, version: str) -> None:
    for name, rows in (beside or {}).items():
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/_{name}/version={version}")


def append(rows: DataFrame, path: str, name: str, version: str | None = None) -> None:
    """Add rows to a table that belongs to the bars at path, by a commit of their own."""
    version = version or uuid.uuid4().hex
    _beside({name: rows}, path, version)
    _commit(rows.sparkSession, path, version, None, None)


def appended(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows that were committed beside bars under a name, of all commits so far."""
    at = f"{path.rstrip('/')}/_{name}"
    if not exists(spark, at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, version string").parquet(at)
    return rows.join(committed(spark, path), "version", "left_semi").drop("version")


def write(bars: DataFrame, path: str, asset: str, resolution: str, provider: str, rows_per_file: int = 0) -> None:
    """Replace every partition that bars have rows in. A row that repeats stays; no row, no change."""
    write_rows(with_partitions(bars, asset, resolution, provider), path, rows_per_file)


def write_rows(rows: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """write() for rows that have the partition columns."""
    version = uuid.uuid4().hex
    _commit(rows.sparkSession, path, version, _write_version(rows, path, version, rows_per_file), None)


def merged(stored: DataFrame, new: DataFrame, ranges: DataFrame) -> DataFrame:
    """stored without what lies in its symbol's ranges (symbol, start_ts, end_ts; ends included), and what of new lies in them."""
    return by_day(stored, ranges, "left_anti").select("symbol", "ts", *FIELDS).unionByName(by_day(new, ranges, "left_semi").select("symbol", "ts", *FIELDS))


def touched_folders(ranges: DataFrame, asset: str, resolution: str, provider: str) -> DataFrame:
    """The partitions that ranges reach into: a month each, at most BUCKETS a month."""
    months = F.explode(F.sequence(F.trunc("start_ts", "month"), F.trunc("end_ts", "month"), F.expr("interval 1 month")))
    each = ranges.where("start_ts <= end_ts").select(bucket(F.col("symbol")).alias("symbol_bucket"), months.alias("m"))
    return each.select(F.lit(asset).alias("asset"), F.lit(resolution).alias("resolution"), F.lit(provider).alias("provider"), "symbol_bucket", F.date_format("m", "yyyy-MM").alias("month")).distinct()


def update(new: DataFrame, ranges: DataFrame, path: str, asset: str, resolution: str, provider: str, beside: dict[str, DataFrame] | None = None, version: str | None = None, keep_better: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Replace all that is stored in the ranges by what of new lies in them; nothing outside of them changes.

    Only partitions that ranges reach into are written anew. beside: rows that are committed along, by name. version: a
    name for this update; one of a name that was committed already changes nothing and returns False. keep_better: takes
    what is stored in the ranges and new, with `fresh` false and true, and returns the rows to be stored in their place.
    """
    spark, version = new.sparkSession, version or uuid.uuid4().hex
    if is_committed(spark, path, version):
        return False
    base = head(spark, path)
    # Names of folders, as for any listing: at most BUCKETS a month.
    touched = spark.createDataFrame(touched_folders(ranges, asset, resolution, provider).collect(), _FOLDER)
    old = _read_folders(spark, path, folders(spark, path, base[1]).join(touched, list(PARTITIONS), "left_semi")).select("symbol", "ts", *FIELDS)
    if keep_better is not None:
        both = by_day(old, ranges, "left_semi").withColumn("fresh", F.lit(False)).unionByName(new.select("symbol", "ts", *FIELDS).withColumn("fresh", F.lit(True)))
        new = keep_better(both)
    laid = _write_version(with_partitions(merged(old, new, ranges), asset, resolution, provider), path, version)
    _beside(beside, path, version)
    _commit(spark, path, version, laid, touched, base)
    return True


def recover(spark: SparkSession, path: str) -> int:
    """Delete what writers left that were broken off before their commit; how many there were. Call it while nobody writes."""
    path, known = path.rstrip("/"), {r["version"] for r in committed(spark, path).collect()}
    lost = set()
    for folder in [n for n in _names(spark, path) if n == "data" or n.startswith("_") and n not in ("_log", "_manifests")]:
        for name in _names(spark, f"{path}/{folder}"):
            if name.startswith("version=") and name.removeprefix("version=") not in known:
                drop(spark, f"{path}/{folder}/{name}")
                lost.add(name)
    return len(lost)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the last commit has no use for; how many there were. Call it while nobody reads an older state."""
    path = path.rstrip("/")
    at = f"{path}/_segments"
    if not exists(spark, at):
        return 0
    _, name = head(spark, path)
    on = [*PARTITIONS, "version"]
    all_ = spark.read.schema(_SEGMENTS).parquet(at).join(committed(spark, path), "version", "left_semi").select(*on).distinct()
    stale = all_.join(folders(spark, path, name), on, "left_anti").collect()  # names of folders, not rows
    there = [f for f in _folder_paths(spark, path, stale) if exists(spark, f)]
    for folder in there:
        drop(spark, folder)
    for old in _names(spark, f"{path}/_manifests"):
        if old != name:
            drop(spark, f"{path}/_manifests/{old}")
    return len(there)


# --- reading --------------------------------------------------------------------------------------------------------


def _folder_paths(spark: SparkSession, path: str, rows: list) -> list[str]:
    named = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    known: dict = {}

    def part(column: str, value) -> str:
        if (column, value) not in known:
            known[column, value] = named(column, None if value is None else str(value))
        return known[column, value]

    return ["/".join([path.rstrip("/"), "data", f"version={r['version']}", *(part(c, r[c]) for c in PARTITIONS)]) for r in rows]


def _read_folders(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen folders; their names come to the driver, as for any listing of files."""
    paths = _folder_paths(spark, path, chosen.collect())
    if not paths:
        return spark.createDataFrame([], _ROWS)
    return spark.read.schema(f"{_ROWS}, version string").option("basePath", f"{path.rstrip('/')}/data").parquet(*paths).drop("version")


def load(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The table's rows with their partition columns; where: a condition on these, by which folders are chosen."""
    chosen = folders(spark, path)
    return _read_folders(spark, path, chosen if where is None else chosen.where(where))


def _library(asset: str | None, resolution: str | None, provider: str | None) -> Column:
    out = F.lit(True)
    for name, value in (("asset", asset), ("resolution", resolution), ("provider", provider)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def read(spark: SparkSession, path: str, symbols: list[str] | None = None, start=None, end=None, columns: list[str] | None = None, asset: str | None = None, resolution: str | None = None, provider: str | None = None) -> DataFrame:
    """Bars of symbols from start to end, both included; folders and row groups that can't hold any are skipped."""
    where, rows = _library(asset, resolution, provider), F.lit(True)
    if symbols is not None:
        where = where & (F.col("symbol_bucket").isin([bucket(F.lit(x)) for x in symbols]) if symbols else F.lit(False))
        rows = rows & F.col("symbol").isin(symbols)
    if start is not None:
        where, rows = where & (F.col("month") >= f"{start:%Y-%m}"), rows & (F.col("ts") >= F.lit(start))
    if end is not None:
        where, rows = where & (F.col("month") <= f"{end:%Y-%m}"), rows & (F.col("ts") <= F.lit(end))
    return load(spark, path, where).where(rows).select(*(columns or ["symbol", "ts", *FIELDS]))


def files(spark: SparkSession, path: str, asset: str | None = None, resolution: str | None = None, provider: str | None = None) -> DataFrame:
    """(symbol, partition columns, file, size, rows, first_ts, last_ts): the files a symbol has rows in, as writers listed them; no bar is read."""
    at = f"{path.rstrip('/')}/_segments"
    if not exists(spark, at):
        return spark.createDataFrame([], _SEGMENTS).drop("version")
    live = folders(spark, path).where(_library(asset, resolution, provider))
    return spark.read.schema(_SEGMENTS).parquet(at).join(live, [*PARTITIONS, "version"], "left_semi").drop("version")


def spans(spark: SparkSession, path: str, asset: str | None = None, resolution: str | None = None, provider: str | None = None) -> DataFrame:
    """(symbol, first_ts, last_ts, rows) of stored symbols; no bar is read."""
    return files(spark, path, asset, resolution, provider).groupBy("symbol").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("rows").alias("rows"))


def delete_symbol(spark: SparkSession, path: str, symbol: str, asset: str, resolution: str, provider: str) -> None:
    """Take a symbol out of its partitions."""
    ranges = spans(spark, path, asset, resolution, provider).where(F.col("symbol") == symbol).select("symbol", F.col("first_ts").alias("start_ts"), F.col("last_ts").alias("end_ts"))
    update(spark.createDataFrame([], _ROWS), ranges, path, asset, resolution, provider)


def list_symbols(bars: DataFrame) -> DataFrame:
    """(symbol) of bars, or of what files() or spans() give, which reads no bar."""
    return bars.select("symbol").distinct()


def wanted_and_there(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, there) for wanted symbols."""
    known = list_symbols(bars).withColumn("there", F.lit(True))
    return wanted.select("symbol").distinct().join(known, "symbol", "left").withColumn("there", F.coalesce("there", F.lit(False)))


# --- sizes and compaction -------------------------------------------------------------------------------------------


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, and the partition columns) of every file of the table, from a listing alone: no file is opened."""
    paths = _folder_paths(spark, path, folders(spark, path).collect())
    if not paths:
        return spark.createDataFrame([], "path string, length long").select(F.col("path").alias("file"), F.col("length").alias("size"), *[F.lit("").alias(c) for c in PARTITIONS])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path", "length")
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"), *[F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in PARTITIONS])


def symbol_sizes(listed: DataFrame) -> DataFrame:
    """(symbol, size_bytes, segments, folders, rows); a file that several symbols share is divided among them by rows, so sizes add up to the library's but for rounding down."""
    shared = listed.groupBy("file").agg(F.sum("rows").alias("all_rows"))
    own = F.floor(F.col("size") * F.col("rows") / F.col("all_rows"))
    folder = F.regexp_extract("file", "^(.*)/", 1)
    return listed.join(shared, "file").groupBy("symbol").agg(F.sum(own).alias("size_bytes"), F.count("*").alias("segments"), F.count_distinct(folder).alias("folders"), F.sum("rows").alias("rows"))


def symbol_fragmentation(listed: DataFrame, target_rows: int = 1_000_000) -> DataFrame:
    """(symbol, segments, rows, needed, fragmented): whether a symbol has more files than its rows need, folder by folder."""
    return _fragments(listed, target_rows).groupBy("symbol").agg(F.sum("segments").alias("segments"), F.sum("rows").alias("rows"), F.sum("needed").alias("needed")).withColumn("fragmented", F.col("segments") > F.col("needed"))


def _fragments(listed: DataFrame, target_rows: int) -> DataFrame:
    out = listed.groupBy(*PARTITIONS, "symbol").agg(F.count("*").alias("segments"), F.sum("rows").alias("rows"))
    return out.withColumn("needed", F.ceil(F.col("rows") / target_rows))


def library_size(listed: DataFrame) -> DataFrame:
    """One row: bytes and files, each file once; takes listing() as well as files()."""
    return listed.select("file", "size").distinct().agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.count("*").alias("segments"))


def provenance(new: DataFrame, library: str, provider: str, note: str | None = None) -> DataFrame:
    """A row per symbol of a load, for appending."""
    return new.groupBy("symbol").agg(F.min("ts").alias("range_start"), F.max("ts").alias("range_end")).select(F.lit(library).alias("library"), "symbol", "range_start", "range_end", F.lit(provider).alias("provider"), F.current_timestamp().alias("loaded_at"), F.lit(note).cast("string").alias("note"))


def _content(rows: DataFrame, prefix: str) -> DataFrame:
    """Per folder and symbol the number of rows and a sum that tells whether they are the same ones."""
    # Doubles are compared as they are written, so that -0.0 and 0.0 stay apart.
    each = F.xxhash64("symbol", "ts", *[F.col(f).cast("string") for f in FIELDS])
    return rows.groupBy(*PARTITIONS, "symbol").agg(F.count("*").alias(f"{prefix}_rows"), F.sum(each.cast("decimal(38,0)")).alias(f"{prefix}_sum"))


def compact(spark: SparkSession, path: str, target_rows: int = 1_000_000, dry_run: bool = False, symbols: DataFrame | None = None, only: bool = False, copy: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Bring symbols that lie in more files than their rows need into as few; (partition columns, symbol, status, segments_before, segments_after).

    Of a folder only the fragmented symbols are dealt anew, each into a file for every target_rows of its rows; the rows
    of others stay together as they were. status: ok, would_defrag (dry run), defragmented, or failed: what `copy` makes
    of a symbol's rows isn't the same rows, so the symbol stays as it was. With symbols given, those without
    bars have a row of status missing, and with `only` no others are looked at. The folders change by one commit; what was written is counted
    once more before it, and a folder that doesn't hold what it held is no part of it.
    """
    base, on = head(spark, path), [*PARTITIONS, "symbol"]
    listed = files(spark, path)
    looked = listed.join(symbols.select("symbol").distinct(), "symbol", "left_semi") if only else listed
    before = materialised(_fragments(looked, target_rows).withColumn("fragmented", F.col("segments") > F.col("needed")))
    todo = before.where("fragmented").select(*on, "needed")
    out = before.withColumns({"status": F.when(~F.col("fragmented"), "ok").otherwise("would_defrag"), "segments_after": F.col("segments")})
    if not dry_run and not todo.isEmpty():
        done = _defragment(spark, path, base, todo, copy)
        after = _fragments(files(spark, path), target_rows).select(*on, F.col("segments").alias("now"))
        status = F.when(~F.col("fragmented"), "ok").when(F.col("done"), "defragmented").otherwise("failed")
        out = before.join(after, on, "left").join(done, on, "left").withColumns({"status": status, "segments_after": F.col("now")})
    out = out.select(*on, "status", F.col("segments").alias("segments_before"), "segments_after")
    if symbols is not None:
        lost = wanted_and_there(symbols, listed).where("not there").select("symbol", F.lit("missing").alias("status"))
        out = out.unionByName(lost, allowMissingColumns=True)
    return out


def _defragment(spark: SparkSession, path: str, base: tuple[int, str | None], todo: DataFrame, copy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rewrite the symbols of todo (partition columns, symbol, needed) within their folders; (partition columns, symbol, done) of those that were."""
    on, folder = [*PARTITIONS, "symbol"], list(PARTITIONS)
    touched = materialised(todo.select(*folder).distinct())
    chosen = folders(spark, path, base[1]).join(touched, folder, "left_semi")
    part = _read_folders(spark, path, chosen).withColumn("_deal", F.col("_metadata.file_name"))
    had = materialised(_content(part, "old"))
    copied = _content(copy(part.join(todo, on, "left_semi").drop("_deal")), "new")
    good = materialised(todo.join(had, on).join(copied, on).where("old_rows = new_rows and old_sum = new_sum").select(*on, "needed"))
    # Rows that stay go by the file they came from, the others by symbol and day.
    moved = copy(part.join(good, on, "left_semi").drop("_deal")).join(good, on).withColumn("_deal", F.concat_ws(":", "symbol", F.pmod(F.xxhash64(F.to_date("ts")), F.col("needed"))))
    rest = part.join(good, on, "left_anti")
    columns, version = ["symbol", "ts", *FIELDS, *PARTITIONS, "_deal"], uuid.uuid4().hex
    laid = _write_version(moved.select(*columns).unionByName(rest.select(*columns)), path, version, deal=[F.col("_deal")])
    new = spark.read.schema(_ROWS).option("basePath", f"{path.rstrip('/')}/data/version={version}").parquet(f"{path.rstrip('/')}/data/version={version}")
    lost = had.join(_content(new, "new"), on, "full").where("not (old_rows <=> new_rows and old_sum <=> new_sum)").select(*folder).distinct()
    fine = materialised(touched.join(lost, folder, "left_anti"))
    _commit(spark, path, version, laid.join(fine, folder, "left_semi"), fine, base)
    return good.join(fine, folder, "left_semi").select(*on, F.lit(True).alias("done"))


def status_counts(report: DataFrame) -> DataFrame:
    """(status, n, segments_before, segments_after) of a report of compact()."""
    return report.groupBy("status").agg(F.count("*").alias("n"), F.sum("segments_before").alias("segments_before"), F.sum("segments_after").alias("segments_after"))


# --- scratch --------------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; a local one only in local mode, where none is set."""
    import tempfile

    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, worked out once and read from the shared folder from then on."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """materialised() whose tables go when the block ends."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "rows"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            drop(spark, path)
