"""Reading, appending and expiring the stored tables (Parquet, one folder per month)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Collection, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.functions.measures import row_count
from stallwise.functions.time import ago, moment, month_of
from stallwise.operators.worklist import apply_updates
from stallwise.sources.files import (
    NOTED,
    REWRITE,
    TAKEN,
    Ledger,
    age_seconds,
    data_files,
    delete_folder,
    list_folder,
    month_folder,
    new_run,
    read_files,
    read_text,
    rename_folder,
    staged_files,
    take_rewrite,
    write_text,
)
from stallwise.sources.schemas import NOW, PRICE_HISTORY, PRODUCTS, REVIEWS, SCRAPING_LOGS, TRENDS, Table

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def read_table(
    spark: SparkSession,
    table: Table,
    path: str,
    since: datetime | None = None,
    until: datetime | None = None,
    months: Collection[int] | None = None,
    keep_month: bool = False,
) -> DataFrame:
    """A stored table; ``since``, ``until`` and ``months`` also cut the month folders.

    A filter on the timestamp alone would open every folder, because Spark
    cannot derive the month from it. ``keep_month`` leaves the month column in
    the result, from which the look-back operators cut folders themselves.
    """
    schema = T.StructType(table.schema.fields)
    if table.month_of:
        schema = schema.add(table.month_column, T.IntegerType())
    df = spark.read.schema(schema).parquet(path)
    if not table.month_of:
        return df
    month, ts = F.col(table.month_column), F.col(table.month_of)
    if since is not None:
        df = df.where((month >= since.year * 100 + since.month) & (ts >= moment(since)))
    if until is not None:
        df = df.where((month <= until.year * 100 + until.month) & (ts <= moment(until)))
    if months is not None:
        df = df.where(month.isin(sorted(months)))
    return df if keep_month else df.drop(table.month_column)


def conform(df: DataFrame, table: Table, as_of: datetime | None = None) -> DataFrame:
    """Columns, types and defaults of ``table``; unknown columns are an error.

    Absent columns become their default, or null where there is none. Text
    timestamps are read as ``yyyy-MM-dd HH:mm:ss``.
    """
    unknown = set(df.columns) - set(table.schema.names)
    if unknown:
        raise ValueError(f"columns not in {table.name}: {sorted(unknown)}")
    return df.select(*_columns(df, table, as_of, {}).values())


def _columns(df: DataFrame, table: Table, as_of: datetime | None, same: Mapping[str, Column]) -> dict[str, Column]:
    given = {f.name: f.dataType for f in df.schema.fields}
    return {f.name: _column(f, given, table, as_of, same).alias(f.name) for f in table.schema.fields}


def _column(field: T.StructField, given: dict, table: Table, as_of: datetime | None, same: Mapping[str, Column]) -> Column:
    value = same.get(field.name, F.lit(None))
    if field.name in given and field.name not in same:
        value = F.col(field.name)
        is_text = isinstance(given[field.name], T.StringType)
        if is_text and isinstance(field.dataType, T.TimestampNTZType):
            value = F.to_timestamp_ntz(value, F.lit(TIME_TEXT))
        elif isinstance(given[field.name], T.BooleanType):
            value = value.cast("int")
    value = value.cast(field.dataType)
    if field.name not in table.defaults:
        return value
    default = table.defaults[field.name]
    if default is NOW:
        fallback = moment(as_of)
    elif default == {}:
        fallback = F.create_map()
    elif default == []:
        fallback = F.array()
    else:
        fallback = F.lit(default)
    return F.coalesce(value, fallback.cast(field.dataType))


def _layout(rows: DataFrame, table: Table, by_month: bool = False, same: Mapping[str, Column] | None = None):
    """Writer for rows of the table: rebalanced by month, sorted inside the files.

    ``rebalance`` groups a month's rows into few files; adaptive execution
    splits a month that is too large for one task and merges small ones. Rows
    that are together ``by_month`` already are written where they are. Columns
    with the ``same`` value in all rows are neither shuffled nor sorted.
    """
    same = dict(same or {})
    keys = [key for key in table.sort_by if key not in same]
    if table.month_of:
        month = month_of(same.get(table.month_of, F.col(table.month_of))).alias(table.month_column)
        rows = rows.withColumn(table.month_column, month)
        if not by_month:
            rows = rows.hint("rebalance", F.col(table.month_column))
        if table.month_of in same:
            same[table.month_column] = month
        else:
            keys = [table.month_column, *keys]
    if keys:
        rows = rows.sortWithinPartitions(*keys)
    if same:
        names = [*table.schema.names, *([table.month_column] if table.month_of else [])]
        rows = rows.select(*(same.get(name, name) for name in names))
    writer = rows.write
    if table.month_of:
        writer = writer.partitionBy(table.month_column)
    for column in table.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def append(df: DataFrame, table: Table, path: str, as_of: datetime | None = None, same: Mapping[str, Column] | None = None) -> int:
    """Append rows and return how many were written, counted during the write.

    ``same`` gives columns that have one value in all rows; they count as given.
    """
    seen = Observation()
    unknown = {*df.columns, *(same or {})} - set(table.schema.names)
    if unknown:
        raise ValueError(f"columns not in {table.name}: {sorted(unknown)}")
    columns = _columns(df, table, as_of, same or {})
    varying = [name for name in columns if name in df.columns and name not in (same or {})]
    rows = df.select(*(columns[name] for name in varying)).observe(seen, row_count().alias("rows"))
    _layout(rows, table, same={name: columns[name] for name in columns if name not in varying}).mode("append").parquet(path)
    # Rows that the optimizer knows to be none are never counted: the observation is then an empty row.
    counted = seen._jo.getRow()
    return int(counted.getLong(0)) if counted.size() else 0


def stored_months(spark: SparkSession, table: Table, path: str) -> set[int]:
    prefix = f"{table.month_column}="
    names = (n[len(prefix):] for n in list_folder(spark, path) if n.startswith(prefix))
    return {int(n) for n in names if n.isdigit()}


def write_products(df: DataFrame, path: str, as_of: datetime | None = None, same: Mapping[str, Column] | None = None) -> int:
    return append(df, PRODUCTS, path, as_of, same)


def write_reviews(df: DataFrame, path: str, as_of: datetime | None = None) -> int:
    return append(df, REVIEWS, path, as_of)


def write_price_points(df: DataFrame, path: str, as_of: datetime | None = None) -> int:
    return append(df, PRICE_HISTORY, path, as_of)


def write_trends(df: DataFrame, path: str, as_of: datetime | None = None) -> int:
    return append(df, TRENDS, path, as_of)


def apply_retention(df: DataFrame, column: str, days: int, as_of: datetime | None = None) -> DataFrame:
    """Rows that are not older than ``days``; rows without a time are kept."""
    ts = F.col(column)
    return df.where((ts >= ago(as_of, days=days)) | ts.isNull())


RETENTION_DAYS = {SCRAPING_LOGS.name: 30, PRICE_HISTORY.name: 90}


def finish_rewrites(spark: SparkSession, table: Table, path: str) -> None:
    """Finish what a lost maintenance job had made final, and remove what it had not.

    A rewrite that names a ledger is final as soon as the ledger holds its run.
    """
    for name in list_folder(spark, path):
        if not name.startswith(REWRITE):
            continue
        rewrite = name.removeprefix(REWRITE)
        folder = f"{table.month_column}={rewrite}"
        held = list_folder(spark, f"{path}/{name}")
        # Files of a month whose folder is gone have nothing left to replace.
        whole = "_SUCCESS" in held and any(n.startswith("part-") for n in held) and not list_folder(spark, f"{path}/{folder}")
        noted = NOTED in held and Ledger(spark, read_text(spark, f"{path}/{name}/{NOTED}")).holds(rewrite)
        if TAKEN in held or whole or noted:
            take_rewrite(spark, path, rewrite, folder=folder)
        else:
            delete_folder(spark, f"{path}/{name}")


def stage(rows: DataFrame, table: Table, path: str, rewrite: str, by_month: bool = False) -> None:
    """Write rows of the table into a staging folder of it, in the table's layout."""
    writer = _layout(conform(rows, table), table, by_month).mode("overwrite")
    writer.option("partitionOverwriteMode", "static").parquet(f"{path}/{REWRITE}{rewrite}")


def replace_files(rows: DataFrame, table: Table, path: str, files: Sequence[str]) -> None:
    """Put ``rows`` in the place of exactly the named files; any other file stays."""
    spark, rewrite = rows.sparkSession, new_run()
    stage(rows, table, path, rewrite)
    take_rewrite(spark, path, rewrite, files)


def expired_files(spark: SparkSession, table: Table, path: str, days: int, as_of: datetime) -> list[str]:
    """Files of the cut-off month that hold expired rows; statistics spare most others from being read."""
    cut = as_of - timedelta(days=days)
    folder = f"{table.month_column}={cut.year * 100 + cut.month}"
    files = [f"{folder}/{name}" for name in list_folder(spark, f"{path}/{folder}") if name.startswith("part-")]
    rows = read_files(spark, table.schema, path, files)
    if not files:
        return []
    old = rows.where(F.col(table.month_of) < moment(cut)).select(F.col("_metadata.file_name").alias("name")).distinct()
    return [f"{folder}/{row.name}" for row in old.collect()]


def expire_months(spark: SparkSession, table: Table, path: str, days: int, as_of: datetime) -> None:
    """Retention on a stored table: drop old month folders, rewrite the files on the cut-off.

    Months before the cut-off month are deleted without reading them. Of the
    month the cut-off falls into, the files with expired rows are replaced by
    their other rows; files that are appended meanwhile stay.
    """
    cut = as_of - timedelta(days=days)
    finish_rewrites(spark, table, path)
    for month in sorted(m for m in stored_months(spark, table, path) if m < cut.year * 100 + cut.month):
        delete_folder(spark, f"{path}/{table.month_column}={month}")
    files = expired_files(spark, table, path, days, as_of)
    if files:
        rows = read_files(spark, table.schema, path, files)
        replace_files(apply_retention(rows, table.month_of, days, as_of), table, path, files)


def update_stored(
    spark: SparkSession, table: Table, path: str, changes: DataFrame, key: str, columns: Sequence[str] | None = None
) -> list[str]:
    """Keyed update of a stored table that rewrites the files with changed rows only; gives their names.

    The files are found by a scan of the key column. A table that others are
    made from file by file is append-only and not updated this way.
    """
    finish_rewrites(spark, table, path)
    keys = changes.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    base = read_table(spark, table, path).select(key, F.substring_index("_metadata.file_path", "/", -2).alias("file"))
    touched = base.join(keys, F.col(key) == F.col("_key"), "left_semi").select("file").distinct()
    files = sorted(row.file for row in touched.collect())
    if files:
        rows = read_files(spark, table.schema, path, files)
        replace_files(apply_updates(rows, changes, key, columns), table, path, files)
    return files


SMALL_BYTES = 32 << 20
FULL_SHARE = 1.125
"""Merged files are made of so many times the bytes that count as small: rows take a little less together than apart."""
TASKS_PER_CORE = 4


def file_groups(lengths: Mapping[str, int], full: float) -> list[list[str]]:
    """The named files in groups of one month each, which hold at least ``full`` bytes but for the last of a month.

    A group ends with the file that fills it. Files that would be alone are left out.
    """
    groups, month, held = [], None, 0
    for name in sorted(lengths):
        if month != month_folder(name) or held >= full:
            groups.append([])
            month, held = month_folder(name), 0
        groups[-1].append(name)
        held += lengths[name]
    return [names for names in groups if len(names) > 1]


def _brought_together(spark: SparkSession, table: Table, path: str, groups: Sequence[Sequence[str]], lengths: Mapping[str, int], full: float) -> DataFrame:
    """The rows of the files, those of a group in one task; a task has several groups that are small."""
    names = [name for group in groups for name in group]
    share = min(full, sum(lengths[name] for name in names) / (TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    places, task, held = [], 0, 0
    for group in groups:
        if held >= share:
            task, held = task + 1, 0
        places += [(name, task) for name in group]
        held += sum(lengths[name] for name in group)
    rows = read_files(spark, table.schema, path, names).withColumn("_file", F.substring_index("_metadata.file_path", "/", -2))
    rows = rows.join(F.broadcast(spark.createDataFrame(places, "_file string, _task int")), "_file", "left")
    return rows.repartitionById(task + 1, "_task").drop("_file", "_task")


def merge_small_files(
    spark: SparkSession, table: Table, path: str, most: int = 8, small: int = SMALL_BYTES, ledgers: Sequence[str] = ()
) -> int:
    """Merge the small files of each month that has more than ``most`` of them; gives how many files were merged.

    They become files that are no longer small, which are left alone from then
    on, and one of what remains of a month. These are laid out like any others.
    ``ledgers`` are those of the tables made from this one: only files that all
    of them hold are merged, and the merged ones are added to each, so no row is
    processed again.
    """
    finish_rewrites(spark, table, path)
    files = data_files(spark, path).where(F.col("length") < small)
    noted = [Ledger(spark, root) for root in ledgers]
    for ledger in noted:
        files = files.join(ledger.files(), "file", "left_semi")
    files = files.withColumn("month", F.substring_index("file", "/", 1))
    many = files.groupBy("month").agg(row_count().alias("n")).where(F.col("n") > most).select("month")
    found = files.join(many, "month", "left_semi").select("file", "length")
    lengths, full = {row.file: row.length for row in found.collect()}, small * FULL_SHARE
    groups = file_groups(lengths, full)
    names = [name for group in groups for name in group]
    if names:
        rewrite = new_run()
        stage(_brought_together(spark, table, path, groups, lengths, full), table, path, rewrite, by_month=True)
        merged = spark.createDataFrame([(name,) for name in staged_files(spark, path, rewrite)], "file string")
        for ledger in noted:
            ledger.add(new_run(), merged)
        take_rewrite(spark, path, rewrite, names)
    return len(names)


FILE_BYTES = 8 << 20
"""About the length of a file that the layout cuts from a large month."""
SORTED_BYTES = 32 << 20
"""Stored bytes that a task reads to sort them in memory."""
READ_BYTES = "spark.sql.files.maxPartitionBytes"


@contextmanager
def sorted_in_memory(spark: SparkSession) -> Iterator[None]:
    """Scans that are started inside read at most ``SORTED_BYTES`` in a task, if the session has no setting for it."""
    if spark.conf.get(READ_BYTES, None) is not None:
        yield
        return
    spark.conf.set(READ_BYTES, str(SORTED_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(READ_BYTES)


def read_by_month(spark: SparkSession, table: Table, path: str, lengths: Mapping[str, int]) -> DataFrame:
    """The rows of the named files, of which the lengths are given, so that a month's rows are in few tasks.

    Files are of one month each. They are read as they are, without a shuffle,
    unless a month has many small ones, which are brought together.
    """
    months = defaultdict(list)
    for name in sorted(lengths):
        months[month_folder(name)].append(name)
    whole, loose = [], []
    for names in months.values():
        few = len(names) <= max(1, sum(lengths[name] for name in names) // FILE_BYTES)
        (whole if few else loose).extend(names)
    rows = read_files(spark, table.schema, path, whole or loose)
    if not loose:
        return rows
    gathered = read_files(spark, table.schema, path, loose).withColumn(table.month_column, month_of(F.col(table.month_of)))
    gathered = gathered.hint("rebalance", F.col(table.month_column)).drop(table.month_column)
    return rows.union(gathered) if whole else gathered


def append_new(
    spark: SparkSession, table: Table, source: str, target: str, ledger_root: str, made: Callable[[DataFrame], DataFrame]
) -> set[int]:
    """Bring a derived table up to date: read the files of the source that it was not made from, append what is made of them.

    A row of the source gives rows of its own month, so they are written by the
    task that reads them. The ledger names the files read; its run is the commit: a run lost before leaves nothing, one lost after
    is finished by the next. Files of a month that the derived table lacks are
    read again. Gives the months that got rows.
    """
    ledger = Ledger(spark, ledger_root)
    finish_rewrites(spark, table, target)
    have = [name for name in list_folder(spark, target) if "=" in name]
    done = ledger.files().where(F.substring_index("file", "/", 1).isin(have))
    files = data_files(spark, source).join(done, "file", "left_anti").select("file", "length")
    lengths = {row.file: row.length for row in files.collect()}
    names = sorted(lengths)
    if names:
        run = new_run()
        with sorted_in_memory(spark):
            stage(made(read_by_month(spark, table, source, lengths)), table, target, run, by_month=True)
        write_text(spark, f"{target}/{REWRITE}{run}/{NOTED}", ledger_root)
        ledger.add(run, spark.createDataFrame([(name,) for name in names], "file string"))
        take_rewrite(spark, target, run)
    months = (month_folder(name).split("=", 1)[1] for name in names)
    return {int(month) for month in months if month.isdigit()}


VERSIONS_KEPT = 3


CLAIM = "_claim_"
"""Prefix of the file that reserves a version for one writer."""
CLAIM_HOURS = 24.0


def _claim(spark: SparkSession, root: str, version: int, hours: float) -> None:
    """Reserve a version: of several writers one gets it, the others an error.

    The file is created only if it does not exist, which the file system decides.
    A claim older than ``hours`` without a complete version is a lost writer's;
    it is renamed first, which again one of several succeeds in.
    """
    claim = f"{root}/{CLAIM}{version:012d}"
    age = age_seconds(spark, claim)
    if age is not None and age > hours * 3600:
        stale = f"{claim}_{new_run()}"
        rename_folder(spark, claim, stale)
        delete_folder(spark, stale)
    try:
        write_text(spark, claim, "")
    except Py4JJavaError as error:
        raise FileExistsError(f"version {version} of {root} is being written by another job") from error


def write_snapshot(
    df: DataFrame, table: Table, root: str, version: int, as_of: datetime | None = None, keep: int = VERSIONS_KEPT,
    claim_hours: float = CLAIM_HOURS,
) -> str:
    """Write a new version next to the old ones; readers switch when it is complete.

    A version belongs to the writer that claims it first; the claim of a lost one
    can be taken over after ``claim_hours``, and what it left half-written is
    replaced as a whole. A version that another job has completed is an error,
    never overwritten. Versions before the newest ``keep`` are removed.
    """
    path = f"{root}/version={version:012d}"
    spark = df.sparkSession
    if "_SUCCESS" in list_folder(spark, path):
        raise FileExistsError(f"{path} has been written by another job")
    _claim(spark, root, version, claim_hours)
    writer = _layout(conform(df, table, as_of), table).mode("overwrite")
    writer.option("partitionOverwriteMode", "static").parquet(path)
    for name in list_folder(spark, root):
        if name.startswith("version=") and int(name.split("=", 1)[1]) <= version - keep:
            delete_folder(spark, f"{root}/{name}")
        if name.startswith(CLAIM) and name.removeprefix(CLAIM).isdigit() and int(name.removeprefix(CLAIM)) <= version - keep:
            delete_folder(spark, f"{root}/{name}")
    return path


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest version whose write has finished."""
    done = [
        int(name.split("=", 1)[1])
        for name in list_folder(spark, root)
        if name.startswith("version=") and "_SUCCESS" in list_folder(spark, f"{root}/{name}")
    ]
    return max(done, default=None)


def read_snapshot(spark: SparkSession, table: Table, root: str) -> DataFrame:
    version = latest_version(spark, root)
    if version is None:
        raise ValueError(f"no complete version under {root}")
    return read_table(spark, table, f"{root}/version={version:012d}")


def write_report(sections: dict[str, DataFrame], root: str, as_of: datetime) -> str:
    """One JSON folder per report section under a timestamped name."""
    path = f"{root}/report_{as_of:%Y%m%d_%H%M%S}"
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    return path
