"""The files of a stored table: listing them, replacing exactly some of them, noting which ones were processed.

A table may be appended to at any time while one maintenance job works on it.
Such a job lists files first, reads exactly those and replaces exactly those, so
what is appended meanwhile stays. Its result is staged in a hidden folder of the
table; a manifest of the replaced files makes it final. A job that is lost before
leaves a folder that the next one removes, one that is lost after is finished by
the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REWRITE = "_rewrite_"
"""Prefix of a staging folder inside a table."""
TAKEN = "_TAKES_"
"""Marks a final rewrite: a file of this name lists the files that it replaces."""
NOTED = "_NOTED_IN_"
"""In a rewrite that a ledger makes final: a file of this name gives the ledger's folder."""


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; empty when it does not exist."""
    target, fs = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    return [entry.getPath().getName() for entry in fs.listStatus(target)]


def delete_folder(spark: SparkSession, path: str) -> None:
    target, fs = _filesystem(spark, path)
    fs.delete(target, True)


def rename_folder(spark: SparkSession, source: str, target: str) -> None:
    origin, fs = _filesystem(spark, source)
    if not fs.rename(origin, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Length of a file, or of all files below a folder."""
    target, fs = _filesystem(spark, path)
    return fs.getContentSummary(target).getLength()


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    origin, fs = _filesystem(spark, source)
    place, other = _filesystem(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, origin, other, place, False, spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an error if it exists."""
    target, fs = _filesystem(spark, path)
    out = fs.create(target, False)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _filesystem(spark, path)
    source = fs.open(target)
    text = bytes(source.readAllBytes()).decode()
    source.close()
    return text


def age_seconds(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written, by this machine's clock; ``None`` if it does not exist."""
    target, fs = _filesystem(spark, path)
    if not fs.exists(target):
        return None
    return (spark._jvm.System.currentTimeMillis() - fs.getFileStatus(target).getModificationTime()) / 1000


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, length`` of the data files in the month folders of a table; names are relative to ``path``.

    Spark lists the folders in parallel, as it does before it reads the table;
    no file is opened.
    """
    if not any("=" in name for name in list_folder(spark, path)):
        return spark.createDataFrame([], "file string, length long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.substring_index("path", "/", -2).alias("file"), "length")


def month_folder(file: str) -> str:
    return file.split("/", 1)[0]


def read_files(spark: SparkSession, schema: T.StructType, path: str, files: Sequence[str]) -> DataFrame:
    """The rows of exactly the named files of a table."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{name}" for name in files))


def staged_files(spark: SparkSession, path: str, rewrite: str) -> list[str]:
    """The data files of a staging folder, under the names that they will have in the table."""
    staged = f"{path}/{REWRITE}{rewrite}"
    folders = [name for name in list_folder(spark, staged) if "=" in name]
    return [f"{f}/{name}" for f in folders for name in list_folder(spark, f"{staged}/{f}") if name.startswith("part-")]


def take_rewrite(spark: SparkSession, path: str, rewrite: str, replaced: Sequence[str] = (), folder: str = "") -> None:
    """Make a staged rewrite final: its files enter the table, the ``replaced`` ones leave it.

    The list of the replaced files is kept in the rewrite until all is done. A
    rewrite of one month may hold its files directly; they belong to ``folder``
    then, as do listed names without a folder.
    """
    staged = f"{path}/{REWRITE}{rewrite}"
    if TAKEN not in list_folder(spark, staged):
        write_text(spark, f"{staged}/{TAKEN}", "\n".join(replaced))
    held = staged_files(spark, path, rewrite)
    held += [name for name in list_folder(spark, staged) if name.startswith("part-")]
    for target in {month_folder(name) if "/" in name else folder for name in held}:
        place, fs = _filesystem(spark, f"{path}/{target}")
        fs.mkdirs(place)
    for name in held:
        rename_folder(spark, f"{staged}/{name}", f"{path}/{name}" if "/" in name else f"{path}/{folder}/{name}")
    for name in read_text(spark, f"{staged}/{TAKEN}").split("\n"):
        if name:
            delete_folder(spark, f"{path}/{name}" if "/" in name else f"{path}/{folder}/{name}")
    delete_folder(spark, staged)


class Ledger:
    """Which files of a source a derived table was made from: one small Parquet folder for each run.

    A run counts from the moment its write has finished.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def runs(self) -> list[str]:
        names = [name for name in list_folder(self.spark, self.root) if name.startswith("run-")]
        return [name for name in names if "_SUCCESS" in list_folder(self.spark, f"{self.root}/{name}")]

    def files(self) -> DataFrame:
        runs = [f"{self.root}/{name}" for name in self.runs()]
        if not runs:
            return self.spark.createDataFrame([], "file string")
        return self.spark.read.schema("file string").parquet(*runs).distinct()

    def holds(self, run: str) -> bool:
        return "_SUCCESS" in list_folder(self.spark, f"{self.root}/run-{run}")

    def add(self, run: str, files: DataFrame) -> None:
        files.select("file").write.mode("overwrite").parquet(f"{self.root}/run-{run}")


def new_run() -> str:
    return uuid.uuid4().hex
