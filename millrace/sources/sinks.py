"""Writers: guarded CSV, zstd Parquet, JSON without NaN, replace and owner deletes."""

from __future__ import annotations

import csv
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import guard_formula

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def guarded(df: DataFrame, numbers_exempt: bool = True) -> DataFrame:
    """Text cells that a spreadsheet would run get an apostrophe; numbers only without the exemption."""
    return df.select(*[F.col(c) if numbers_exempt and (t in NUMBERS or t.startswith("decimal")) else guard_formula(F.col(c)).alias(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, guard: bool = True, numbers_exempt: bool = True) -> None:
    """Distributed CSV, every cell quoted, CRLF line ends."""
    (guarded(df, numbers_exempt) if guard else df).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n")


def export_csv(df: DataFrame, target: str, guard: bool = True, numbers_exempt: bool = True) -> None:
    """One file with a byte-order mark, for a person's spreadsheet; rows stream through the driver one partition at a time."""
    rows = guarded(df, numbers_exempt) if guard else df
    with open(target, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\r\n")
        out.writerow(rows.columns)
        for r in rows.toLocalIterator():
            out.writerow(["" if x is None else x for x in r])


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_json(df: DataFrame, path: str) -> None:
    finite_or_null(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


#: A table folder holds versions and a pointer file with the name of the current one.
POINTER, VERSIONS = "_current", "_versions"


def _files(spark: SparkSession, path: str):
    """Hadoop's file context and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else hadoop.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()), hadoop.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None if the table was never written by ``replace_table``."""
    files, at = _files(spark, path)
    pointer = at(f"{path}/{POINTER}")
    if not files.util().exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path}/{VERSIONS}/{name}"


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The current version of a table, or the plain Parquet files of a folder without versions.

    The version is chosen once: the reader sees that one whole, whatever is written meanwhile.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(current_version(spark, path) or path)


def replace_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write a new version, then point to it; returns its folder.

    The pointer is a small file that is replaced by one rename, so that a reader at any time finds the old
    version or the new one, each whole, and a writer that dies leaves the old one in place. ``keep`` versions stay
    for readers that have begun; older ones, and those of writers that died before, go.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{VERSIONS}/{name}")
    _point(spark, path, name)
    files, at = _files(spark, path)
    for x in files.util().listStatus(at(path)):  # plain files from before the first version would be read beside it
        if not x.getPath().getName().startswith("_"):
            files.delete(x.getPath(), True)
    listing = files.util().listStatus(at(f"{path}/{VERSIONS}"))
    found = sorted(x.getPath().getName() for x in listing)
    for old in [n for n in found if n < name][: -(keep - 1) or None]:
        files.delete(at(f"{path}/{VERSIONS}/{old}"), True)
    return f"{path}/{VERSIONS}/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    files, at = _files(spark, path)
    jvm, beside = spark._jvm, at(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    stream = files.create(beside, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    stream.write(bytearray(name, "utf-8"))
    stream.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, at(f"{path}/{POINTER}"), how)


def create_view(df: DataFrame, name: str, keep: bool = False) -> None:
    """A view or, with ``keep``, a table that later queries scan."""
    df.write.mode("overwrite").saveAsTable(name) if keep else df.createOrReplaceTempView(name)


def delete_owned(spark, path: str, owner: str, key: str | None = None, column: str = "user_id", id_column: str = "id") -> None:
    """Rewrite a table without an owner's rows, or without one of them."""
    df = read_table(spark, path)
    mine = F.col(column) == owner
    gone = mine if key is None else mine & (F.col(id_column) == key)
    replace_table(df.filter(~F.coalesce(gone, F.lit(False))), path)


def insert_rows(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append to the current version, or to a folder without versions."""
    (check(df) if check else df).write.mode("append").option("compression", "zstd").parquet(current_version(df.sparkSession, path) or path)
