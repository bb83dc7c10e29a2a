"""S1, S2, S20. Read a folder of tables as text, keeping the place of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.session import settle

FORMATS = ("csv", "json", "parquet")


class LoadError(ValueError):
    """The input can not be loaded; the message says everything that is wrong."""


def _children(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """{table name: (path, format)} of the tables in a folder, on any Hadoop file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(folder)
    found = {}
    for status in files.listStatus(path):
        name = status.getPath().getName()
        stem, _, extension = name.rpartition(".")
        if extension in FORMATS:
            found[stem] = (status.getPath().toString(), extension)
    return found


def with_row_number(df: DataFrame) -> DataFrame:
    """Add `_row`, the 0-based place of each row in its table, for a file-backed read.

    Splits of a file are not processed in file order, so the place is the number of
    rows in earlier blocks plus the place within the block. The one unpartitioned
    window runs over one row per block (128 MB of input each). Its result is written,
    so the planner knows its size: below the broadcast threshold the rows of the table
    stay where they are, and beyond it both sides are shuffled.
    """
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"))
    blocks = placed.groupBy("_file", "_block").agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(blocks.select(
        "_file", "_block",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return (placed.join(offsets, ["_file", "_block"])
            .withColumn("_row", F.col("_seq") + F.col("_shift"))
            .drop("_file", "_block", "_seq", "_shift"))


def read_text_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One table, every column a string, with `_row`."""
    if fmt == "csv":
        df = spark.read.csv(path, header=True, multiLine=False, escape='"')
    elif fmt == "json":
        df = spark.read.json(path, primitivesAsString=True)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise LoadError(f"formato no soportado: '{fmt}'. Se aceptan: {', '.join(FORMATS)}")
    names = df.columns
    numbered = with_row_number(df)
    return numbered.select(
        *[F.col(f"`{n}`").cast("string").alias(n) for n in names], "_row")


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of a folder by its own name."""
    return {name: read_text_table(spark, path, fmt)
            for name, (path, fmt) in sorted(_children(spark, folder).items())}


def is_canonical(table_names) -> bool:
    """S20. All five tables are there under their exact names."""
    return set(fv.REQUIRED_TABLES) <= set(table_names)


def require_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """S1. The five required tables; one error names all the missing ones."""
    missing = [name for name in fv.REQUIRED_TABLES if name not in tables]
    if missing:
        raise LoadError(f"faltan tablas requeridas: {missing}")
    return {name: tables[name] for name in fv.REQUIRED_TABLES}


def require_columns(df: DataFrame, sheet: str) -> None:
    """S2. Required columns must exist, though a value may be null."""
    missing = [c for c in fv.REQUIRED_COLUMNS[sheet] if c not in df.columns]
    if missing:
        raise LoadError(f"tabla '{sheet}': faltan columnas {missing}")
