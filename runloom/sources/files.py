"""Readers of campaign files. Every reader returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

# Fixed value: the column Spark offers for the file of a row.
PATH = "_metadata.file_path"
# Lines that meet in one group of a long file.
PIECE_LINES = 100_000
# Tables with a few rows a file are sent to all tasks where there are at most so many files.
FEW_FILES = 10_000


def from_path(pattern: str, group: int = 1) -> Column:
    """Integer taken from the file path by a regular expression."""
    return F.regexp_extract(F.col(PATH), pattern, group).cast("long")


def _csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with header; a missing or misplaced column is an error, not a silent null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _with_run(df: DataFrame, run_pattern: str | None) -> DataFrame:
    return df if run_pattern is None else df.withColumn("run_id", from_path(run_pattern))


def boundary_force(spark: SparkSession, path, run_pattern: str | None = None) -> DataFrame:
    return _with_run(_csv(spark, path, schemas.BOUNDARY_FORCE), run_pattern)


def macro_history(spark: SparkSession, path, run_pattern: str | None = None) -> DataFrame:
    return _with_run(_csv(spark, path, schemas.MACRO_HISTORY), run_pattern)


def nano_history(
    spark: SparkSession,
    path,
    run_pattern: str | None = None,
    point_pattern: str = r"qpid(\d+)_repl(\d+)",
) -> DataFrame:
    """All per-point files in one scan; point and replica come from the file name."""
    df = _csv(spark, path, schemas.NANO_HISTORY)
    df = df.withColumn("qpid", from_path(point_pattern, 1)).withColumn("repl", from_path(point_pattern, 2))
    return _with_run(df, run_pattern)


def strain_histories(
    spark: SparkSession, path, name_filter: str | None = "strain_*", id_pattern: str = r"strain_(\d+)[^/]*$"
) -> DataFrame:
    """Files named ``strain_<id>``: (cell, step, six components), step = line number.

    All other files are ignored. Lines are whitespace separated.
    """
    lines = numbered_lines(spark, path, name_filter)
    tokens = F.split(F.trim("line"), r"\s+")
    cell = F.regexp_extract("file", id_pattern, 1).cast("long")
    return (
        lines.filter(F.trim("line") != "")
        .select(cell.alias("cell"), F.col("line_no").alias("step"), tokens.alias("t"))
        .select(
            "cell", "step",
            *[F.element_at("t", i + 1).cast("double").alias(n) for i, n in enumerate(schemas.STRAIN)],
        )
    )


def similarity_edges(spark: SparkSession, path, name_filter: str = "last.*.similar_hist") -> DataFrame:
    """Union of all edge files: ``cell1 cell2 dist`` per line, plus the file it came from."""
    t = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.option("pathGlobFilter", name_filter).text(path)
        .withColumn("file", F.col(PATH))
        .filter(F.trim("value") != "")
        .select(
            t.getItem(0).cast("long").alias("cell1"),
            t.getItem(1).cast("long").alias("cell2"),
            t.getItem(2).cast("double").alias("dist"),
            "file",
        )
    )


def _sent(table: DataFrame, lines: DataFrame) -> DataFrame:
    # Counted without moving the names to Python.
    return F.broadcast(table) if len(lines._jdf.inputFiles()) <= FEW_FILES else table


def numbered_lines(spark: SparkSession, path, path_filter: str | None = None) -> DataFrame:
    """Text lines with their 0-based number in the file: (file, file_no, split, line_no, line).

    A big file is read in splits. Lines are numbered inside a split and shifted by the
    line counts of earlier splits, so no task ever needs the whole file. ``file_no`` is a number
    that no other file of the table has. Where the number of
    executors changes while a query runs, set ``spark.sql.files.minPartitionNum``, so that
    every scan of a file is cut alike.
    """
    reader = spark.read if path_filter is None else spark.read.option("pathGlobFilter", path_filter)
    lines = reader.text(path).select(
        F.col(PATH).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_m"),
        F.col("value").alias("line"),
    )
    # Rows of a split are consecutive in one task, so the id minus the least id of the
    # split is the line number in the split.
    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    whole = Window.partitionBy("file")
    earlier = whole.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "file", "split", F.min("_first").over(whole).alias("file_no"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return lines.join(_sent(shifts, lines), ["file", "split"]).select(
        "file", "file_no", "split", (F.col("_m") + F.col("_shift")).alias("line_no"), "line"
    )


def block_rows(lines: DataFrame, start: str = "Step", stop: str = "Loop") -> DataFrame:
    """Lines between a ``start`` header line and the next ``stop``, for every such block.

    Input: ``numbered_lines``. Output: (file, block, row, tokens); empty lines are
    dropped, and so is a last block that no ``stop`` closes. The state at a line is the last marker before it: found
    inside a piece of so many lines first, then carried from the nearest earlier piece that has a marker. Lines move
    once, by their piece and with the number of their file, since its name may be longer than they are.
    """
    names = _sent(lines.select("file", "file_no").distinct(), lines)
    is_stop, is_start = F.col("line").contains(stop), F.col("line").contains(start)
    mark = F.when(is_start, F.lit("in")).when(is_stop, F.lit("out"))
    piece = F.floor(F.col("line_no") / F.lit(float(PIECE_LINES))).alias("piece")
    at = ["file_no", "piece"]
    marked = lines.select("file_no", piece, "line_no", "line").withColumn("_mark", mark)
    by_line = Window.partitionBy(*at).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = marked.groupBy(*at).agg(
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("line_no"))).alias("_last")
    )
    by_piece = Window.partitionBy("file_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    entering = pieces.withColumn("_carry", F.last("_last", ignorenulls=True).over(by_piece)).drop("_last")
    stated = (
        marked.withColumn("_before", F.last("_mark", ignorenulls=True).over(by_line))
        .join(_sent(entering, lines), at)
        .withColumn("_state", F.coalesce("_before", "_carry", F.lit("out")))
        .withColumn("_header", (F.col("_state") == "out") & is_start)
        .withColumn("_inside", F.col("_state") == "in")
    )
    body = F.when(is_stop, F.substring_index("line", stop, 1)).otherwise(F.col("line"))
    stated = stated.withColumn("_data", F.col("_inside") & (F.trim(body) != "")).withColumn("_body", F.trim(body))
    heads = stated.groupBy(*at).agg(F.count_if("_header").alias("_h"))
    head_shift = heads.withColumn("_hb", F.coalesce(F.sum("_h").over(by_piece), F.lit(0))).drop("_h")
    upto = Window.partitionBy(*at).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        stated.withColumn("_heads", F.count_if("_header").over(upto)).join(_sent(head_shift, lines), at)
        .withColumn("block", F.col("_hb") + F.col("_heads") - 1)
    )
    # A block begins only after a stop, so all blocks up to the last closed one are closed.
    closed = numbered.filter(is_stop & F.col("_inside")).groupBy("file_no").agg(F.max("block").alias("_closed"))
    data = numbered.filter("_data").join(_sent(closed, lines), "file_no").filter(F.col("block") <= F.col("_closed"))
    # A row number inside a block: lines are numbered, so count data rows per (block, piece). Only the
    # first block of a piece may have rows before it.
    part = data.groupBy("file_no", "block", "piece").agg(F.count(F.lit(1)).alias("_n"))
    in_block = Window.partitionBy("file_no", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_rb", F.sum("_n").over(in_block)).drop("_n").filter("_rb > 0")
    in_part = Window.partitionBy("file_no", "block", "piece").orderBy("line_no")
    placed = data.withColumn("_row", F.row_number().over(in_part) - 1).join(
        _sent(part, lines), ["file_no", "block", "piece"], "left")
    return placed.join(names, "file_no").select(
        "file",
        F.col("block").cast("long").alias("block"),
        (F.coalesce("_rb", F.lit(0)) + F.col("_row")).cast("long").alias("row"),
        F.split("_body", r"\s+").alias("tokens"),
    )


def thermo_log(spark: SparkSession, path) -> DataFrame:
    return block_rows(numbered_lines(spark, path))


def run_inputs(spark: SparkSession, path, schema: T.StructType | None = None,
               run_pattern: str = r"/([^/]+)/[^/]+\.json$") -> DataFrame:
    """One nested JSON document per run directory, flattened to (run_id, path, value).

    Without ``schema`` the documents are read once more to infer it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    docs = reader.option("multiLine", True).json(path)
    return flatten_documents(docs.withColumn("run_id", F.regexp_extract(F.col(PATH), run_pattern, 1)), "run_id")


def leaf_paths(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    out = []
    for f in schema.fields:
        here = (*prefix, f.name)
        out += leaf_paths(f.dataType, here) if isinstance(f.dataType, T.StructType) else [(here, f.dataType)]
    return out


def flatten_documents(docs: DataFrame, key: str) -> DataFrame:
    """Nested struct columns to long rows (key, path, value); arrays become JSON text."""
    entries = []
    for names, dtype in leaf_paths(T.StructType([f for f in docs.schema.fields if f.name != key])):
        column = F.col(".".join(f"`{n}`" for n in names))
        text = F.to_json(column) if isinstance(dtype, (T.ArrayType, T.MapType)) else column.cast("string")
        entries.append(F.struct(F.lit("/".join(names)).alias("path"), text.alias("value")))
    return docs.select(key, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
