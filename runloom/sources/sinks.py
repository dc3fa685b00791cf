"""Writers of campaign results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Header and the selected columns."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_campaign(df: DataFrame, path: str, campaign: str = "campaign") -> None:
    """Replace only the campaigns present in ``df``; others in the store stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(campaign).parquet(path)
    )


def write_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per analysis result (moments, indices, sensitivities)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_mapping(mapping: DataFrame, path: str) -> None:
    """``point representative`` per line."""
    mapping.select(F.concat_ws(" ", F.col("gp"), F.col("rep")).alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """``cell1 cell2 dist`` per line."""
    edges.select(F.concat_ws(" ", "cell1", "cell2", "dist").alias("value")).write.mode("overwrite").text(path)


def write_files(lines: DataFrame, path: str, name: str, line: str, order: list[str], header: str | None = None) -> None:
    """A text file for each ``name`` below ``path``: the header, then its lines in order; a null line is empty.

    Made for very many files: each is one request to the store, where Spark's partitioned writer makes a folder,
    a file, its checksum and their moves. Rows of a file are sorted by Spark and streamed by one task, which
    overwrites what an earlier attempt left of it. ``path`` must be a folder that ``pyarrow.fs`` can open from all
    executors; a null name is an error.
    """
    first = b"" if header is None else header.encode() + b"\n"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        current, out = None, None
        try:
            for batch in batches:
                # Consecutive rows of a name are consecutive bytes of the column.
                runs = pc.run_end_encode(batch.column("name"))
                column = batch.column("line").cast(pa.large_binary())
                _, bounds, data = column.buffers()
                bounds = pa.Array.from_buffers(pa.int64(), len(column) + 1, [None, bounds], offset=column.offset)
                begin = 0
                for label, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if label != current:
                        if out is not None:
                            out.close()
                        current, out = label, store.open_output_stream(f"{base}/{label}", compression=None)
                        out.write(first)
                    a, b = bounds[begin].as_py(), bounds[end].as_py()
                    out.write(data.slice(a, b - a))
                    begin = end
                yield batch.slice(0, 0).select(["name"])
        finally:
            if out is not None:
                out.close()

    named = F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit("a row has no file name")))
    rows = lines.select(
        named.alias("name"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.concat(F.coalesce(F.col(line), F.lit("")), F.lit("\n")).alias("line"),
    )
    dealt = rows.repartition("name").sortWithinPartitions("name", *[f"_o{i}" for i in range(len(order))])
    dealt.select("name", "line").mapInArrow(work, "name string").write.format("noop").mode("overwrite").save()
