"""Parameter tables: what may vary, over which range, with which default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.polynomials import Marginal

MAX_PARAMETERS = 10_000


def parameter_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Build the table from plain records; bounds may be quoted strings."""
    text = [{k: (v if isinstance(v, bool) or v is None else str(v)) for k, v in r.items()} for r in rows]
    names = schemas.PARAMETERS.fieldNames()
    return typed(spark.createDataFrame([tuple(r.get(n) for n in names) for r in text], schemas.PARAMETERS))


def read_parameters(spark: SparkSession, path) -> DataFrame:
    return typed(spark.read.schema(schemas.PARAMETERS).json(path))


def typed(raw: DataFrame) -> DataFrame:
    """Bounds as doubles; rows that cannot be read raise instead of becoming null."""
    out = raw
    for c in ("min", "max", "default", "lower", "upper"):
        out = out.withColumn(c, F.col(c).cast("double"))
    return out.withColumn("selected", F.coalesce("selected", F.lit(False)))


def selected(table: DataFrame) -> DataFrame:
    return table.filter("selected")


def marginals(table: DataFrame) -> list[Marginal]:
    """The varied parameters on the driver: one record per parameter, size checked."""
    rows = selected(table).select("name", "lower", "upper", "dist").orderBy("name").take(MAX_PARAMETERS + 1)
    if len(rows) > MAX_PARAMETERS:
        raise ValueError("more parameters than a design can vary")
    return [Marginal(r["name"], r["lower"], r["upper"], r["dist"]) for r in rows]
