"""Run input documents: render from a template, check ranges, compare a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.polynomials import Marginal


def render_documents(
    runs: DataFrame, template: str, names: list[str], key: str = "run_id", delimiter: str = "$"
) -> DataFrame:
    """One document per run: ``${name}`` is replaced by the run's value.

    Text after a placeholder stays, so ``${x}.0e-4`` scales an integer by 1e-4. A
    placeholder that is left makes the row an error row (``unresolved`` is true).
    """
    text = F.lit(template)
    for n in names:
        text = F.replace(text, F.lit(delimiter + "{" + n + "}"), F.col(n).cast("string"))
    return runs.select(key, text.alias("document")).withColumn(
        "unresolved", F.contains("document", F.lit(delimiter + "{"))
    )


def fill_defaults(runs: DataFrame, specs: list[dict]) -> DataFrame:
    """Add or complete every parameter column from its default, in its declared type.

    ``specs`` is the small parameter table as records (name, dtype, min, max, default).
    ``violations`` lists parameters outside [min, max].
    """
    out, bad = runs, []
    for s in specs:
        kind = "long" if s["dtype"] == "integer" else "double"
        given = F.col(s["name"]) if s["name"] in runs.columns else F.lit(None)
        out = out.withColumn(s["name"], F.coalesce(given.cast("double"), F.lit(float(s["default"]))).cast(kind))
        inside = F.col(s["name"]).between(float(s["min"]), float(s["max"]))
        bad.append(F.when(~inside, F.lit(s["name"])))
    return out.withColumn("violations", F.array_compact(F.array(*bad)))


def varying_paths(entries: DataFrame) -> DataFrame:
    """Input paths with more than one value over an ensemble (path, n_values)."""
    return (
        entries.groupBy("path", "value").agg(F.count(F.lit(1)).alias("runs"))
        .groupBy("path").agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values") > 1)
    )


def sweep_difference(entries: DataFrame, key: str = "run_id") -> DataFrame:
    """(run, path, value) for the varying paths only."""
    return entries.join(varying_paths(entries).select("path"), "path", "left_semi").select(key, "path", "value")


def sweep_table(entries: DataFrame, paths: list[str], key: str = "run_id") -> DataFrame:
    """One row per run and one column per given path."""
    return entries.filter(F.col("path").isin(paths)).groupBy(key).pivot("path", paths).agg(F.first("value"))


def marginal_violations(runs: DataFrame, marginals: list[Marginal]) -> DataFrame:
    """Rows where a varied parameter leaves its sampled range."""
    outside = F.lit(False)
    for m in marginals:
        outside = outside | ~F.col(m.name).between(m.lower, m.upper)
    return runs.filter(outside)
