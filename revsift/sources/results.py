"""Results to files: a run's tables, reports, and caches of what is dear to compute."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revsift.sources.settings import markdown

#: Strategies in the order of reports; others follow by name. Fixed values.
ORDER = ["full_reindex", "changed_only", "fixed_hop", "predictive_ml", "pagerank", "bfs_decay"]


def output_dir(base: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{run_id}"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, through the file system of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json.dumps(value, indent=2, sort_keys=True, default=str), path)


def persist_run(spark: SparkSession, path: str, settings: dict, pairs: DataFrame, queries: DataFrame, per_query: DataFrame, summary: DataFrame, comparisons: DataFrame) -> None:
    """A run's folder: settings and the summary as JSON, each table as JSON lines, written by the tasks that hold them."""
    write_json(spark, settings, f"{path}/benchmark_config.json")
    for name, t in (("commit_pairs", pairs), ("queries", queries), ("per_query_results", per_query), ("embedding_comparisons", comparisons)):
        t.write.mode("overwrite").json(f"{path}/{name}")
    write_json(spark, {r["strategy_name"]: r.asDict() for r in summary.collect()}, f"{path}/summary_metrics.json")  # a row for each strategy


def _ordered(rows: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("strategy_name"))
    return rows.orderBy(F.when(place == 0, len(ORDER) + 1).otherwise(place), "strategy_name")


def staleness_section(losses: DataFrame) -> str:
    """What each strategy loses against the full re-index, by k."""
    x = losses.select("strategy_name", "k", "baseline_hits", "lost", "gained", "loss_rate", "loss_low", "loss_high", "retention")
    return "## Hits lost against the full re-index\n\n" + markdown(_ordered(x).orderBy("strategy_name", "k"))


def summary_report(settings: dict, summary: DataFrame, losses: DataFrame | None = None, saturation: DataFrame | None = None, frontier: DataFrame | None = None) -> str:
    """A run's report: settings, strategies, losses, the frontier, and a warning where strategies can't be told apart."""
    parts = ["# Benchmark", "\n".join(f"- {k}: {v}" for k, v in sorted(settings.items())), "## Strategies", markdown(_ordered(summary))]
    if saturation is not None and (r := saturation.first())["saturated"]:
        parts.insert(1, f"**Saturated**: costs differ by {r['update_spread']:.1%}, yet no strategy measurably loses hits (at most {r['strongest_loss']:.2%}).")
    if losses is not None:
        parts.append(staleness_section(losses))
    if frontier is not None:
        parts += ["## Frontier", ", ".join(r["strategy_name"] for r in frontier.where("on_frontier").select("strategy_name").orderBy("strategy_name").collect())]  # strategies
    return "\n\n".join(parts) + "\n"


def aggregated_report(runs: DataFrame) -> str:
    """Means and deviations over several runs."""
    return "# Runs together\n\n" + markdown(_ordered(runs)) + "\n"


def write_coverage(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Coverage of each pair as JSON lines and over all pairs as one file."""
    rows.write.mode("overwrite").json(f"{path}/coverage_rows")
    write_json(rows.sparkSession, {r["strategy_name"]: r.asDict() for r in summary.collect()}, f"{path}/coverage_summary.json")  # a row for each strategy


def cache_key(about: dict) -> str:
    """The same settings have the same key, in whatever order."""
    return hashlib.sha1(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(df_of, spark: SparkSession, base: str, about: dict) -> DataFrame:
    """A table that is computed once for the settings `about` and read from then on; `about` is kept beside it."""
    path = f"{base.rstrip('/')}/{cache_key(about)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df_of().write.mode("overwrite").parquet(f"{path}/rows")
        write_json(spark, about, f"{path}/about.json")
    return spark.read.parquet(f"{path}/rows")


def diagnostic(entities: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(commit_hash, entities, calls, changed): what was found at each commit."""
    e = entities.groupBy("commit_hash").agg(F.count("*").alias("entities"))
    c = edges.groupBy("commit_hash").agg(F.count("*").alias("calls"))
    m = changed.groupBy(F.col("commit_after").alias("commit_hash")).agg(F.count("*").alias("changed"))
    return e.join(c, "commit_hash", "left").join(m, "commit_hash", "left").fillna(0, ["calls", "changed"])
