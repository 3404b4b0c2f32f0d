"""Query sets and settings from files, and results to files."""

from __future__ import annotations

import argparse
import json
import os
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_FIELDS = {
    "query_id": None, "query_text": None, "target_entity_id": None, "category": "curated", "target_entity_name": None, "expected_behavior": "latest_snapshot",
    "commit_after": "", "file_path": "", "entity_type": "unknown", "query_source": "curated",
}


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query cases of a JSON array or a CSV file with a header: unknown keys are ignored, missing ones get their defaults.

    Rows without an id, text or target are dropped. White space of texts is collapsed.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"') if path.endswith(".csv") else spark.read.json(path, multiLine=True)

    def field(name: str):
        default = F.col("target_entity_id").cast("string") if name == "target_entity_name" else F.lit(QUERY_FIELDS[name])
        return (F.coalesce(F.col(name).cast("string"), default) if name in raw.columns else default).alias(name)

    x = raw.select(*[field(n) for n in QUERY_FIELDS])
    return x.withColumn("query_text", F.trim(F.regexp_replace("query_text", r"\s+", " "))).withColumn("query_source", F.lit("curated")).where("query_id is not null and query_text <> '' and target_entity_id is not null")


def read_settings(text: str, defaults: dict, explicit: dict | None = None) -> dict:
    """Settings of JSON with // and /* */ comments over defaults; explicit ones win; unknown keys are warned about."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    given = json.loads(bare or "{}")
    for k in given.keys() - defaults.keys():
        warnings.warn(f"unknown setting {k}", stacklevel=2)
    return defaults | {k: v for k, v in given.items() if k in defaults} | (explicit or {})


def number_list(text: str) -> list[int]:
    """"1,5,10" as sorted distinct numbers."""
    return sorted({int(x) for x in text.split(",") if x.strip()})


def name_list(text: str, default: str = "changed_only") -> list[str]:
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip())) or [default]


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per line."""
    results.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table of a small aggregate."""
    got = rows.limit(most).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got)])


#: Settings of a benchmark run and their defaults; fixed values.
BENCHMARK = {
    "repo_url": None, "repo_path": None, "num_commits": 10, "stride": 1, "offset": 0, "windows": 1, "strategies": ["changed_only"], "top_k": [1, 5, 10], "hop_k": 2, "query_mode": "hybrid", "curated_queries": None,
    "max_queries_per_entity": 2, "seed": 42, "version": "1", "threshold": None, "model_path": None, "output_dir": None, "sampling_mode": "adjacent", "contextual": True,
}
MODES = {"query_mode": ("curated", "synthetic", "hybrid"), "sampling_mode": ("adjacent", "stride")}


def arguments(defaults: dict, argv: list[str]) -> dict:
    """--name value (and --flag, --no-flag) as settings: only those that were given, by the types of the defaults."""
    p = argparse.ArgumentParser(argument_default=argparse.SUPPRESS)
    p.add_argument("--config")
    for k, v in defaults.items():
        name = "--" + k.replace("_", "-")
        if isinstance(v, bool):
            p.add_argument(name, action=argparse.BooleanOptionalAction)
        else:
            kind = number_list if isinstance(v, list) and v and isinstance(v[0], int) else name_list if isinstance(v, list) else type(v) if v is not None else str
            p.add_argument(name, type=kind, choices=MODES.get(k))
    return vars(p.parse_args(argv))


def discovered(folder: str, names: tuple[str, ...] = ("settings.json", "benchmark_settings.json")) -> str | None:
    """The first settings file of a folder, or of its folder configs."""
    return next((p for d in (folder, os.path.join(folder, "configs")) for n in names if os.path.isfile(p := os.path.join(d, n))), None)


def run_settings(argv: list[str], defaults: dict | None = None, folder: str = ".", known: tuple[str, ...] | None = None) -> dict:
    """Settings of a run: what the command line names, over a file (--config, else one that is found), over the defaults.

    A missing repository, an unknown mode and an unknown strategy are errors, wherever they were set."""
    defaults = defaults or BENCHMARK
    given = arguments(defaults, argv)
    at = given.pop("config", None) or discovered(folder)
    text = "{}"
    if at:
        with open(at, encoding="utf-8") as f:
            text = f.read()
    out = read_settings(text, defaults, given)
    for k, v in MODES.items():
        if k in out and out[k] not in v:
            raise ValueError(f"{k} must be one of {', '.join(v)}")
    if "repo_url" in out and not (out["repo_url"] or out.get("repo_path")):
        raise ValueError("repo_url or repo_path is needed")
    if known is not None and (odd := [s for s in out.get("strategies", []) if s not in known]):
        raise ValueError(f"unknown strategies: {', '.join(odd)}")
    return out


def windows(settings: dict) -> list[dict]:
    """Settings of each window of a run of several: as many commits each, one behind the other, at offsets that don't overlap."""
    step = settings["num_commits"] * settings["stride"]
    return [settings | {"offset": settings["offset"] + i * step, "windows": 1} for i in range(settings["windows"])]


def hybrid_cases(spark: SparkSession, path: str | None) -> DataFrame:
    """read_queries of a path; without one, or where nothing is there, no cases and a warning."""
    if path and os.path.exists(path):
        return read_queries(spark, path)
    warnings.warn(f"no query set at {path}", stacklevel=2)
    return spark.createDataFrame([], ", ".join(f"{k} string" for k in QUERY_FIELDS))
