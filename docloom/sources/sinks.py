"""Writing: partitioned tables through Spark's committer, small result bundles and report sections from the driver."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_source(rows: DataFrame, path: str, *, format: str = "json", mode: str = "overwrite") -> None:  # noqa: A002
    """Rows below <jurisdiction>/<issuing_body>; Spark's commit makes the write atomic, readers prune by both."""
    rows.write.mode(mode).partitionBy("jurisdiction", "issuing_body").format(format).save(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with header, for small summaries."""
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.coalesce(1).write.mode("overwrite").options(**kept).csv(path)


def not_yet_written(rows: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in no output yet."""
    return rows.join(written.select(*keys).distinct(), keys, "left_anti")


def release_path(tier: str, collection: str, filename: str) -> F.Column:
    """A repository-relative path by tier; unknown tiers go to 'other'."""
    names = F.create_map(*(F.lit(x) for pair in (("tier 1", "tier1_redistributable"), ("tier 2", "tier2_attribution"), ("tier 3", "tier3_fetch")) for x in pair))
    return F.concat_ws("/", F.lit("data/corpus"), F.coalesce(names[F.lower(F.trim(tier))], F.lit("other")), collection, filename)


def bundle_dir(base: str, model: str, split: str, now: datetime | None = None) -> Path:
    """<base>/<model>/<split>_<UTC time>; slashes and blanks of the model's name become underscores."""
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")
    return Path(base) / re.sub(r"[/ ]", "_", model) / f"{split}_{stamp}"


def write_bundle(directory: Path, tables: dict[str, DataFrame], config: dict) -> None:
    """Aggregated results (a few rows each) as JSON files, and the configuration; for per-row results use a Spark sink."""
    directory.mkdir(parents=True, exist_ok=True)
    for name, table in tables.items():
        rows = [r.asDict(recursive=True) for r in table.toLocalIterator()]
        partial = directory / f"{name}.json.tmp"
        partial.write_text(json.dumps(rows, ensure_ascii=False, indent=1, default=str))
        partial.rename(directory / f"{name}.json")
    (directory / "config.json").write_text(json.dumps(config, ensure_ascii=False, sort_keys=True, indent=1, default=str))


def store_fetched(results: DataFrame, path: str) -> None:
    """Fetched contents below <path>/contents by status, so that those with another hash than asked for lie apart from the
    good ones; all outcomes without contents as JSON lines below <path>/log."""
    results.where(F.col("content").isNotNull()).write.mode("overwrite").partitionBy("status").parquet(f"{path}/contents")
    results.drop("content").write.mode("overwrite").json(f"{path}/log")


def append_training_log(epochs: DataFrame, path: str) -> None:
    """Epochs' losses and scores as further JSON lines of a log; drawing them is left to the reader."""
    epochs.write.mode("append").json(path)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "(none)\n"
    head = list(rows[0])
    lines = [head, ["---"] * len(head), *([("—" if r[h] is None else f"{r[h]:.4f}" if isinstance(r[h], float) else str(r[h])) for h in head] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def upsert_section(report: str, marker: str, section: str) -> str:
    """The report up to the marker, then the marker and the new section; without marker it is appended."""
    kept = report.split(marker, 1)[0].rstrip()
    return f"{kept}\n\n{marker}\n{section}" if kept else f"{marker}\n{section}"
