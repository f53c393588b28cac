"""Small results beside the tables: JSON and CSV artifacts with dated copies, a bounded history, feature lineage.

These are a few kilobytes of the driver's own; data goes through Spark's writers.
"""

from __future__ import annotations

import json
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions import features as fx
from ..functions.dialect import SPARK


def keep_copy(folder: str, now: datetime) -> Path | None:
    """Copies what is in the folder beside it under the date; None if there is nothing."""
    source = Path(folder)
    if not source.is_dir() or not any(source.iterdir()):
        return None
    return Path(shutil.copytree(source, source.with_name(f"{source.name}-{now:%Y%m%d-%H%M%S}")))


def save(folder: str, name: str, value: object) -> None:
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(value, indent=1, sort_keys=True, default=str))


def save_table(folder: str, name: str, rows: DataFrame) -> None:
    rows.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def history(folder: str) -> list[dict]:
    """The runs so far; a missing or broken file counts as none."""
    try:
        found = json.loads((Path(folder) / "history.json").read_text())
    except (OSError, ValueError):
        return []
    return found if isinstance(found, list) else []


def remember(folder: str, run: dict, keep: int = 200) -> list[dict]:
    """Adds a run and keeps the last ones."""
    runs = [*history(folder), run][-keep:]
    save(folder, "history", runs)
    return runs


def lineage(names: list[str]) -> dict[str, dict[str, str]]:
    """Block and expression of each feature; unknown names raise."""
    if bad := set(names) - set(fx.NAMES):
        raise ValueError(f"unknown features: {', '.join(sorted(bad))}")
    found: dict[str, str] = {}
    for level in (*fx.main_before(SPARK), *fx.main_after(SPARK, "benchmark"), *fx.htf_after(SPARK), *fx.interactions(SPARK)):
        found.update(level)
    return {n: {"block": fx.BLOCK_OF[n], "expression": found.get(f"raw_{n}", found[n])} for n in sorted(names)}
