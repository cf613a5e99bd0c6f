"""The register of workspaces: names, removal, provider settings and retries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attempts of a call and the first pause, doubled each time; statuses worth another attempt.
ATTEMPTS, PAUSE = 3, 1.0
RETRIED = re.compile(r"\b(408|409|425|429|5\d\d)\b|timed? ?out|temporar|connection (reset|refused|aborted)|rate limit", re.I)


def free_name(slug: str, name: str, taken_ids: set[str], taken_names: set[str]) -> tuple[str, str]:
    """slug and name with the first number that leaves both free: 'x-2' and 'X (2)'."""
    n, i, label = 1, slug, name
    while i in taken_ids or label in taken_names:
        n += 1
        i, label = f"{slug}-{n}", f"{name} ({n})"
    return i, label


def register(workspaces: DataFrame, workspace_id: str, name: str, root_path: str) -> DataFrame:
    """workspaces with one more row; a root that is registered already changes nothing."""
    near = workspaces.filter(F.col("workspace_id").startswith(workspace_id) | F.col("name").startswith(name) | (F.col("root_path") == root_path)).select("workspace_id", "name", "root_path").collect()
    if any(r["root_path"] == root_path for r in near):
        return workspaces
    i, label = free_name(workspace_id, name, {r["workspace_id"] for r in near}, {r["name"] for r in near})
    row = workspaces.sparkSession.createDataFrame([(i, label, root_path)], "workspace_id string, name string, root_path string")
    return workspaces.unionByName(row, allowMissingColumns=True)


@dataclass
class Removal:
    """What a removal did: the folder deleted or confirmed missing, and whether the register was changed."""

    deleted: bool
    missing: bool
    unregistered: bool
    error: str | None = None


def remove(spark: SparkSession, workspaces: DataFrame, workspace_id: str, folder: str) -> tuple[DataFrame, Removal]:
    """Deletes a workspace's data folder, then its row; the row stays if the folder could not be deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    deleted, missing, error = False, False, None
    try:
        missing = not fs.exists(path)
        deleted = not missing and bool(fs.delete(path, True))
    except Exception as e:
        error = str(e)
    good = deleted or missing
    return (workspaces.filter(F.col("workspace_id") != workspace_id) if good else workspaces), Removal(deleted, missing, good, error)


def resolve(stored: dict[str, str], environment: dict[str, str], defaults: dict[str, str]) -> dict[str, str]:
    """Settings by precedence: stored, then environment, then default; empty text counts as unset."""
    return {k: stored.get(k) or environment.get(k) or v for k, v in defaults.items()}


def retried(call: Callable[[], object], attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after a pause for errors worth it; the last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1 or not RETRIED.search(str(e)):
                raise
            sleep(pause * 2**n)
    return None
