"""Outputs that are replaced whole.

Every write goes to a fresh folder of the output. One small file, the pointer, names the folder and what it was made
from, and is replaced in one step once the folder is complete. Readers follow the pointer, so they see the old
output or the new one and never a part of either; a write that fails changes nothing for them. Folders that neither
the pointer nor the one before it names are deleted with the next write, so a reader that has followed
the last pointer can still finish. An output has one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from scangraph.storage import delete_path, list_names, path_exists, read_text, replace_text

POINTER = "CURRENT.json"
_PREFIX = "snapshot-"


def read_pointer(spark: SparkSession, directory: str) -> dict | None:
    """What the pointer of an output says; None for a folder without one."""
    text = read_text(spark, f"{directory}/{POINTER}")
    return None if text is None else json.loads(text)


def fresh_folder() -> str:
    """Name of a folder for the next write."""
    return f"{_PREFIX}{uuid.uuid4().hex}"


def replace_pointer(spark: SparkSession, directory: str, facts: dict, folders: set[str]) -> None:
    """Make ``facts`` current, which names ``folders``, and delete what neither they nor the facts before need."""
    before = read_pointer(spark, directory) or {}
    replace_text(spark, f"{directory}/{POINTER}", json.dumps({**facts, "folders": sorted(folders)}, indent=1))
    needed = folders | set(before.get("folders", []))
    for name in list_names(spark, directory):
        if name.startswith(_PREFIX) and name not in needed:
            delete_path(spark, f"{directory}/{name}")


def current_folder(spark: SparkSession, directory: str) -> str:
    """Where the tables of an output are: the folder its pointer names, or ``directory`` itself."""
    facts = read_pointer(spark, directory) if path_exists(spark, directory) else None
    return directory if facts is None else f"{directory}/{facts['folder']}"
