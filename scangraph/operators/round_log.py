"""What an iterative job has completed, so that a stopped one can go on where it was.

Every round adds one small file after its tables are complete, and only then are tables it no longer needs
deleted. An entry names the run it belongs to: a digest of the inputs and parameters. A file that was cut off is
not read, and the entry before it still finds all its tables.
"""

from __future__ import annotations

import json

from scangraph.storage import Workspace, delete_path, list_names, path_exists, read_text, write_text


class RoundLog:
    """Entries of one run in the folder ``_rounds`` of a workspace; without ``run`` nothing is kept."""

    def __init__(self, work: Workspace, run: str | None):
        self.work, self.run, self.folder = work, run, work.path("_rounds")

    def last(self) -> dict | None:
        """The newest whole entry of this run."""
        spark = self.work.spark
        if self.run is None or not path_exists(spark, self.folder):
            return None
        for name in reversed(list_names(spark, self.folder)):
            try:
                entry = json.loads(read_text(spark, f"{self.folder}/{name}") or "")
            except ValueError:
                continue
            if entry.get("run") == self.run:
                return entry
        return None

    def add(self, step: int, **facts: object) -> None:
        """Log that everything before round ``step`` is complete."""
        if self.run is not None:
            text = json.dumps({"run": self.run, "step": step, **facts})
            write_text(self.work.spark, f"{self.folder}/round-{step:06d}.json", text)

    def clear(self) -> None:
        delete_path(self.work.spark, self.folder)
