"""The folder of cloned repositories: one subfolder a URL, and beside each a small record of what it holds. Driver only."""

from __future__ import annotations

import datetime
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

from skein.sources.repository import cache_dir

SCHEMA = "dir string, canonical_url string, ref string, commit string, cloned_at string, updated_at string"
FIELDS = ("canonical_url", "ref", "commit", "cloned_at", "updated_at")


class Clones:
    def __init__(self, root: str):
        self.root = os.path.abspath(os.path.expanduser(root))

    def path(self, url: str) -> str:
        return os.path.join(self.root, cache_dir(url))

    def _read(self, path: str) -> dict | None:
        """The record beside a subfolder; none if it is missing or is not a record."""
        try:
            with open(f"{path}.json", encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            return None
        return found if isinstance(found, dict) else None

    def get(self, url: str) -> dict | None:
        return self._read(self.path(url)) if os.path.isdir(self.path(url)) else None

    def update(self, url: str, ref: str | None, commit: str | None, first: bool = False, **more: object) -> dict:
        """Notes what was fetched: cloned_at stays once it is set, updated_at moves, `more` is kept beside what was there."""
        path, now = self.path(url), datetime.datetime.now().isoformat(timespec="seconds")
        old = self._read(path) or {}
        new = old | {"canonical_url": url, "ref": ref, "commit": commit, "updated_at": now, "metadata": {**(old.get("metadata") or {}), **more}}
        if first or not new.get("cloned_at"):
            new["cloned_at"] = now
        os.makedirs(self.root, exist_ok=True)
        part = f"{path}.json.new"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(new, f, ensure_ascii=False, indent=2)
        os.replace(part, f"{path}.json")  # a record is whole or the old one
        return new

    def _folders(self) -> list[str]:
        return sorted(e.name for e in os.scandir(self.root) if e.is_dir()) if os.path.isdir(self.root) else []

    def list(self, spark: SparkSession) -> DataFrame:
        """dir and the record's fields of every subfolder with a record, by dir."""
        rows = [(name, *[found.get(k) for k in FIELDS]) for name in self._folders() if (found := self._read(os.path.join(self.root, name)))]
        return spark.createDataFrame(rows, SCHEMA).orderBy("dir")

    def _drop(self, path: str) -> bool:
        there = os.path.isdir(path)
        shutil.rmtree(path, ignore_errors=True)
        if os.path.exists(f"{path}.json"):
            os.remove(f"{path}.json")
        return there

    def remove(self, url: str) -> bool:
        return self._drop(self.path(url))

    def prune(self) -> list[str]:
        """Removes every subfolder; their names."""
        gone = self._folders()
        for name in gone:
            self._drop(os.path.join(self.root, name))
        return gone
