"""Configuration: one JSON object, checked as it is read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from memloom.operators.history import WindowPolicy
from memloom.operators.readout import Policy


@dataclass(frozen=True)
class Config:
    data_dir: str
    scene: str = "chat"
    window: WindowPolicy = field(default_factory=WindowPolicy)
    max_chars_per_user: int = 0
    readout: Policy = field(default_factory=Policy)
    hyde: str = "off"  # off, fallback, augmented
    options_in_query: bool = True

    def __post_init__(self) -> None:
        if self.scene not in ("chat", "work"):
            raise ValueError("scene must be chat or work")
        if self.hyde not in ("off", "fallback", "augmented"):
            raise ValueError("hyde must be off, fallback or augmented")
        if not 0 < self.window.soft <= self.window.hard:
            raise ValueError("windows need 0 < soft <= hard")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """Read a config through Spark; a relative data_dir is under the file's folder; unknown names are refused."""
        given = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        root = given["data_dir"]
        if "://" not in root and not PurePosixPath(root).is_absolute():
            root = f"{path.rsplit('/', 1)[0]}/{root}"
        more = {"window": WindowPolicy(**given.get("window", {})), "readout": Policy(**given.get("readout", {}))}
        return cls(**{**given, "data_dir": root, **more})
