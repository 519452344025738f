"""Settings from a file: one ``name = value`` a line, ``#`` and ``!`` begin comments.

The names are those of Spark's and this engine's settings (``spark.checkpoint.dir``,
``weft.fixpoint.rounds``).  The file is the one asked for, else the one that the environment's
``WEFT_SETTINGS`` names, else ``weft.properties`` in the working folder, else there are none.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

VARIABLE, DEFAULT = "WEFT_SETTINGS", "weft.properties"


def parse(text: str) -> dict[str, str]:
    """A line without ``=``, or without a name before it, is a ValueError; the last value of a name counts."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        name, equals, value = line.partition("=")
        if not equals or not name.strip():
            raise ValueError(f"line {number}: not of the form name = value")
        out[name.strip()] = value.strip()
    return out


def find(path: str | None = None) -> dict[str, str]:
    """A file that was asked for, or that the environment names, must exist."""
    named = path or os.environ.get(VARIABLE)
    file = Path(named or DEFAULT)
    return parse(file.read_text(encoding="utf-8")) if named or file.exists() else {}


def apply(builder: SparkSession.Builder, settings: dict[str, str]) -> SparkSession.Builder:
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder
