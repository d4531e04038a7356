"""What a session needs before its tasks run functions of this library."""

from __future__ import annotations

import os
from pathlib import Path


def worker_path(spark) -> None:
    """Let Python workers look for this library where the driver found it; clusters get it by --py-files or an image."""
    root, environment = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))
