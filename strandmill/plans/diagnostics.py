"""Events of long preparation runs, appended as JSON lines, and tidying of stage caches."""

from __future__ import annotations

import json
import os
import resource
import shutil
import time


def emit(folder: str, prefix: str, phase: str, **details) -> None:
    """Appends an event with time, phase and memory; a failure to write is no failure of the run."""
    event = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S"), "phase": phase, "rss_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 2)} | details
    try:
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{prefix}_prep_diagnostics.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps(event, sort_keys=True, default=str) + "\n")
    except OSError:
        pass


def clean_cache(folder: str) -> list[str]:
    """Removes the stage caches that were not written to the end; gives their names."""
    removed = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = os.path.join(folder, name)
        if os.path.isdir(path) and not os.path.exists(os.path.join(path, "_SUCCESS")):
            shutil.rmtree(path)
            removed.append(name)
    return removed
