"""Settings: a flag outweighs the file, the file the default; unknown keys are errors."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import codec
from .functions.errors import UserError
from .functions.sizes import parse_budget


@dataclass(frozen=True)
class Settings:
    platform: str = "linux/amd64"
    intra_layer: str = "auto"
    level: int = 22
    window_log: int = 0
    candidates: int = 3
    workers: int = 8
    memory_budget: str = "8GiB"
    workdir: str = ""
    authfile: str = ""
    retry_times: int = 3
    retry_delay_ms: int = 100

    def budget_bytes(self) -> int:
        return parse_budget(self.memory_budget)


def load(path: str | None = None, **flags: object) -> Settings:
    """Defaults, then a JSON file, then the flags that are set."""
    known = {f.name: f.type for f in fields(Settings)}
    found = {}
    if path:
        found = json.loads(Path(path).read_text())
        if unknown := sorted(set(found) - set(known)):
            raise UserError(f"unknown settings: {', '.join(unknown)}")
    settings = replace(Settings(), **found, **{})
    settings = replace(settings, **{k: v for k, v in flags.items() if v is not None})
    settings.budget_bytes()
    return settings


def workdir(settings: Settings, output: str = "") -> str:
    """The setting, else the environment's folder, else beside the output, else a temporary folder; made if missing."""
    path = settings.workdir or os.environ.get("STRATALENS_WORKDIR") or (os.path.dirname(os.path.abspath(output)) if output else tempfile.gettempdir())
    os.makedirs(path, exist_ok=True)
    return path


def doctor(spark: SparkSession, settings: Settings | None = None, path: str | None = None) -> DataFrame:
    """(check, status, detail) of what a run needs: codec, work folder, credentials file, settings. The network is not tried."""
    rows = []
    ok, detail = codec.available()
    rows.append(("codec", "ok" if ok else "warn", detail))
    settings = settings or Settings()
    try:
        where = workdir(settings)
        with tempfile.TemporaryFile(dir=where):
            rows.append(("workdir", "ok", where))
    except OSError as e:
        rows.append(("workdir", "fail", str(e)))
    auth = settings.authfile
    rows.append(("authfile", "skip" if not auth else "ok" if os.access(auth, os.R_OK) else "fail", auth or "none set"))
    rows.append(("network", "skip", "not tried"))
    try:
        load(path)
        rows.append(("config", "ok", path or "defaults"))
    except (OSError, ValueError, UserError) as e:
        rows.append(("config", "fail", str(e)))
    return spark.createDataFrame(rows, "check string, status string, detail string")
