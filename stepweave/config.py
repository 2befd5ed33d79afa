"""Settings by field: the environment over a file over the defaults, with where each value comes from."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from stepweave.schema import BACKOFF_ORDER, CLEAN_WEIGHT, HOPS, LEVELS, LOOP_LENGTH, MIN_SUPPORT

PREFIX = "STEPWEAVE_"


@dataclass(frozen=True)
class Config:
    level: str = "class/program"
    k: int = LOOP_LENGTH
    h: int = HOPS
    min_support: int = MIN_SUPPORT
    backoff_order: int = BACKOFF_ORDER
    clean_prompt_weight: float = CLEAN_WEIGHT
    same_file_conditioning: bool = True
    enforce: bool = False

    def __post_init__(self):
        if self.level not in LEVELS:
            raise ValueError(f"level {self.level!r} is none of {LEVELS}")


def _typed(name: str, kind: str, value) -> object:
    if kind == "bool":
        if str(value).lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name}: {value!r} is no boolean")
        return str(value).lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](value)


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> tuple[Config, dict[str, str]]:
    """The settings, and for each field `env`, `file` or `default`."""
    file = json.loads(Path(path).read_text()) if path and Path(path).is_file() else {}
    env = environment or {}
    values, origin = {}, {}
    for f in fields(Config):
        name = PREFIX + f.name.upper()
        if name in env:
            values[f.name], origin[f.name] = _typed(name, f.type, env[name]), "env"
        elif f.name in file:
            values[f.name], origin[f.name] = _typed(f.name, f.type, file[f.name]), "file"
        else:
            origin[f.name] = "default"
    return Config(**values), origin
