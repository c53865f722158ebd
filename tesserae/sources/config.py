"""Configuration: nested mappings from JSON, values of the environment put in for ``${NAME:default}``."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

_VARIABLE = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def substitute(value: object, env: dict[str, str] | None = None) -> object:
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else ""), value)
    return value


def load(path: str, env: dict[str, str] | None = None) -> dict:
    return substitute(json.loads(Path(path).read_text("utf-8")), env)


def save(config: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, ensure_ascii=False, indent=2), "utf-8")


def get(config: dict, dotted: str, default: object = None) -> object:
    for part in dotted.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config
