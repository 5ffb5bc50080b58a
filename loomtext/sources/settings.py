"""Settings from an environment mapping and a file of NAME=value lines; the mapping comes first. Names in any case."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """What the engine needs of them; credentials belong to the session's own configuration."""

    archive_path: str = ""
    tables_path: str = ""
    crawl_delay: float = 2.0
    crawl_user_agent: str = "loomtext/1.0"
    crawl_respect_robots_txt: bool = True
    crawl_max_retries: int = 3
    log_level: str = "INFO"


def _value(kind: str, text: str):
    if kind == "bool":
        low = text.strip().lower()
        if low not in ("1", "true", "t", "yes", "y", "on", "0", "false", "f", "no", "n", "off"):
            raise ValueError(f"not a truth value: {text}")
        return low in ("1", "true", "t", "yes", "y", "on")
    return {"float": float, "int": int, "str": str}[kind](text)


def load(env: Mapping[str, str] | None = None, file: str | None = ".env") -> Settings:
    given: dict[str, str] = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    given[name.strip().lower()] = value.strip().strip("'\"")
    given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    return Settings(**{f.name: _value(str(f.type), given[f.name]) for f in fields(Settings) if f.name in given})
