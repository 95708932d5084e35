"""Settings: defaults, then a file, then the environment; a project's own file may override a few, strictly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    extensions: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = (".git", "node_modules", "vendor", "dist", "build")
    max_file_bytes: int = 2 << 20
    max_line_bytes: int = 1 << 20
    window_lines: int = 40
    overlap_lines: int = 8
    strategy: str = "hybrid"
    embed_ratio: float = 0.85
    prose_overlap: float = 0.12
    min_chunk_tokens: int = 24
    context_prefix: bool = True
    debounce_seconds: float = 2.0
    poll_seconds: float = 10.0
    stats_window: int = 20
    slow_seconds: float = 5.0
    slow_ratio: float = 2.0
    provider: str = "hash"
    dims: int = 64
    model: str = ""
    tokenizer: str = ""
    embed_url: str = ""
    embed_key_env: str = "TRAWL_EMBED_KEY"


#: What a project may set.
PROJECT_KEYS = frozenset({"extensions", "skip_dirs", "strategy", "min_chunk_tokens", "context_prefix", "debounce_seconds", "poll_seconds"})
PREFIX = "TRAWL_"


def _typed(name: str, value: object) -> object:
    kind = type(getattr(Settings(), name))
    if kind is tuple:
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("1", "true", "yes", "0", "false", "no"):
            raise ValueError(f"{name}: not a yes or no: {value}")
        return value.lower() in ("1", "true", "yes")
    return kind(value)


def merged(base: Settings, values: Mapping[str, object], allowed: frozenset[str] | None = None) -> Settings:
    """``base`` with ``values``; an unknown key, or one that is not allowed, is an error."""
    known = {f.name for f in fields(Settings)}
    if wrong := set(values) - (known if allowed is None else known & allowed):
        raise ValueError(f"unknown settings: {sorted(wrong)}")
    return replace(base, **{k: _typed(k, v) for k, v in values.items()})


def from_environment(base: Settings, environment: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if environment is None else environment
    names = {f.name: f"{PREFIX}{f.name.upper()}" for f in fields(Settings)}
    return merged(base, {k: env[n] for k, n in names.items() if env.get(n)})


def parse_dotenv(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, _, v = line.partition("=")
            out[k.strip()] = v.strip().strip("\"'")
    return out


def load(text: str = "", project: str = "", environment: Mapping[str, str] | None = None, dotenv: str = "") -> Settings:
    """Settings from YAML texts, the environment, and the text of a file of variables, which the environment overrides; YAML needs its library."""
    def mapping(t: str) -> dict:
        if not t.strip():
            return {}
        import yaml

        return yaml.safe_load(t) or {}

    env = parse_dotenv(dotenv) | dict(os.environ if environment is None else environment)
    return merged(from_environment(merged(Settings(), mapping(text)), env), mapping(project), PROJECT_KEYS)
