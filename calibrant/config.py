"""Strict configuration: typed sections, dotted overrides, JSON or YAML files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path

from calibrant.errors import ConfigError
from calibrant.sources.files import parse_scalar, set_dotted

#: Widths a support may have (fixed values).
TOP_K = (0, 16, 32, 64, 128, 256)


@dataclass
class Selection:
    enabled: bool = True
    budgets: tuple[int, ...] = (256, 512, 1024, 2048)
    weights: tuple[float, ...] = (0.3, 0.3, 0.2, 0.2)
    seed: int = 0


@dataclass
class Ratio:
    mode: str = "adaptive"
    initial: float = 0.3
    max_step: float = 0.05
    warmup: int = 100

    def __post_init__(self) -> None:
        if self.mode not in ("fixed", "linear", "adaptive"):
            raise ConfigError(f"unknown ratio mode: {self.mode}")


@dataclass
class Config:
    top_k: int = 256
    clip: float = 0.2
    staleness: int = 4
    selection: Selection = field(default_factory=Selection)
    ratio: Ratio = field(default_factory=Ratio)

    def __post_init__(self) -> None:
        if self.top_k not in TOP_K:
            raise ConfigError(f"top_k must be one of {TOP_K}")


def _build(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ConfigError(f"unknown keys: {sorted(extra)}")
    made = {}
    for k, v in values.items():
        sub = known[k].default_factory if known[k].default_factory is not None else None
        made[k] = _build(sub, v) if isinstance(v, dict) and is_dataclass(sub) else tuple(v) if isinstance(v, list) else v
    return kind(**made)


def load(path: str | None = None, overrides: dict[str, str] | None = None) -> Config:
    """A file's values under dotted overrides; unknown keys fail. YAML needs the yaml package."""
    values: dict = {}
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ConfigError("YAML files need the yaml package") from e
            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
    for k, v in (overrides or {}).items():
        set_dotted(values, k, parse_scalar(v) if isinstance(v, str) else v)
    return _build(Config, values)


def dump(config: Config) -> str:
    return json.dumps(asdict(config), indent=2, sort_keys=True)
