"""Configuration at the driver: defaults, a YAML file over them, secrets from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

NAME = "verdigris.yaml"
_WHOLE = re.compile(r"\$\{(\w+)\}")


# The defaults below.


@dataclass
class Models:
    default: str = "ollama/llama3.1:8b"
    generator: str | None = None
    providers: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Council:
    enabled: bool = True
    mode: str = "fast"
    members: list[str] = field(default_factory=list)
    chairman: str | None = None


@dataclass
class Prompt:
    prompt: str | None = None
    prompt_file: str | None = None
    min_score: float = 0.7
    version: str = "1.0.0"
    auto_generate: bool = True
    auto_generate_count: int = 50


@dataclass
class Testing:
    parallelism: int = 4
    timeout_ms: int = 30000
    retries: int = 2


@dataclass
class Store:
    storage_dir: str = ".verdigris/baselines"
    auto_update: bool = False
    min_improvement: float = 0.0


@dataclass
class Pages:
    fallback_search: str = "searxng"
    max_pages: int = 5
    timeout: int = 30


@dataclass
class Git:
    enabled: bool = False
    branch: str = "main"
    commit_template: str = "chore: BSP validation passed (score: {score:.2f}, improvement: +{improvement:.2f})"
    auto_push: bool = False

    def message(self, score: float, previous: float | None = None) -> str:
        """What a commit of an improved prompt says; a first score improves on zero."""
        return self.commit_template.format(score=score, previous_score=previous or 0.0, improvement=score - (previous or 0.0))


@dataclass
class Config:
    models: Models = field(default_factory=Models)
    council: Council = field(default_factory=Council)
    bsp: Prompt = field(default_factory=Prompt)
    testing: Testing = field(default_factory=Testing)
    baseline: Store = field(default_factory=Store)
    scraper: Pages = field(default_factory=Pages)
    git: Git = field(default_factory=Git)

    @property
    def parallelism(self) -> int:
        return self.testing.parallelism

    @property
    def min_improvement(self) -> float:
        return self.baseline.min_improvement


def _known(cls, data: dict) -> dict:
    return {f.name: data[f.name] for f in fields(cls) if f.name in data}


def load(path: str | Path | None = None, env: dict[str, str] | None = None) -> Config:
    """A file that is not there gives the defaults; unknown keys are passed over; a provider's key that is ``${NAME}``
    as a whole comes from the environment (empty if unset)."""
    file = Path(path) if path else Path.cwd() / NAME
    if not file.exists():
        return Config()
    import yaml

    env = dict(os.environ) if env is None else env
    data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    config = Config(**{f.name: f.default_factory(**_known(f.default_factory, data.get(f.name) or {})) for f in fields(Config)})
    for p in config.models.providers.values():
        if isinstance(p, dict) and isinstance(p.get("api_key"), str) and (m := _WHOLE.fullmatch(p["api_key"])):
            p["api_key"] = env.get(m[1], "")
    return config


def root(start: str | Path | None = None) -> Path | None:
    """The nearest folder at or above ``start`` that has a configuration."""
    here = Path(start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / NAME).exists()), None)


def system_prompt(config: Config, folder: str | Path | None = None) -> str | None:
    """The prompt itself, else its file's text (relative to the folder), else None."""
    if config.bsp.prompt:
        return config.bsp.prompt
    if config.bsp.prompt_file:
        file = Path(folder or ".") / config.bsp.prompt_file  # an absolute path stays as it is
        if file.exists():
            return file.read_text(encoding="utf-8")
    return None
