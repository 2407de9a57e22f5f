"""Settings: strict dataclasses from nested mappings, variables expanded, errors naming file and key."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from pathlib import Path
from typing import Any, get_type_hints

from heddle.operators.models import family_of, size_problem


class SettingsError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Chunking:
    strategy: str = "recursive"
    max_tokens: int = 512
    overlap: int = 0
    breakpoint_percentile: float = 0.9
    buffer_size: int = 1


@dataclasses.dataclass(frozen=True)
class Search:
    method: str = "hybrid"
    top_k: int = 5
    candidates: int = 20
    rrf_k: int = 2
    enough_score: float = 0.5
    floor: float = 0.0
    max_rewrites: int = 1


@dataclasses.dataclass(frozen=True)
class Tables:
    row_limit: int = 200
    timeout_s: float = 10.0
    max_repairs: int = 2
    max_bytes: int = 50_000_000
    max_rows: int = 1_000_000


@dataclasses.dataclass(frozen=True)
class Embedding:
    """A size of 0 keeps the model's own; empty templates are those of the model's family."""

    model: str = "hashing"
    size: int = 0
    document: str = ""
    query: str = ""
    pictures: bool = False


@dataclasses.dataclass(frozen=True)
class Settings:
    name: str = "default"
    model: str = "hashing"
    embedding: Embedding = Embedding()
    chunking: Chunking = Chunking()
    search: Search = Search()
    tables: Tables = Tables()


def expand(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${NAME}`` in strings becomes the variable's value; one that is not set is an error."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if isinstance(value, str):
        for name in re.findall(r"\$\{(\w+)\}", value):
            if name not in env:
                raise SettingsError(f"The variable {name} is not set.")
            value = value.replace(f"${{{name}}}", env[name])
    return value


def build(kind: type, values: dict[str, Any], where: str = "settings", key: str = "") -> Any:
    hints, out = get_type_hints(kind), {}
    for name, value in values.items():
        path = f"{key}.{name}".lstrip(".")
        if name not in hints:
            raise SettingsError(f"{where}: unknown key {path}.")
        want = hints[name]
        if dataclasses.is_dataclass(want):
            value = build(want, value or {}, where, path)
        elif want is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, want) or want in (int, float) and isinstance(value, bool):
            raise SettingsError(f"{where}: {path} must be {want.__name__}.")
        out[name] = value
    return kind(**out)


def completed(settings: Settings) -> Settings:
    """The settings with the family's templates where they have none; fields that don't go together are an error."""
    own, family = settings.embedding, family_of(settings.embedding.model)
    if problem := size_problem(own.model, own.size or None):
        raise SettingsError(f"embedding.size: {problem}")
    if own.pictures and not family.images:
        raise SettingsError(f"embedding.pictures needs a model that takes images, which {own.model} does not.")
    for key in ("document", "query"):
        if getattr(own, key) and "{text}" not in getattr(own, key):
            raise SettingsError(f"embedding.{key} must have a place for {{text}}.")
    if settings.chunking.overlap >= settings.chunking.max_tokens:
        raise SettingsError("chunking.overlap must be less than chunking.max_tokens.")
    return dataclasses.replace(
        settings,
        embedding=dataclasses.replace(own, document=own.document or family.document, query=own.query or family.query),
    )


def load(path: str, env: dict[str, str] | None = None) -> Settings:
    """A YAML or JSON file as settings."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    return completed(build(Settings, expand(raw or {}, env), path))


def config_hash(settings: Any, unused: tuple[str, ...] = ()) -> str:
    """Sixteen hexadecimal digits that change with every setting but the unused ones; a family's templates count alike whether they are written out or not."""
    whole = completed(settings) if isinstance(settings, Settings) else settings
    values = {k: v for k, v in dataclasses.asdict(whole).items() if k not in unused}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]
