"""Settings from JSON files, checked when they are read: a missing, unknown or mistyped value raises with its name."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TierPolicy:
    threshold: float
    verifies: bool = False
    packages: bool = False


@dataclass(frozen=True)
class Settings:
    """What the queues and stages need; tiers are keyed by their number."""

    tiers: dict[int, TierPolicy]
    keywords: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=lambda: ["en", "es", "it"])
    quota_one_in: int = 4
    verify_batch: int = 8
    score_batch: int = 5
    patience_s: float = 1800.0
    daily_requests: int = 1000
    daily_tokens: int = 200_000


@dataclass(frozen=True)
class Schedule:
    """When requests are made: the zone that days are counted in, a daily closed window (seconds of the day), and the ladder's spacings."""

    zone: str = "UTC"
    closed_from: int = 0
    closed_to: int = 0
    spacings: list[float] = field(default_factory=lambda: [75.0])
    ceiling_24h: int = 5000


@dataclass(frozen=True)
class Source:
    """One feed or board: whether it is walked, how often, how far a walk goes and what it is told."""

    name: str
    enabled: bool = True
    interval_hours: int = 24
    page_cap: int = 90
    options: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Limit:
    """What a provider allows in a day, for one model or for all (``*``)."""

    provider: str
    model: str
    unit: str
    per_day: int | None = None
    note: str = ""


@dataclass(frozen=True)
class Guard:
    """Which model a stage should be answered by, and from which share of others on that warns."""

    primary: dict[str, str]
    most_other: float = 0.2
    least_answers: int = 5


@dataclass(frozen=True)
class Sources:
    sources: list[Source]


@dataclass(frozen=True)
class Limits:
    limits: list[Limit]


def _checked(kind: object, value: object, name: str) -> object:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is types.UnionType:  # a kind or null
        return None if value is None else _checked(next(x for x in args if x is not type(None)), value, name)
    if dataclasses.is_dataclass(kind):
        return build(kind, value, name)
    if origin is dict and isinstance(value, dict):
        return {_checked(args[0], int(k) if args[0] is int and str(k).isdigit() else k, name): _checked(args[1], v, f"{name}.{k}") for k, v in value.items()}
    if origin is list and isinstance(value, list):
        return [_checked(args[0], v, f"{name}[{k}]") for k, v in enumerate(value)]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if origin is None and isinstance(value, kind) and (kind is bool or not isinstance(value, bool)):
        return value
    raise ValueError(f"{name}: {value!r} is no {kind}")


def build(kind: type, raw: object, name: str = "settings") -> object:
    """An instance of a dataclass from a JSON object."""
    if not isinstance(raw, dict):
        raise ValueError(f"{name}: not an object")
    kinds = typing.get_type_hints(kind)
    if unknown := set(raw) - set(kinds):
        raise ValueError(f"{name}: unknown {sorted(unknown)}")
    required = {f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if missing := required - set(raw):
        raise ValueError(f"{name}: missing {sorted(missing)}")
    return kind(**{k: _checked(kinds[k], v, f"{name}.{k}") for k, v in raw.items()})


def load(kind: type, path: str) -> object:
    """A small file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return build(kind, json.load(f))


def settings(path: str) -> Settings:
    return load(Settings, path)


def slices(roles: list[str], areas: list[str], pairs: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """The (role, area) pairs to walk: all, or for the roles of ``pairs`` those areas only; an unknown name raises."""
    wrong = [r for r in pairs or {} if r not in roles] + [a for x in (pairs or {}).values() for a in x if a not in areas]
    if wrong:
        raise ValueError(f"unknown: {wrong}")
    return [(r, a) for r in roles for a in (pairs or {}).get(r, areas)]


def limit_for(limits: list[Limit], provider: str, model: str) -> Limit | None:
    """The limit of a model, or else the provider's for all."""
    own = [x for x in limits if x.provider == provider]
    return next((x for x in own if x.model == model), None) or next((x for x in own if x.model == "*"), None)
