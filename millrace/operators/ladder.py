"""An adaptive rate controller as a fold over an outcome log.

A host climbs a ladder of request spacings on clean answers and falls on refusals. ``step`` is a pure
function of state, event, policy and signals; it serves the batch replay (one ordered pass per host, the
state of one host in memory) and the streaming form alike. State is plain data and survives JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Policy:
    """Thresholds. Times are seconds; ``spacings`` are seconds between requests, level 1 first."""

    enabled: bool = True
    spacings: tuple[float, ...] = (75.0, 50.0, 37.5, 30.0, 25.0, 18.75, 15.0, 10.7)
    hold_speed: float = 3.0
    trailing: int = 20
    gap_cap: float = 3600.0
    connection_blocks: int = 3
    connection_window: float = 600.0
    hold: float = 86_400.0
    episode: float = 3600.0
    episode_clean: int = 10
    brake_clean: int = 20
    calm_share: float = 0.30
    fall_row: int = 4
    fall_samples: int = 10
    fall_two: float = 0.50
    fall_one: float = 0.30
    cooldown: float = 7200.0
    cooldown_cap: float = 86_400.0
    quiet_day_requests: int = 100
    least_demand: int = 250
    ease_demand: int = 250
    climb_demand: int = 1000
    ease_every: float = 3600.0
    ceiling_24h: int = 5000
    climb_requests: int = 200
    fast_climb_requests: int = 600
    fast_budget_speed: float = 4.0
    fast_budget_share: float = 0.75
    wilson: float = 0.12
    stale: float = 600.0
    model_stop: int = 950

    @property
    def top(self) -> int:
        return len(self.spacings)

    def speed(self, level: int) -> float:
        return self.spacings[0] / self.spacings[level - 1]

    @property
    def hold_level(self) -> int:
        return max(k for k in range(1, self.top + 1) if self.speed(k) <= self.hold_speed + 1e-9)


@dataclass(frozen=True)
class Signals:
    """What the controller knows of the rest of the pipeline; ``age`` is how old that is."""

    demand: int = 100_000
    model_requests: int = 0
    age: float = 0.0


@dataclass
class Stint:
    """Requests since a level was entered; the cooldown is remembered beyond that."""

    requests: int = 0
    refused: int = 0
    clean: int = 0
    seconds: float = 0.0
    last_at: float | None = None
    blocked_until: float = 0.0
    cooldown: float | None = None

    @property
    def rate(self) -> float:
        """Clean answers per hour."""
        return self.clean * 3600 / self.seconds if self.seconds else 0.0


@dataclass
class State:
    level: int = 1
    active: bool = False
    day: int | None = None
    #: The latest outcomes at this level, neutral ones too.
    trailing: list[str] = field(default_factory=list)
    stints: dict[str, Stint] = field(default_factory=dict)
    hold_until: float = 0.0
    hours: dict[str, int] = field(default_factory=dict)
    requests_today: int = 0
    refusals_today: int = 0
    trouble_today: bool = False
    fast_climbs_today: int = 0
    connection_blocks: list[float] = field(default_factory=list)
    #: Of a brake: since when its episode lasts (null: no brake), and clean answers since the last block or refusal.
    brake_since: float | None = None
    brake_clean: int = 0
    paused_day: int | None = None
    eased_at: float | None = None

    def stint(self, level: int) -> Stint:
        return self.stints.setdefault(str(level), Stint())

    def json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str | None) -> State:
        """The state of a JSON text; anything that can't be read starts anew."""
        try:
            known = json.loads(text or "{}")
            out = cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})
            out.stints = {k: Stint(**v) for k, v in out.stints.items()}
            return out
        except (ValueError, TypeError, AttributeError):
            return cls()


def wilson(hits: float, n: float, z: float = 1.96) -> float:
    if not n:
        return 1.0
    p = hits / n
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def rolling(s: State, now: float) -> int:
    """Requests of the last 24 hours by whole hours: at most one hour too much."""
    return sum(n for h, n in s.hours.items() if int(h) >= now // 3600 - 24)


def _enter(s: State, level: int) -> None:
    """A level begins anew: nothing of its last stint counts but its cooldown."""
    s.level, s.trailing = level, []
    s.stints[str(level)] = Stint(cooldown=s.stint(level).cooldown)


def _refused_share(s: State) -> float:
    return s.trailing.count("refused") / len(s.trailing) if s.trailing else 0.0


def _refused_in_a_row(s: State) -> int:
    return next((k for k, x in enumerate(reversed(s.trailing)) if x != "refused"), len(s.trailing))


def _brake(s: State, p: Policy, now: float, day: int) -> str:
    """A block: to level 1 until enough clean answers come. One that goes on although few came pauses the day."""
    clean = s.brake_clean if s.brake_since is not None else 0
    if s.brake_since is None or clean >= p.episode_clean:
        s.brake_since, s.trouble_today = now, True
    if s.level > p.hold_level:
        s.hold_until = now + p.hold
    s.brake_clean = 0
    _enter(s, 1)
    if now - s.brake_since >= p.episode and clean < p.episode_clean:
        s.paused_day = day
        return "paused for the day"
    return "brake"


def _fall(s: State, p: Policy, now: float, levels: int) -> None:
    own = s.stint(s.level)
    wait = p.cooldown if own.cooldown is None else own.cooldown
    own.blocked_until, own.cooldown = now + wait, min(p.cooldown_cap, wait * 2)
    to = max(1, s.level - levels)
    if s.level > p.hold_level:
        to, s.hold_until = min(to, p.hold_level), now + p.hold
    s.trouble_today = True
    _enter(s, to)


def blocker(s: State, p: Policy, sig: Signals, now: float, throughput: bool = True) -> str | None:
    """Why the next level can't be had yet; None if nothing stands against it."""
    to, stint = s.level + 1, s.stint(s.level)
    if not s.active or s.paused_day is not None:
        return "inactive"
    if s.brake_since is not None:
        return "braking"
    if s.level >= p.top:
        return "top"
    if to > p.hold_level:
        if rolling(s, now) >= p.ceiling_24h:
            return "ceiling"
        if s.fast_climbs_today:
            return "one fast climb a day"
        if now < s.hold_until:
            return "hold"
        if stint.requests < p.fast_climb_requests:
            return "requests"
        if p.speed(to) > p.fast_budget_speed + 1e-9 and sig.model_requests >= round(p.fast_budget_share * p.model_stop):
            return "model budget"
    if stint.requests < p.climb_requests:
        return "requests"
    if now < s.stint(to).blocked_until:
        return "cooldown"
    if sig.age > p.stale:
        return "stale signals"
    if wilson(stint.refused, stint.requests) >= p.wilson:
        return "refusals"
    if _refused_share(s) >= p.calm_share or "refused" in s.trailing[-p.fall_row :]:
        return "not calm"
    if sig.demand < p.climb_demand:
        return "demand"
    if sig.model_requests >= p.model_stop:
        return "model stop"
    if throughput and s.level > 1:
        lower = s.stint(s.level - 1)
        if lower.requests >= p.climb_requests and stint.rate <= lower.rate:
            return "no faster"
    return None


def _count(s: State, p: Policy, now: float, outcome: str) -> None:
    s.trailing = [*s.trailing, outcome][-p.trailing :]
    s.requests_today += 1
    s.refusals_today += outcome == "refused"
    hour = str(int(now // 3600))
    s.hours = {h: n for h, n in s.hours.items() if int(h) >= now // 3600 - 24}
    s.hours[hour] = s.hours.get(hour, 0) + 1
    if s.brake_since is None:
        stint = s.stint(s.level)
        if stint.last_at is not None:
            stint.seconds += min(p.gap_cap, max(0.0, now - stint.last_at))
        stint.last_at = now
        stint.requests += 1
        stint.refused += outcome == "refused"
        stint.clean += outcome == "clean"


def step(s: State, now: float, day: int, outcome: str, p: Policy, sig: Signals, block: str | None = None, throughput: bool = True) -> str:
    """Fold one event into the state and say what it did.

    ``outcome`` is clean or refused, and anything else is neutral; ``block`` the kind of a block signal that came with
    it. The order of the checks is part of the contract.
    """
    if outcome not in ("clean", "refused"):
        outcome = "neutral"
    if not p.enabled:
        s.active, s.level, s.trailing, s.brake_since, s.paused_day = False, 1, [], None, None
        return "off"
    if s.paused_day is not None:
        if s.paused_day == day:
            return "paused"
        s.paused_day = s.brake_since = None
        _enter(s, 1)
    if not s.active:
        s.active, s.level, s.trailing = True, 1, []
    if s.day != day:
        if s.day is not None and s.requests_today >= p.quiet_day_requests and not s.trouble_today:
            for stint in s.stints.values():
                if stint.cooldown is not None and stint.cooldown > p.cooldown:
                    stint.cooldown = max(p.cooldown, stint.cooldown / 2)
        s.day, s.requests_today, s.refusals_today, s.trouble_today, s.fast_climbs_today = day, 0, 0, False, 0
    _count(s, p, now, outcome)
    if block == "connection":
        s.connection_blocks = [t for t in [*s.connection_blocks, now] if now - t <= p.connection_window]
        if len(s.connection_blocks) >= p.connection_blocks:
            return _brake(s, p, now, day)
    elif block:
        return _brake(s, p, now, day)
    if s.brake_since is not None:
        s.brake_clean = s.brake_clean + 1 if outcome == "clean" else 0 if outcome == "refused" else s.brake_clean
        if s.brake_clean >= p.brake_clean and _refused_share(s) < p.calm_share:
            s.brake_since = None
            _enter(s, 1)
            return "brake released"
        return "braking"
    if s.level > 1:
        share = _refused_share(s) if len(s.trailing) >= p.fall_samples else 0.0
        levels = 2 if _refused_in_a_row(s) >= p.fall_row or share >= p.fall_two else 1 if share >= p.fall_one else 0
        if levels:
            _fall(s, p, now, levels)
            return "fall"
    fresh = sig.age <= p.stale
    if s.level > p.hold_level:
        empty = fresh and sig.demand < p.least_demand
        if empty or rolling(s, now) >= p.ceiling_24h:
            _enter(s, p.hold_level)
            return "ease" if empty else "ceiling"
    if s.level > 1 and fresh and sig.demand < p.ease_demand and (s.eased_at is None or now - s.eased_at >= p.ease_every):
        s.eased_at = now
        _enter(s, s.level - 1)
        return "ease"
    if outcome == "clean" and blocker(s, p, sig, now, throughput) is None:
        s.fast_climbs_today += s.level + 1 > p.hold_level
        _enter(s, s.level + 1)
        return "climb"
    return "stay"


REPLAY = "host string, event_id long, level int, move string"


def replay(events: DataFrame, policy: Policy, signals: Signals, level: int = 1, throughput: bool = False) -> DataFrame:
    """The level after each event by host and in the order of time, from ``level`` on.

    events: host, t in seconds, day (a number, of the zone that days are counted in), event_id, outcome, block (the kind
    of a block signal or null).
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = object(), State()
        for part in parts:
            levels, moves = [], []
            for h, t, day, outcome, block in zip(part["host"], part["t"], part["day"], part["outcome"], part["block"], strict=True):
                if h != host:
                    host, state = h, State(level=level, active=True)
                moves.append(step(state, t, int(day), outcome, policy, signals, block, throughput))
                levels.append(state.level)
            part["level"], part["move"] = levels, moves
            yield part[["host", "event_id", "level", "move"]]

    ordered = events.select("host", "t", "day", "event_id", "outcome", "block").repartition("host").sortWithinPartitions("host", "t", "event_id")
    return ordered.mapInPandas(fold, REPLAY)
