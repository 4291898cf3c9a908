"""Thresholds as frozen, validated values."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class _Checked:
    """Every number of a part is zero or more."""

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            _need(isinstance(v, bool) or not isinstance(v, (int, float)) or v >= 0, f"{f.name} is negative")


@dataclass(frozen=True)
class Rates(_Checked):
    """Reading units a second, by script."""

    cjk: float
    latin: float

    def under(self, other: Rates) -> bool:
        return 0 < self.cjk < other.cjk and 0 < self.latin < other.latin


@dataclass(frozen=True)
class Display(_Checked):
    """Seconds that a cue may stand: what is possible at all, what is wanted at least and at most."""

    possible: float
    least: float
    most: float


@dataclass(frozen=True)
class Jumps(_Checked):
    """Ratio of neighbouring loads: wanted at most, never allowed, and the load from which on one is felt."""

    wanted: float
    never: float
    felt: float


@dataclass(frozen=True)
class MarkWeights(_Checked):
    """Reading units of spaces and punctuation."""

    space: float
    weak: float
    strong: float


@dataclass(frozen=True)
class Rhythm(_Checked):
    """Silences in ms that end a rhythm, and all flow; neighbours that count on each side."""

    pause_ms: int
    stop_ms: int
    neighbours: int


@dataclass(frozen=True)
class Budgets(_Checked):
    """Ms that a boundary may move, by grade of evidence."""

    low: int
    medium: int
    high: int


#: The thresholds of the three presets. Those of "balanced" hold where another names none.
_PARTS = {
    "comfort": Rates, "hard": Rates, "display": Display, "jump": Jumps, "marks": MarkWeights, "rhythm": Rhythm, "budget": Budgets,
}
_VALUES = {
    "balanced": {
        "comfort": (9.0, 16.0), "hard": (11.0, 20.0), "display": (0.5, 1.0, 6.0), "jump": (1.8, 3.0, 0.6), "marks": (0.0, 0.25, 0.5),
        "rhythm": (800, 1500, 4), "budget": (250, 500, 1000), "balance": False,
    },
    "loose": {"comfort": (10.0, 18.0), "hard": (12.0, 22.0), "display": (0.5, 0.8, 7.0), "jump": (2.2, 3.5, 0.6)},
    "smooth": {"comfort": (8.0, 14.0), "hard": (10.0, 18.0), "display": (0.5, 1.2, 5.5), "jump": (1.5, 2.5, 0.6), "balance": True},
}


def _made(preset: str) -> dict[str, Any]:
    values = _VALUES["balanced"] | _VALUES[preset]
    return {name: _PARTS[name](*v) if name in _PARTS else v for name, v in values.items()}


@dataclass(frozen=True)
class SpeedPolicy:
    """Reading-speed thresholds by what they bound; ``balance`` also evens out unequal neighbours."""

    preset: str = "balanced"
    comfort: Rates = _made("balanced")["comfort"]
    hard: Rates = _made("balanced")["hard"]
    display: Display = _made("balanced")["display"]
    jump: Jumps = _made("balanced")["jump"]
    marks: MarkWeights = _made("balanced")["marks"]
    rhythm: Rhythm = _made("balanced")["rhythm"]
    budget: Budgets = _made("balanced")["budget"]
    balance: bool = False

    def __post_init__(self) -> None:
        _need(self.comfort.under(self.hard), "comfort rates must be above zero and under hard rates")
        _need(0 < self.display.possible <= self.display.least <= self.display.most, "durations must rise from the possible one to the longest")
        _need(self.jump.wanted > 0 and self.jump.never > 0, "jump limits must be above zero")
        _need(self.rhythm.neighbours >= 1, "a rhythm needs a neighbour")
        _need(0 < self.rhythm.pause_ms <= self.rhythm.stop_ms, "the hard reset must be the longer one")
        _need(self.budget.low <= self.budget.medium <= self.budget.high, "movement budgets must rise with confidence")

    def with_overrides(self, changes: dict[str, Any]) -> SpeedPolicy:
        """The policy with some thresholds changed, named like ``comfort.cjk``; checked as a whole."""
        parts: dict[str, Any] = {}
        for name, value in changes.items():
            part, _, field = name.partition(".")
            known = {f.name for f in fields(self)} if not field else {f.name for f in fields(_PARTS.get(part, SpeedPolicy))}
            _need((field or part) in known and (bool(field) == (part in _PARTS)), f"unknown setting: {name}")
            parts[part] = replace(parts.get(part, getattr(self, part)), **{field: value}) if field else value
        return replace(self, **parts)


PRESETS = {name: SpeedPolicy(preset=name, **_made(name)) for name in _VALUES}


def speed_policy(preset: str = "balanced", changes: dict[str, Any] | None = None) -> SpeedPolicy:
    """A preset with some thresholds changed."""
    _need(preset in PRESETS, f"no preset {preset!r}; there are {sorted(PRESETS)}")
    return PRESETS[preset].with_overrides(changes or {})


@dataclass(frozen=True)
class PostprocessConfig:
    """Switches and thresholds of the repair stages; the defaults are fixed values."""

    remove_placeholders: bool = False
    extra_placeholders: tuple[str, ...] = ()
    normalize_quotes: bool = False
    trim_trailing_punct: bool = True
    fix_gaps: bool = False
    min_gap_ms: int = 30
    max_gap_ms: int = 800
    gap_mode: str = "extend"
    tail_compensation: bool = False
    min_compensation_ms: int = 200
    max_compensation_ms: int = 800
    max_compensation_gap_ms: int = 2000
    audit_reading_speed: bool = False
    max_cps_cjk: float = 11.0
    max_cps_latin: float = 20.0
    comfort_cps_cjk: float = 9.0
    comfort_cps_latin: float = 16.0
    min_duration_ms: int = 1000
    max_duration_ms: int = 7000
    short_text_max_chars: int = 12
    short_text_max_duration_ms: int = 4000
    speed_optimize: bool = False
    speed_preset: str = "balanced"

    def __post_init__(self) -> None:
        _need(0 <= self.min_gap_ms <= self.max_gap_ms, "gap limits must rise from zero")
        _need(self.gap_mode in ("extend", "midpoint"), "gap_mode is extend or midpoint")
        _need(0 <= self.min_compensation_ms <= self.max_gap_ms, "the least compensation must fit the widest gap that is closed")
        _need(self.min_compensation_ms <= self.max_compensation_ms, "compensation limits must rise")
        span = self.max_compensation_gap_ms - self.max_gap_ms
        _need(span > 0 and self.max_compensation_ms - self.min_compensation_ms <= span, "compensation may not rise faster than the gap")
        _need(self.comfort_cps_cjk <= self.max_cps_cjk and self.comfort_cps_latin <= self.max_cps_latin, "comfort rates may not pass hard rates")
        _need(0 < self.min_duration_ms <= self.max_duration_ms, "durations must rise")
