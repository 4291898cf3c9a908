"""Stored settings of repairs: baselines that can't change, and settings of older versions brought up to date."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import PRESETS, PostprocessConfig

#: Older names of settings, those that have no successor, and those that only concern screens and calls.
RENAMED = {"tail_dwell": "tail_compensation", "tail_dwell_long_ms": "max_compensation_ms", "tail_dwell_long_gap_ms": "max_compensation_gap_ms", "speed_profile": "speed_preset"}
DROPPED = ("tail_dwell_short_ms", "tail_dwell_scene_cut_ms", "tail_dwell_min_blank_ms")
ELSEWHERE = ("qa_report", "speed_semantic_repair", "precise_timing", "optimize_both_sides")
#: What falls back to its default together where migrated values break a rule.
_CURVE = ("min_compensation_ms", "max_compensation_gap_ms", "max_compensation_ms")
_KNOWN = {f.name for f in fields(PostprocessConfig)}


def migrated(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Settings under today's names. A new name that is there already wins over the old one."""
    out = {k: v for k, v in settings.items() if k not in RENAMED and k not in DROPPED and k not in ELSEWHERE}
    return {RENAMED[k]: v for k, v in settings.items() if k in RENAMED} | out


def config_of(settings: Mapping[str, Any]) -> PostprocessConfig:
    """Checked settings; what isn't given has its default. Old compensation values that break today's rules fall back, all three together; unknown names and all else that is wrong raise."""
    values = migrated(settings)
    unknown = sorted(set(values) - _KNOWN)
    if unknown:
        raise ValueError(f"unknown setting: {unknown[0]}")
    try:
        return PostprocessConfig(**values)
    except (TypeError, ValueError):
        return PostprocessConfig(**{k: v for k, v in values.items() if k not in _CURVE})


def baseline(template: str) -> PostprocessConfig:
    """The settings that a template is shipped with: tails trimmed and the speed pass of its preset."""
    if template not in PRESETS:
        raise ValueError(f"no template {template!r}; there are {sorted(PRESETS)}")
    return PostprocessConfig(trim_trailing_punct=True, speed_optimize=True, speed_preset=template)


@dataclass(frozen=True)
class Profile:
    """Named settings that started from a template; the id is 1 to 64 small letters, digits, dots, hyphens or underscores, and no template's."""

    profile_id: str
    name: str
    template: str
    config: PostprocessConfig

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,63}", self.profile_id) or self.profile_id in PRESETS:
            raise ValueError(f"no profile id, or one of a template: {self.profile_id!r}")
        object.__setattr__(self, "name", self.name.strip())
        if not 0 < len(self.name) <= 80 or any(ord(c) < 32 for c in self.name):
            raise ValueError("a profile's name has 1 to 80 letters that can be shown")
        baseline(self.template)

    @classmethod
    def read(cls, stored: Mapping[str, Any]) -> Profile:
        """A profile as it is stored; its settings lie over the defaults, those of older versions under their new names."""
        return cls(stored["profile_id"], stored["name"], stored["template"], config_of(stored.get("settings", {})))

    def reset(self) -> Profile:
        """The profile with the settings of its template."""
        return Profile(self.profile_id, self.name, self.template, baseline(self.template))


def migrated_json(settings: Column | str) -> Column:
    """The same renaming for a column of stored settings, JSON objects of one level, as ``map<string, string>`` of today's names; null where it isn't an object."""
    m = F.from_json(F.col(settings) if isinstance(settings, str) else settings, "map<string,string>")
    gone = F.array(*[F.lit(k) for k in (*DROPPED, *ELSEWHERE, *RENAMED)])
    kept = F.map_filter(m, lambda k, _: ~F.array_contains(gone, k))
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    old = F.transform_keys(F.map_filter(m, lambda k, _: F.map_contains_key(names, k)), lambda k, _: F.element_at(names, k))
    return F.map_concat(kept, F.map_filter(old, lambda k, _: ~F.map_contains_key(kept, k)))
