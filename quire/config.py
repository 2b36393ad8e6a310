"""Settings of the engine; every value can be given by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field


def _number(env: dict, name: str, default: int) -> int:
    v = env.get(name, "")
    return int(v) if v.strip().isdigit() else default


@dataclass(frozen=True)
class PartLimits:
    """Sizes in code points, and the blank lines before a unit that make a boundary of each strength."""

    target_min: int = 8000
    target_max: int = 15000
    hard_max: int = 20000
    min_part: int = 2000
    strong: int = 5
    mid: int = 3
    para: int = 1
    #: Cut only at line starts: cuts inside a line move back to its start where that leaves a non-empty part.
    strict_units: bool = False

    @classmethod
    def from_env(cls, env: dict, prefix: str = "QUIRE_") -> PartLimits:
        """Values that are not plain digits leave the default."""
        names = ("target_min", "target_max", "hard_max", "min_part")
        return cls(**{n: _number(env, prefix + n.upper(), getattr(cls, n)) for n in names})


@dataclass(frozen=True)
class RatioBands:
    """Accepted target length / source length."""

    unit_warn_low: float = 0.45
    unit_warn_high: float = 1.80
    unit_fail_low: float = 0.30
    unit_fail_high: float = 2.50
    part_warn_low: float = 0.60
    part_warn_high: float = 2.50


@dataclass(frozen=True)
class ContextLimits:
    budget: int = 8000
    translation_tail: int = 1200
    raw_tail: int = 600
    glossary: int = 40


@dataclass(frozen=True)
class Run:
    """A project's settings: languages, genre and limits."""

    source: str = ""
    source_lang: str = ""
    target_lang: str = ""
    source_name: str = ""
    target_name: str = ""
    genre: str = ""
    parts: PartLimits = field(default_factory=PartLimits)
    bands: RatioBands = field(default_factory=RatioBands)
    context: ContextLimits = field(default_factory=ContextLimits)

    @classmethod
    def from_env(cls, env: dict, prefix: str = "QUIRE_") -> Run:
        """Texts are stripped; numbers that are not plain digits leave their defaults."""
        names = ("source", "source_lang", "target_lang", "source_name", "target_name", "genre")
        context = ContextLimits(**{n: _number(env, f"{prefix}CONTEXT_{n.upper()}", getattr(ContextLimits, n)) for n in ("budget", "translation_tail", "raw_tail", "glossary")})
        return cls(**{n: env.get(prefix + n.upper(), "").strip() for n in names}, parts=PartLimits.from_env(env, prefix), context=context)
