"""Driver-side settings. They become literals in the plan, never tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType

EXACT, TEMPORAL, SKU = "deterministic_id", "temporal_proximity", "sku_overlap"

# Default recipe weights.
DEFAULT_WEIGHTS = {EXACT: 1.0, TEMPORAL: 0.5, SKU: 0.8}

STRICT, PASSTHROUGH = "strict", "passthrough"


class SettingsError(ValueError):
    pass


def _in_unit(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise SettingsError(f"{name} must lie in [0, 1], got {value:.2f}")


@dataclass(frozen=True)
class Recipe:
    """How evidence is weighed. ``None`` takes the default; an explicit 0 is kept as 0. Notes are whole unless ``note_limit`` is given."""

    name: str = "default"
    version: str = "v1"
    weights: dict[str, float] | None = None
    threshold: float | None = None
    window_sec: int | None = None
    sku_overlap_min: float | None = None
    note_limit: int | None = None
    checked: bool = field(default=True, repr=False)

    def __post_init__(self) -> None:
        defaults = {"weights": DEFAULT_WEIGHTS, "threshold": 0.8, "window_sec": 3600, "sku_overlap_min": 0.5}
        for key, value in defaults.items():
            if getattr(self, key) is None:
                object.__setattr__(self, key, value)
        object.__setattr__(self, "weights", MappingProxyType(dict(self.weights)))
        if self.checked:
            self.validate()

    def validate(self) -> None:
        if not self.name:
            raise SettingsError("recipe name must not be empty")
        if not self.version:
            raise SettingsError("recipe version must not be empty")
        _in_unit("threshold", self.threshold)
        _in_unit("sku_overlap_min", self.sku_overlap_min)
        if self.window_sec < 0:
            raise SettingsError(f"window_sec must not be negative, got {self.window_sec}")
        if self.note_limit is not None and self.note_limit < 4:
            raise SettingsError(f"note_limit must be 4 or more, got {self.note_limit}")
        for matcher, weight in self.weights.items():
            if weight < 0:
                raise SettingsError(f"weight of {matcher!r} must not be negative, got {weight:.2f}")

    @property
    def label(self) -> str:
        return f"{self.name}/{self.version}"

    def weight(self, matcher: str) -> float:
        return self.weights.get(matcher, 0.0)


@dataclass(frozen=True)
class Privacy:
    """Identifier handling. The salt is never printed."""

    salt: bytes = field(default=b"", repr=False)
    id_mode: str = STRICT
    allow_passthrough_export: bool = False
    trusted_endpoints: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.id_mode not in (STRICT, PASSTHROUGH):
            raise SettingsError(f"id mode must be {STRICT!r} or {PASSTHROUGH!r}, got {self.id_mode!r}")
        if self.id_mode == STRICT and not self.salt:
            raise SettingsError("strict id mode needs a salt")


@dataclass(frozen=True)
class RetryPolicy:
    """Capped exponential waits: base * 2^attempt, at most ``max_wait`` seconds."""

    max_attempts: int = 5
    base_wait: float = 2.0
    max_wait: float = 30.0

    def wait(self, attempt: int) -> float:
        return min(self.base_wait * 2.0**attempt, self.max_wait)
