"""Thresholds of matching and learning, with the order they must keep."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

import yaml


@dataclass(frozen=True)
class Thresholds:
    auto_accept: float = 0.93
    review: float = 0.75
    disagreement_cap: float = 0.84
    margin: float = 0.05
    ood: float = 0.50
    vendor_boost: float = 0.02
    decay_days: int = 180
    decay_lambda: float = 0.10
    decay_floor: float = 0.90
    min_confirmations: int = 3
    max_collisions: int = 2
    cooldown_days: int = 7
    dual_gate_margin: float = 0.06
    daily_cap: int = 20
    cluster_similarity: float = 0.85
    cluster_min_size: int = 2
    top_k: int = 5

    def problems(self) -> list[str]:
        """What is wrong with the values; empty if nothing is."""
        found = [f"{f.name} must lie in [0, 1]" for f in fields(self) if f.type == "float" and not 0 <= getattr(self, f.name) <= 1]
        if not self.ood < self.review < self.disagreement_cap < self.auto_accept:
            found.append("ood < review < disagreement_cap < auto_accept does not hold")
        if self.dual_gate_margin < self.margin:
            found.append("dual_gate_margin is below margin")
        return found

    def merged(self, **changes: float) -> Thresholds:
        """A checked copy with ``changes``."""
        out = replace(self, **changes)
        if problems := out.problems():
            raise ValueError("; ".join(problems))
        return out

    @classmethod
    def load(cls, text: str, **overrides: float) -> Thresholds:
        """From YAML text, explicit values first, then the file's, then defaults."""
        held = yaml.safe_load(text) or {}
        flat = {k: v for part in held.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in held.items() if not isinstance(v, dict)}
        return cls().merged(**({k: v for k, v in flat.items() if k in cls.__dataclass_fields__} | overrides))

    def dump(self) -> str:
        return yaml.safe_dump(asdict(self), sort_keys=False)
