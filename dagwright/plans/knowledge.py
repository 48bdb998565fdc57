"""Prior knowledge: tiers of variables, forbidden and required edges."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass
class Knowledge:
    tiers: list[list[str]] = dataclasses.field(default_factory=list)
    forbidden_within: list[bool] = dataclasses.field(default_factory=list)
    forbidden: set[tuple[str, str]] = dataclasses.field(default_factory=set)
    required: set[tuple[str, str]] = dataclasses.field(default_factory=set)

    def __post_init__(self):
        self.forbidden, self.required = set(map(tuple, self.forbidden)), set(map(tuple, self.required))
        if any(len(p) != 2 for p in self.forbidden | self.required):
            raise ValueError("forbidden and required edges are pairs")
        if both := self.forbidden & self.required:
            raise ValueError(f"both forbidden and required: {sorted(both)}")
        self.forbidden_within = list(self.forbidden_within) or [False] * len(self.tiers)
        if len(self.forbidden_within) != len(self.tiers):
            raise ValueError("forbidden_within has one value for each tier")
        self.tier = {}
        for i, t in enumerate(self.tiers):
            for v in t:
                if v in self.tier:
                    raise ValueError(f"{v} is in two tiers")
                self.tier[v] = i

    def check(self, nodes: list[str]) -> None:
        if self.tiers and (missing := set(nodes) - self.tier.keys()):
            raise ValueError(f"in no tier: {sorted(missing)}")

    def is_forbidden(self, a: str, b: str) -> bool:
        if (a, b) in self.forbidden:
            return True
        if not self.tiers or a not in self.tier or b not in self.tier:
            return False
        return self.tier[a] > self.tier[b] or self.tier[a] == self.tier[b] and self.forbidden_within[self.tier[a]]

    def is_required(self, a: str, b: str) -> bool:
        return (a, b) in self.required

    def no_edge_required(self, a: str, b: str) -> bool:
        return not (self.is_required(a, b) or self.is_required(b, a))

    def __str__(self) -> str:
        return "\n".join([*(f"Tier {i + 1}: {' '.join(t)}" + " (no edges within)" * f for i, (t, f) in enumerate(zip(self.tiers, self.forbidden_within, strict=True))), f"Forbidden: {sorted(self.forbidden)}", f"Required: {sorted(self.required)}"])
