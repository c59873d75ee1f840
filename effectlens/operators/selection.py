"""Feature roles from name patterns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

ROLES = ("continuous", "ordinal", "nominal")


class FeatureConflictError(ValueError):
    """Columns that more than one role claims."""


class NoFeaturesError(ValueError):
    pass


def matches(column: str, pattern: str, mode: str) -> bool:
    """exact, prefix and suffix as named; any other mode, as substring, looks for the pattern anywhere."""
    tests = {"exact": column.__eq__, "prefix": column.startswith, "suffix": column.endswith}
    return tests.get(mode, column.__contains__)(pattern)


@dataclass
class FeatureSelector:
    """Rules by role, as ``continuous_groups``, ``ordinal_groups`` and ``nominal_groups`` (or the bare roles) list them.

    Each has a ``pattern`` (or a list of them), a ``match_mode`` (or ``mode``; substring unless given), parts of
    names to ``exclude``, and for ordinals the ``levels``; of several rules for a column the first one's levels count.
    """

    rules: dict[str, list[dict]]
    roles: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list] = field(default_factory=dict)

    def fit(self, columns: Iterable[str], outcomes: Iterable[str] = (), keys: Iterable[str] = ()) -> FeatureSelector:
        left = [c for c in columns if c not in {*outcomes, *keys}]
        claims: dict[str, list[str]] = {}
        self.levels = {}
        for role in ROLES:
            for rule in [*(self.rules.get(f"{role}_groups") or []), *(self.rules.get(role) or [])]:
                patterns = rule.get("pattern", rule.get("patterns", []))
                patterns = [patterns] if isinstance(patterns, str) else patterns
                for c in left:
                    if any(x in c for x in rule.get("exclude") or []):
                        continue
                    if any(matches(c, p, rule.get("match_mode", rule.get("mode", "substring"))) for p in patterns):
                        claims.setdefault(c, []).append(role)
                        if role == "ordinal" and "levels" in rule:
                            self.levels.setdefault(c, rule["levels"])
        torn = {c: sorted(set(r)) for c, r in claims.items() if len(set(r)) > 1}
        if torn:
            raise FeatureConflictError("; ".join(f"{c}: {', '.join(r)}" for c, r in sorted(torn.items())))
        self.roles = {c: claims[c][0] for c in sorted(claims)}
        if not self.roles:
            raise NoFeaturesError("no column matches any feature rule")
        return self

    def features(self, role: str) -> list[str]:
        return sorted(c for c, r in self.roles.items() if r == role)

    def lists(self) -> tuple[list[str], list[str], list[str]]:
        return tuple(self.features(r) for r in ROLES)
