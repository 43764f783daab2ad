"""Rule packs: relations of patterns, and how they become Catalyst expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import fixed_values as V


@dataclass(frozen=True)
class Rule:
    no: int
    category: str
    severity: str
    pattern: str
    explanation: str
    detector: str = ""
    confidence: float = 0.95

    @property
    def java(self) -> str:
        """The pattern with Unicode classes, as its authors' dialect has them."""
        p = self.pattern
        return "(?iU)" + p[4:] if p.startswith("(?i)") else "(?U)" + p

    @property
    def group(self) -> int:
        return min(1, re.compile(self.pattern).groups)


def _pack(rows, detector: str, confidence: float) -> tuple[Rule, ...]:
    return tuple(Rule(i, r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else detector, confidence) for i, r in enumerate(rows))


PII = _pack(V.PII, "pii_regex", 0.95)
INJECTION = _pack(V.INJECTION, "prompt_injection", 0.95)
FINANCE = _pack([(c, s, p.replace("{S}", "|".join(V.SYMBOLS)), e) for c, s, p, e in V.FINANCE], "finance_intent", 0.90)
TOXIC = _pack(V.TOXIC, "toxicity", 0.98)
PACKS = {"pii": PII, "injection": INJECTION, "finance": FINANCE, "toxic": TOXIC}
SEVERITIES = ("low", "medium", "high", "critical")


def union_pattern(patterns, flags: str = "(?iU)") -> str:
    """One alternation of many patterns that share their flags; the pack's prefilter."""
    return flags + "|".join(f"(?:{p[4:] if p.startswith('(?i)') else p})" for p in patterns)
