"""A check: a named builder of a result column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.functions.result import SEVERITIES


@dataclass(frozen=True)
class Scope:
    """The columns that a check may read; absent ones are null."""

    text: Column
    system: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    output: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    total_tokens: Column = field(default_factory=lambda: F.lit(None).cast("long"))
    generation_ms: Column = field(default_factory=lambda: F.lit(0.0))
    finish_reason: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    tools: Column = field(default_factory=lambda: F.array().cast("array<string>"))
    payloads: Column = field(default_factory=lambda: F.array().cast("array<struct<tool_name:string,args_text:string>>"))
    permissions: Column = field(default_factory=lambda: F.array().cast("array<string>"))

    @property
    def lower(self) -> Column:
        return F.lower(self.text)


@dataclass(frozen=True)
class Check:
    """What a guardrail is here; ``priority`` orders results, disabled checks never enter a plan."""

    name: str
    build: Callable[[Scope], Column]
    priority: str | None = None
    enabled: bool = True
    description: str = ""
    version: str = "1.0.0"
    tags: tuple[str, ...] = ()

    def __call__(self, scope: Scope) -> Column:
        return self.build(scope)


def prepared(checks: list[Check]) -> list[Check]:
    """Enabled checks, the highest priority first, equals in the order given."""
    return sorted((c for c in checks if c.enabled), key=lambda c: -SEVERITIES.index(c.priority or "medium"))
