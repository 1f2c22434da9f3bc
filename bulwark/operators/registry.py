"""Named checks, configured bundles, and checks that ask a judge."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bulwark.errors import ConfigurationError
from bulwark.functions.regex import Rx
from bulwark.functions.result import result
from bulwark.operators import input_checks, output_checks
from bulwark.operators.check import Check, Scope
from bulwark.operators.mcp import host_of

#: Entities of the configured personal-data check.
ENTITIES = {
    "EMAIL_ADDRESS": Rx(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "PHONE_NUMBER": Rx(r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b"),
    "US_SSN": Rx(r"\b\d{3}-\d{2}-\d{4}\b"),
    "CREDIT_CARD": Rx(r"\b(?:\d{4}[\s-]?){3}\d{4}\b"),
    "CVV": Rx(r"\b\d{3,4}\b"),
    "IP_ADDRESS": Rx(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
}


@dataclass(frozen=True)
class Spec:
    """A check that can be configured by name."""

    name: str
    make: Callable[..., Check]
    description: str = ""
    stage: str = "input"
    fields: tuple[str, ...] = ()

    def configured(self, config: dict | None = None) -> Check:
        config = config or {}
        if unknown := set(config) - set(self.fields):
            raise ConfigurationError(f"{self.name}: unknown settings {sorted(unknown)}")
        return self.make(**config)


@dataclass
class Registry:
    specs: dict[str, Spec] = field(default_factory=dict)

    def register(self, spec: Spec) -> None:
        self.specs[spec.name] = spec

    def get(self, name: str) -> Spec:
        if name not in self.specs:
            raise ConfigurationError(f"no check named {name}")
        return self.specs[name]

    def has(self, name: str) -> bool:
        return name in self.specs

    def remove(self, name: str) -> bool:
        return self.specs.pop(name, None) is not None

    def names(self) -> list[str]:
        return [*self.specs]

    def metadata(self) -> list[dict]:
        return [{"name": s.name, "description": s.description, "stage": s.stage} for s in self.specs.values()]

    def bundle(self, config: dict | list | str | Path) -> list[Check]:
        """Checks of a bundle: a list of ``{name, config}``, ``{"guardrails": [...]}``, JSON text, or a JSON file."""
        return [self.get(g["name"]).configured(g.get("config")) for g in entries(load_config(config))]


def load_config(config: dict | list | str | Path) -> dict | list:
    if isinstance(config, dict | list):
        return config
    text = str(config)
    if text.endswith((".yaml", ".yml")):
        raise ConfigurationError("YAML is not read")
    if text.endswith(".json") or isinstance(config, Path):
        text = Path(text).read_text()
    try:
        return json.loads(text)
    except ValueError as e:
        raise ConfigurationError(f"invalid JSON: {e}") from e


def entries(config: dict | list) -> list[dict]:
    """The guardrails of a bundle, each with a name and a config."""
    rows = config.get("guardrails") if isinstance(config, dict) else config
    if not isinstance(rows, list):
        raise ConfigurationError("a list of guardrails is needed")
    for r in rows:
        if not isinstance(r, dict) or not isinstance(r.get("name"), str) or not isinstance(r.get("config", {}), dict):
            raise ConfigurationError(f"not a guardrail: {r!r}")
    return rows


def pipeline_errors(config: dict) -> list[str]:
    """What is wrong with a pipeline of stages; empty if nothing is."""
    out = []
    for stage, bundle in config.items():
        if stage not in ("version", "pre_flight", "input", "output"):
            out.append(f"unknown stage {stage}")
        elif stage != "version":
            try:
                entries(bundle)
            except ConfigurationError as e:
                out.append(f"{stage}: {e}")
    return out


def staged(config: dict, registry: Registry) -> tuple[list[Check], list[Check]]:
    """Input and output checks of a pipeline; names that are not registered are left out."""
    pick = lambda stage: [registry.get(g["name"]).configured(g.get("config")) for g in entries(config[stage]) if registry.has(g["name"])] if stage in config else []
    return pick("pre_flight") + pick("input"), pick("output")


def contains_pii(entities: list[str] | None = None, block: bool = False) -> Check:
    """Configured entities; triggers only when told to block."""
    chosen = {e: ENTITIES[e] for e in (entities or ENTITIES) if e in ENTITIES}

    def build(s: Scope) -> Column:
        counts = {e: rx.count(s.text) for e, rx in chosen.items()}
        found = F.concat_ws(",", *[F.when(n > 0, F.lit(e)) for e, n in counts.items()])
        return result("Contains PII", F.lit(block) & (found != ""), "high", F.concat(F.lit("PII found: "), found), entities=found)

    return Check("Contains PII", build)


def url_filter(require_tld: bool = True) -> Check:
    """URLs whose host can't be read, or has no dot."""

    def build(s: Scope) -> Column:
        hosts = F.transform(Rx(r"https?:\/\/[^\s]+", "i").all(s.text), host_of)
        bad = F.filter(hosts, lambda h: h.isNull() | (~F.contains(h, F.lit(".")) if require_tld else F.lit(False)))
        return result("URL Filter", F.size(bad) > 0, "medium", "Blocked URLs", blocked=F.size(bad))

    return Check("URL Filter", build)


def stub(name: str) -> Check:
    """A check that never triggers, for services that are not at hand."""
    return Check(name, lambda s: result(name, F.lit(False), checked="false"))


def verdict(reply: str | None, keywords: str | None) -> tuple[bool, float]:
    """Flag and confidence of a judge's JSON reply; an unreadable one is judged by keywords at 0.5, or passes."""
    try:
        got = json.loads(re.search(r"\{.*\}", reply or "", re.S)[0])
        return bool(got.get("flagged", got.get("confidence", 0) > 0)), float(got.get("confidence", 0.0))
    except (TypeError, ValueError):
        return (bool(keywords and re.search(keywords, reply or "", re.I)), 0.5) if keywords else (False, 0.0)


def judged(name: str, judge: Callable[[list[str]], list[str]] | None, threshold: float = 0.7, keywords: str | None = None) -> Check:
    """A check by a model: ``judge`` answers batches of texts; without one the check fails open."""

    def build(s: Scope) -> Column:
        if judge is None:
            return result(name, F.lit(False), "high", failed=F.lit(True), error="no judge")

        @F.pandas_udf("flagged boolean, confidence double")
        def ask(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([verdict(r, keywords) for r in judge(texts.fillna("").tolist())], columns=["flagged", "confidence"])

        v = ask(s.text)
        return result(name, v["flagged"] & (v["confidence"] >= threshold), "high", f"{name} flagged", confidence=v["confidence"])

    return Check(name, build)


def default_registry(judge: Callable[[list[str]], list[str]] | None = None) -> Registry:
    """The checks that configurations name."""
    out = Registry()
    for spec in (
        Spec("Contains PII", contains_pii, "personal data", "input", ("entities", "block")),
        Spec("URL Filter", url_filter, "odd URLs", "output", ("require_tld",)),
        Spec("Moderation", lambda: stub("Moderation"), "moderation service"),
        Spec("Hallucination Detection", lambda: stub("Hallucination Detection"), "retrieval service", "output"),
        Spec("length_limit", input_checks.length_limit, "length", "input", ("limit", "method", "severity")),
        Spec("blocked_words", input_checks.blocked_words, "words", "input", ("words", "allowed", "boundaries", "severity")),
        Spec("toxicity", input_checks.toxicity_detector, "toxic words", "input", ("threshold",)),
        Spec("sensitive_data", output_checks.sensitive_data, "sensitive data", "output"),
    ):
        out.register(spec)
    for name, keywords in (("Prompt Injection Detection", "inject|yes|true"), ("Jailbreak", "jailbreak|yes|true"), ("Off Topic Prompts", None), ("Custom Prompt Check", None), ("NSFW Text", "nsfw|yes|true")):
        out.register(Spec(name, lambda threshold=0.7, name=name, keywords=keywords: judged(name, judge, threshold, keywords), "asks a judge", "input", ("threshold",)))
    return out
