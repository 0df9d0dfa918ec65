"""Settings of a proofreading run. Immutable: a run can't leak its mode into the next."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

#: Names that an edit must not damage.
LEXICON = ("VietinBank", "LPBank", "InfinityFree", "Google", "Apple", "Android", "PayPal", "OpenAI", "Cần Thơ", "Ninh Kiều")


@dataclass(frozen=True)
class Thresholds:
    safe: float = 0.90
    review: float = 0.70
    aggressive: float = 0.50


@dataclass(frozen=True)
class SafetyRules:
    edit_ratio: float = 0.20
    length_delta_ratio: float = 0.30
    lexicon: tuple[str, ...] = LEXICON


@dataclass(frozen=True)
class Engine:
    mode: str = "safe"
    highlight: bool = True
    merge_mode: str = "soft-merge"
    apply_confidence_gate: bool = False
    #: Carried for settings files that have it; no revision marks are written.
    track_changes: bool = False


@dataclass(frozen=True)
class Hybrid:
    confidence_threshold: float = 0.85
    top_k: int = 5
    least_similarity: float = 70.0
    lexicon: tuple[str, ...] = LEXICON


@dataclass(frozen=True)
class Config:
    model: str | None = None
    max_words: int = 256
    batch_size: int = 4
    thresholds: Thresholds = field(default_factory=Thresholds)
    safety: SafetyRules = field(default_factory=SafetyRules)
    engine: Engine = field(default_factory=Engine)
    hybrid: Hybrid = field(default_factory=Hybrid)

    @classmethod
    def from_mapping(cls, found: dict[str, Any]) -> Config:
        """From the sections model, confidence, engine, diff_engine and hybrid of a settings file;
        what is absent keeps its default."""
        model, conf = found.get("model", {}), found.get("confidence", {})
        engine, diff, hybrid = found.get("engine", {}), found.get("diff_engine", {}), found.get("hybrid", {})
        base = cls()
        pick = lambda d, **names: {k: d[v] for k, v in names.items() if v in d}
        lexicon = lambda d: {"lexicon": tuple(d["user_lexicon"])} if "user_lexicon" in d else {}
        return dataclasses.replace(
            base,
            **pick(model, model="name", max_words="max_length", batch_size="batch_size"),
            thresholds=dataclasses.replace(base.thresholds, **pick(conf, safe="safe_threshold", review="review_threshold", aggressive="aggressive_threshold")),
            engine=dataclasses.replace(base.engine, **pick(engine, mode="mode", highlight="highlight_fallback", merge_mode="merge_mode", track_changes="track_changes")),
            safety=dataclasses.replace(base.safety, **pick(diff, edit_ratio="edit_ratio", length_delta_ratio="length_delta_ratio"), **lexicon(diff)),
            hybrid=dataclasses.replace(base.hybrid, **pick(hybrid, confidence_threshold="confidence_threshold"), **lexicon(hybrid)),
        )

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f) or {})
