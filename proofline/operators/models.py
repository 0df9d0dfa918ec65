"""Correctors behind a model."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field

from .correct import Corrector


@dataclass
class Seq2SeqCorrector:
    """A sequence-to-sequence model of the transformers library, loaded once a worker when the first text comes.
    It needs transformers and torch where the workers run. ``decoding`` goes to the model's generate."""

    model: str
    max_length: int = 256
    decoding: dict = field(default_factory=lambda: {"num_beams": 2, "repetition_penalty": 1.05})  # fixed values: the defaults of decoding
    device: str | None = None
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"{self.model}:{self.max_length}:{sorted(self.decoding.items())}"
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def _load(self):
        if self._loaded is None:
            import torch
            from transformers import AutoModelForSeq2SeqLM, AutoTokenizer

            device = self.device or ("cuda" if torch.cuda.is_available() else "cpu")
            self._loaded = AutoTokenizer.from_pretrained(self.model), AutoModelForSeq2SeqLM.from_pretrained(self.model).to(device), device
        return self._loaded

    def correct(self, texts: list[str]) -> list[str]:
        tokenizer, model, device = self._load()
        asked = tokenizer(texts, return_tensors="pt", padding=True, truncation=True, max_length=self.max_length).to(device)
        return tokenizer.batch_decode(model.generate(**asked, max_new_tokens=self.max_length, **self.decoding), skip_special_tokens=True)


def load_corrector(name: str, **settings) -> Corrector:
    """``module:factory`` called with the settings, or else the name of a sequence-to-sequence model."""
    if ":" in name:
        module, _, factory = name.partition(":")
        return getattr(importlib.import_module(module), factory)(**settings)
    return Seq2SeqCorrector(name, **settings)
