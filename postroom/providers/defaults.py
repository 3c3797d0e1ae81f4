"""Offline defaults.

A provider is any object with the same attributes:

* tokenizer: ``length_based``; either ``count_column(Column)`` and
  ``count_length(Column)``, or ``open() -> callable(text) -> list`` (per worker)
* embedder: ``dim`` and ``open() -> callable(list[str]) -> list of vectors``; where some texts
  have the zero vector by design, ``has_vector(Column)`` tells the others
* ner: ``open() -> callable(text, lang) -> list[{start, end, label}]``
* classifier: ``answer(DataFrame column dict) -> Column`` holding the raw model text; with
  ``whole_bodies`` it is given the body itself in place of the preview that fits a prompt
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.tiering import rule_based_answer


class CharTokenizer:
    """Four characters per token, rounded up."""

    length_based = True

    def count_length(self, length: Column) -> Column:
        return F.ceil(length / fv.CHARS_PER_TOKEN).cast("int")

    def count_column(self, c: Column) -> Column:
        return self.count_length(F.length(c))

    def open(self):
        """A row form whose result has as many items as the text has tokens."""
        return lambda text: range(-(-len(text) // fv.CHARS_PER_TOKEN))


@lru_cache(maxsize=200_000)
def _slot(token: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim


class HashEmbedder:
    """Feature hashing of lower-cased tokens, L2-normalised.

    MD5 keeps the vectors equal across processes, machines and engines.
    """

    _token = re.compile(r"[^\W_]+")

    def __init__(self, dim: int = fv.EMBEDDING_DIM):
        self.dim = dim

    def open(self):
        return self.embed

    def has_vector(self, text: Column) -> Column:
        """A text without tokens, such as a line of dashes, has the zero vector."""
        return text.rlike(r"[\p{L}\p{N}]")

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        slots = [_slot(t, self.dim) for t in self._token.findall(text.lower())]
        vector = np.bincount(slots, minlength=self.dim).astype(np.float64)
        return vector / np.linalg.norm(vector) if slots else vector


def read_entities(answer) -> list[dict]:
    """Entities out of any of the accepted response shapes."""
    if isinstance(answer, dict):
        answer = next((answer[k] for k in fv.ENTITY_LIST_KEYS if answer.get(k)), [])
    raw = [e for e in answer or [] if isinstance(e, dict)]

    def pick(entity: dict, keys: tuple[str, ...]):
        # A plain "start"/"end" counts even at zero; its aliases count only when non-zero.
        if keys[0] in entity:
            return entity[keys[0]]
        return next((entity[k] for k in keys[1:] if entity.get(k)), None)

    out = []
    for e in raw:
        start, end = pick(e, fv.ENTITY_START_KEYS), pick(e, fv.ENTITY_END_KEYS)
        label = next((e[k] for k in fv.ENTITY_LABEL_KEYS if e.get(k)), None)
        if start is not None and end is not None and label is not None:
            out.append({"start": int(start), "end": int(end), "label": str(label).upper()})
    return out


class PatternNer:
    """Titles, company suffixes and a place list; keeps the span contract of a model."""

    places = ("Berlin", "London", "Madrid", "Paris", "France", "Germany", "Spain", "China",
              "India", "Japan", "Canada", "Brazil", "Egypt", "Kenya", "Peru")
    _rules = (
        ("PERSON", re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? ((?:[A-Z][\w'-]+ ?){1,3}(?<! ))")),
        ("ORG", re.compile(r"\b((?:[A-Z][\w&-]+ ){1,3}(?:Inc|Ltd|LLC|GmbH|Corp))\b")),
        ("GPE", re.compile(r"\b(" + "|".join(places) + r")\b")),
    )

    def open(self):
        return self.find

    def find(self, text: str, lang: str = "en") -> list[dict]:
        return [
            {"start": m.start(1), "end": m.end(1), "label": label}
            for label, rule in self._rules
            for m in rule.finditer(text)
        ]


class RuleClassifier:
    """Answers with the tier word that the ordered rules give."""

    whole_bodies = True

    def answer(self, sender: Column, subject: Column, body: Column, prompt: Column) -> Column:
        return rule_based_answer(sender, subject, body)


@dataclass(frozen=True)
class Prompts:
    system: str
    user_template: str

    @classmethod
    def load(cls, directory: str | Path | None = None) -> Prompts:
        """Templates from ``directory``, else those shipped with the package."""
        base = Path(directory) if directory else Path(__file__).resolve().parent.parent / "prompts"
        system = (base / "classification_system.md").read_text(encoding="utf-8").strip()
        user = (base / "classification_user.md").read_text(encoding="utf-8")
        return cls(system, user if user.endswith("\n") or not user else user + "\n")
