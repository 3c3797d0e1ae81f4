"""Limits and providers of an engine; nothing in here touches data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from postroom import fixed_values as fv
from postroom.providers import CharTokenizer, HashEmbedder, Prompts, RuleClassifier


@dataclass(frozen=True)
class Limits:
    """Input limits of the model services, as probed or as defaults."""

    embed_max_tokens: int = fv.EMBED_MAX_TOKENS
    embed_max_chars: int = fv.EMBED_MAX_CHARS
    classify_max_tokens: int = 8192
    classify_max_chars: int = fv.CLASSIFY_MAX_CHARS
    chunk_target_tokens: int = fv.CHUNK_TARGET_TOKENS
    #: Largest body, subject and sender (characters) and label list that are classified at all.
    #: No limit by default: the classifier sees a bounded preview anyway, and no mail is left out.
    input_most: tuple[int | None, int | None, int | None, int | None] = (None, None, None, None)

    #: Texts over the embedder's limits: ``parts`` embeds all of it in parts and averages their vectors
    #: by length, ``prefix`` embeds as much as fits (the service contract).  ``vector_covers`` tells.
    long_texts: str = "parts"

    @property
    def prompt_tokens(self) -> int:
        return max(0, self.classify_max_tokens - fv.PROMPT_RESERVE_TOKENS)

    @property
    def context_chars(self) -> int:
        """Nine tenths of the classifier's context, in characters."""
        return int(self.classify_max_tokens * fv.CHARS_PER_TOKEN * 0.9)

    @classmethod
    def from_capabilities(cls, data: dict[str, Any]) -> Limits:
        """Out of a capabilities document; missing numbers keep their defaults."""
        embed, model = data.get("embedding") or {}, data.get("vllm") or {}

        def number(v, default: int) -> int:
            return int(v) if isinstance(v, (int, float)) else default

        base = cls()
        context = number(model.get("max_model_len"), base.classify_max_tokens)
        chars = data.get("classify_body_max_chars")
        return cls(
            embed_max_tokens=number(embed.get("max_tokens"), base.embed_max_tokens),
            embed_max_chars=number(embed.get("max_chars"), base.embed_max_chars),
            classify_max_tokens=context,
            classify_max_chars=number(
                chars, min(fv.CLASSIFY_MAX_CHARS, context * fv.CHARS_PER_TOKEN // 2)
            ),
        )

    @classmethod
    def load(cls, path: str | Path) -> Limits:
        p = Path(path)
        return cls.from_capabilities(json.loads(p.read_text())) if p.exists() else cls()


REQUIRED_CAPABILITIES = (
    ("embedding", "max_tokens"),
    ("vllm", "model_id"),
    ("vllm", "max_model_len"),
    ("spacy_api", "available"),
    ("fasttext_langdetect", "available"),
)


def missing_capabilities(data: dict[str, Any]) -> list[str]:
    """What a transform with real model services would still lack."""
    return [
        f"{group}.{name}"
        for group, name in REQUIRED_CAPABILITIES
        if not (data.get(group) or {}).get(name)
    ]


def capabilities_document(
    embed_info: dict | None,
    models: dict | None,
    entities_available: bool,
    languages_available: bool,
    largest_accepted: int | None = None,
) -> dict[str, Any]:
    """Capabilities out of service answers.

    ``embed_info`` is the embedder's description; where it names no input length,
    ``largest_accepted`` (the largest accepted probe of EMBED_PROBE_SIZES) decides.
    The classifier's context is the largest that any listed model reports.
    """
    embed: dict[str, Any] = {"max_tokens": None, "max_chars": None, "source": None, "model_id": None}
    length = (embed_info or {}).get("max_input_length")
    if length is not None:
        embed.update(
            max_tokens=int(length),
            max_chars=int(length) * fv.CHARS_PER_TOKEN,
            source="TEI /info",
            model_id=embed_info.get("model_id"),
        )
    elif largest_accepted is not None:
        embed.update(
            max_tokens=largest_accepted // fv.CHARS_PER_TOKEN,
            max_chars=largest_accepted,
            source="probe",
        )
    listed = [m for m in (models or {}).get("data") or [] if isinstance(m, dict)]
    sizes = []
    for holder, keys in [*((m, ("max_model_len", "context_length")) for m in listed),
                         (models or {}, ("max_model_len",))]:
        for key in keys:
            if str(holder.get(key, "")).isdigit():
                sizes.append(int(holder[key]))
    context = max(sizes, default=None)
    out = {
        "embedding": embed,
        "vllm": {
            "max_model_len": context,
            "source": "v1/models" if context else None,
            "model_id": listed[0].get("id") if listed else None,
        },
        "spacy_api": {"available": entities_available},
        "fasttext_langdetect": {"available": languages_available},
    }
    if context is not None:
        out["classify_body_max_chars"] = min(
            fv.CLASSIFY_MAX_CHARS_CAP, context * fv.CHARS_PER_TOKEN // 2
        )
    return out


@dataclass(frozen=True)
class EngineConfig:
    limits: Limits = field(default_factory=Limits)
    dim: int = fv.EMBEDDING_DIM
    default_account: int | None = None
    tokenizer: Any = field(default_factory=CharTokenizer)
    embedder: Any = None
    ner: Any = None
    #: Redaction takes only ASCII letters, digits and underscores for parts of a word (see ``redaction.redact_pii``).
    ascii_edges: bool = False
    language: Any = None
    classifier: Any = field(default_factory=RuleClassifier)
    prompts: Prompts = field(default_factory=Prompts.load)
    fusion_weights: dict[str, float] | None = None
    fusion_rule: str = "weighted"

    def __post_init__(self):
        if self.embedder is None:
            object.__setattr__(self, "embedder", HashEmbedder(self.dim))

    def with_(self, **changes) -> EngineConfig:
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})
