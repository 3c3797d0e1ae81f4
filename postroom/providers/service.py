"""Model services behind the provider interfaces: embedding, tokens, entities, language, tiers.

``post(path, payload)`` is injected and picklable; it returns the decoded answer and raises
``PayloadTooLarge`` for a request that is bigger than the service takes.  Calls run in tasks, so many at
once per task as ``in_flight`` allows, and are repeated with growing pauses; a row whose call fails for
good carries no answer and leaves the others alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.embedding import PayloadTooLarge
from postroom.providers.defaults import Prompts, read_entities

PREDICTION = "struct<language:string,confidence:double>"


class BadAnswer(ValueError):
    """An answer of an unexpected shape: asking again would not help."""


@dataclass(frozen=True)
class Service:
    """``in_flight`` calls of a task at once; ``tries`` per call, each pause twice the one before."""

    post: Callable[[str, dict], Any]
    in_flight: int = 4
    tries: int = 4
    pause_seconds: float = 0.5

    def ask(self, path: str, payload: dict) -> Any:
        for n in range(self.tries):
            try:
                return self.post(path, payload)
            except (PayloadTooLarge, BadAnswer):
                raise
            except Exception:
                if n + 1 == self.tries:
                    raise
                time.sleep(self.pause_seconds * 2**n)

    def ask_all(self, path: str, payloads: Iterator[dict] | list[dict], read: Callable[[Any], Any]) -> list[tuple[Any, Exception | None]]:
        """(answer read, None) or (None, error) per payload, in their order."""

        def one(payload: dict) -> tuple[Any, Exception | None]:
            try:
                return read(self.ask(path, payload)), None
            except Exception as e:
                return None, e

        with ThreadPoolExecutor(self.in_flight) as pool:
            return list(pool.map(one, payloads))

    def column(self, c: Column, path: str, payload: Callable[[str], dict], read: Callable[[Any], Any], kind: str) -> Column:
        """One call per text, equal texts of a batch once; null where there is no text or no answer."""

        @F.arrow_udf(kind)
        def answers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                asked = list(dict.fromkeys(t for t in texts.to_pylist() if t is not None))
                found = dict(zip(asked, (a for a, _ in self.ask_all(path, [payload(t) for t in asked], read)), strict=True))
                arrow = pa.string() if kind == "string" else pa.struct([("language", pa.string()), ("confidence", pa.float64())])
                yield pa.array([found.get(t) for t in texts.to_pylist()], arrow)

        return answers(c)


@dataclass(frozen=True)
class ServiceEmbedder:
    """Vectors of ``batch`` texts a request.  A refused request is split by the caller, down to halves of a text."""

    service: Service
    dim: int = fv.EMBEDDING_DIM
    batch: int = 4

    def open(self) -> Callable[[list[str]], list]:
        def read(answer: Any) -> list:
            if not isinstance(answer, list) or not all(isinstance(v, list) for v in answer):
                raise BadAnswer("the embedder's answer is no list of vectors")
            return answer

        def embed(texts: list[str]) -> list:
            parts = [texts[at : at + self.batch] for at in range(0, len(texts), self.batch)]
            made = self.service.ask_all(fv.EMBED_PATH, [{"inputs": p} for p in parts], read)
            for _, error in made:
                if error is not None:
                    raise error
            for part, (vectors, _) in zip(parts, made, strict=True):
                if len(vectors) != len(part):
                    raise BadAnswer(f"{len(vectors)} vectors for {len(part)} texts")
            return [v for vectors, _ in made for v in vectors]

        return embed


@dataclass(frozen=True)
class ServiceTokenizer:
    service: Service
    length_based = False

    def open(self) -> Callable[[str], list]:
        def encode(text: str) -> list:
            answer = self.service.ask(fv.TOKENIZE_PATH, {"inputs": [text]}) if text else []
            if isinstance(answer, list) and answer and isinstance(answer[0], list):
                answer = answer[0]
            if not isinstance(answer, list) or any(isinstance(t, list) for t in answer):
                raise BadAnswer("the tokenizer's answer is no list of tokens")
            return answer

        return encode


@dataclass(frozen=True)
class ServiceNer:
    service: Service

    def open(self) -> Callable[..., list[dict]]:
        def find(text: str, lang: str = "en") -> list[dict]:
            return read_entities(self.service.ask(fv.NER_PATH, {"text": text, "lang": (lang or "en")[:10]}))

        return find


@dataclass(frozen=True)
class ServiceLanguage:
    """A prediction per text, for ``EngineConfig.language``; the rules on it are those of ``detect_language``."""

    service: Service

    def __call__(self, text: Column) -> Column:
        def read(answer: Any) -> dict | None:
            first = next(iter((answer or {}).get("predictions") or []), None)
            if not isinstance(first, dict):
                return None
            sure = first.get("confidence")
            return {"language": first.get("language"), "confidence": float(sure) if isinstance(sure, (int, float)) else None}

        asked = F.trim(text)
        return self.service.column(F.when(asked != "", asked), fv.DETECT_PATH, lambda t: {"text": t, "k": 1}, read, PREDICTION)


@dataclass(frozen=True)
class ServiceClassifier:
    """The raw text of a chat model; its tier is read by ``parse_tier``, no answer is a problem of the row."""

    service: Service
    model: str
    prompts: Prompts

    def answer(self, sender: Column, subject: Column, body: Column, prompt: Column) -> Column:
        system, settings = self.prompts.system, {"model": self.model, **fv.CHAT_SETTINGS}

        def payload(text: str) -> dict:
            parts = [("system", system), ("user", text.removeprefix(system).lstrip("\n"))]
            return {**settings, "messages": [{"role": r, "content": c} for r, c in parts]}

        def read(answer: Any) -> str:
            try:
                return answer["choices"][0]["message"]["content"].strip()
            except (KeyError, IndexError, TypeError, AttributeError) as e:
                raise BadAnswer("the chat model's answer has no content") from e

        return self.service.column(prompt, fv.CHAT_PATH, payload, read, "string")
