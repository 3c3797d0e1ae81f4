"""Service adapters against fake services: the four families of answers, retries, bounds, refusals."""

from __future__ import annotations

import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postroom.functions.embedding import PayloadTooLarge, embedding_udf
from postroom.functions.language import detect_language
from postroom.plans import transform as plan
from postroom.plans.config import EngineConfig, Limits
from postroom.providers import service as sv
from postroom.providers.defaults import Prompts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fake:
    """Counts calls that run at once; fails each text's first calls; refuses large requests."""

    def __init__(self, fails=0, most_chars=10_000):
        self.fails, self.most_chars, self.seen, self.now, self.peak, self.calls = fails, most_chars, {}, 0, 0, 0
        self.lock = threading.Lock()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.lock = threading.Lock()

    def __call__(self, path, payload):
        with self.lock:
            self.calls += 1
            self.now += 1
            self.peak = max(self.peak, self.now)
        try:
            time.sleep(0.005)
            return self.answer(path, payload)
        finally:
            with self.lock:
                self.now -= 1

    def answer(self, path, payload):
        key = str(payload)
        with self.lock:
            self.seen[key] = self.seen.get(key, 0) + 1
        if self.seen[key] <= self.fails:
            raise ConnectionError("busy")
        if path == "/embed":
            if sum(map(len, payload["inputs"])) > self.most_chars:
                raise PayloadTooLarge
            return [[float(len(t)), 1.0] for t in payload["inputs"]]
        if path == "/tokenize":
            return [payload["inputs"][0].split()]
        if path == "/ner":
            shapes = {"l": lambda e: e, "e": lambda e: {"entities": e}, "x": lambda e: {"extractions": e}, "n": lambda e: {"ents": e}}
            return shapes[payload["text"][0]]([{"start_char": 1, "end_char": 3, "entity": "person"}, "odd"])
        if path == "/detect":
            known = {"bonjour": {"language": "fr_FR", "confidence": 0.9}, "unsure": {"language": "de", "confidence": 0.2}, "none": None}
            return {"predictions": [known[payload["text"]]] if known[payload["text"]] else []}
        user = payload["messages"][1]["content"]
        if "broken" in user:
            return {"choices": []}
        assert payload["messages"][0]["role"] == "system" and payload["seed"] == 42 and not user.startswith(payload["messages"][0]["content"])
        return {"choices": [{"message": {"content": " SENSITIVE\n" if "my password is" in user else "PUBLIC"}}]}


def test_calls_at_once_are_bounded_and_repeated():
    fake = Fake(fails=2)
    found = sv.Service(fake, in_flight=3, pause_seconds=0.001).ask_all("/tokenize", [{"inputs": [f"a b{i}"]} for i in range(20)], lambda a: len(a[0]))
    assert found == [(2, None)] * 20 and 1 < fake.peak <= 3 and fake.calls == 60
    hopeless = sv.Service(Fake(fails=9), tries=2, pause_seconds=0.001)
    (answer, error), = hopeless.ask_all("/tokenize", [{"inputs": ["a"]}], len)
    assert answer is None and isinstance(error, ConnectionError)


def test_embedder_splits_what_is_refused(spark):
    embedder = sv.ServiceEmbedder(sv.Service(Fake(fails=1, most_chars=700), pause_seconds=0.001), dim=2)
    rows = [(1, ["a" * 300, "b" * 300, "c" * 300]), (2, ["d" * 2000]), (3, [])]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    got = {r.id: r.e for r in df.select("id", embedding_udf(embedder)(F.col("texts")).alias("e")).collect()}
    assert [v[0] for v in got[1].vectors] == [300.0] * 3 and got[2].vectors == [[500.0, 1.0]] and got[3].vectors == []
    assert all(r.problem is None for r in got.values())
    with pytest.raises(sv.BadAnswer):
        sv.ServiceEmbedder(sv.Service(lambda *_: {"error": 1})).open()(["a"])


def test_tokens_entities_and_languages(spark, column):
    quick = sv.Service(Fake(), pause_seconds=0.001)
    assert sv.ServiceTokenizer(quick).open()("a b c") == ["a", "b", "c"] and sv.ServiceTokenizer(quick).open()("") == []
    find = sv.ServiceNer(quick).open()
    assert [find(t) for t in ("list", "ents", "x", "n")] == [[{"start": 1, "end": 3, "label": "PERSON"}]] * 4
    language = sv.ServiceLanguage(sv.Service(Fake(fails=1), pause_seconds=0.001))
    assert column(["bonjour", "unsure", "none", " ", None, " bonjour"], detect_language(F.col("v"), language)) == ["fr", "en", "en", "en", "en", "fr"]


def test_a_transform_through_services(spark):
    service = sv.Service(Fake(), pause_seconds=0.001, tries=2)
    row = lambda i, body: (i, 1, body, "s", "a@b.c", "A", ["x"], "", False)
    kinds = "id long, account_id int, body_text string, subject string, from_email string, from_name string, labels array<string>, snippet string, has_attachments boolean"
    mails = spark.createDataFrame([row(1, "my password is x"), row(2, "weekly news"), row(3, "broken answer")], kinds)
    config = EngineConfig(limits=Limits(), dim=2, embedder=sv.ServiceEmbedder(service, dim=2), classifier=sv.ServiceClassifier(service, "m", Prompts.load()))
    got = {r.id: r for r in plan.transform(mails, config).collect()}
    assert (got[1].privacy_tier, got[2].privacy_tier, got[1].problem, got[2].problem) == (1, 3, None, None)
    assert got[2].body_embedding == [11.0, 1.0] and "parse tier" in got[3].problem and got[3].body_embedding is None
