"""Model-backed steps behind small interfaces, with deterministic offline defaults."""

from postroom.providers.defaults import (  # noqa: F401
    CharTokenizer,
    HashEmbedder,
    PatternNer,
    Prompts,
    RuleClassifier,
    read_entities,
)
