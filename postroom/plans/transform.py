"""The transform: clean, classify, redact, chunk, embed, pool, validate.

One map-only DataFrame chain: every step is a column of the same row, so there is no
shuffle between reading emails and writing results.  A row that fails carries its
reason in ``problem`` and leaves all other rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions import chunking, language, redaction, text, tiering, tokens, vectors
from postroom.functions.embedding import embedding_udf
from postroom.functions.headers import display_sender
from postroom.operators.filters import needs_transform
from postroom.plans.config import EngineConfig

RESULT_COLUMNS = (
    "id", "privacy_tier", "body_redacted", "snippet_redacted", "subject_embedding",
    "body_embedding", "body_pooled_embedding", "chunks", "body_kind", "lang", "problem", "vector_covers",
)


def worklist(
    emails: DataFrame,
    account_id: int | None = None,
    email_id: int | None = None,
    force: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Rows to transform; with a limit the lowest ids first."""
    todo = emails.where(needs_transform(account_id, email_id, force))
    if limit is None or email_id is not None:
        return todo
    # Only ids are sorted; the wide rows are picked by a semi-join afterwards.
    chosen = todo.select("id").orderBy("id").limit(limit)
    return todo.join(chosen, "id", "left_semi")


def prepare(emails: DataFrame, config: EngineConfig) -> DataFrame:
    """Everything before embedding: tier, language, redacted texts, texts to embed.

    ``labels`` must already hold display names.
    """
    lim, tok = config.limits, config.tokenizer
    body, subject = F.col("body_text"), F.coalesce("subject", F.lit(""))
    cleaned = emails.withColumns(
        {
            "clean": text.clean_body(body),
            "sender": display_sender(F.col("from_name"), F.col("from_email")),
            "prompt_body": text.strip(F.coalesce(body, F.lit(""))),
        }
    )

    def values(preview):
        return tiering.prompt_values(
            tiering.normalized_sender(F.col("sender")),
            text.strip(subject),
            preview,
            F.coalesce("has_attachments", F.lit(False)),
            F.coalesce("labels", F.array().cast("array<string>")),
        )

    prompted = (
        cleaned.withColumn("frame", tiering.full_prompt(config.prompts, values(F.lit(""))))
        .withColumn(
            "preview",
            F.when(F.col("prompt_body") == "", F.lit("")).otherwise(
                tiering.fit_body(F.col("prompt_body"), F.col("frame"), tok, lim.prompt_tokens)
            ),
        )
        .withColumn("prompt", tiering.full_prompt(config.prompts, values(F.col("preview"))))
    )
    # Rules have no context to fill, so they see the body as a whole.
    seen = F.col("prompt_body") if getattr(config.classifier, "whole_bodies", False) else F.col("preview")
    # A column of its own: the parser reads it many times, and would repeat an inlined answer.
    asked = prompted.withColumn(
        "answer_text",
        config.classifier.answer(
            tiering.normalized_sender(F.col("sender")), subject, seen, F.col("prompt")
        ),
    )
    answered = asked.withColumns(
        {
            "tier_word": tiering.parse_tier(F.col("answer_text")),
            "lang": language.detect_language(
                F.col("clean"), config.language or language.predict_by_stop_words
            ),
            "input_problem": F.coalesce(
                tiering.input_problem(
                    subject,
                    F.coalesce(body, F.lit("")),
                    F.col("sender"),
                    F.coalesce("labels", F.array().cast("array<string>")),
                    lim.input_most,
                ),
                tiering.prompt_over_budget(F.col("prompt"), tok, lim.prompt_tokens),
            ),
        }
    ).withColumn("privacy_tier", tiering.tier_code(F.col("tier_word")))
    return answered.withColumns(
        {
            "body_redacted": redaction.redact_for_display(F.col("clean"), F.col("lang"), config.ner, config.ascii_edges),
            "snippet_redacted": redaction.snippet_for_tier(
                F.col("snippet"), F.col("privacy_tier"), F.col("lang"), config.ner, config.ascii_edges
            ),
            "subject_text": text.strip(subject),
            "body_kind": chunking.body_kind(F.col("clean"), tok, lim.embed_max_tokens),
            "chunks": chunking.chunk_body(
                F.col("clean"), tok, lim.embed_max_tokens, lim.chunk_target_tokens
            ),
            "prepare_problem": F.coalesce(
                "input_problem",
                F.when(
                    F.col("tier_word").isNull(),
                    F.lit("Could not parse tier from classification response"),
                ),
            ),
        }
    )


def embed(prepared: DataFrame, config: EngineConfig) -> DataFrame:
    """Vectors for subject, body and chunks, pooled chunk vector, and validation."""
    lim, tok = config.limits, config.tokenizer
    none = F.array().cast("array<string>")
    ok = F.col("prepare_problem").isNull()
    has_subject = F.col("subject_text") != ""
    is_full = F.col("body_kind") == "full"
    texts = F.concat(
        F.when(ok & has_subject, F.array("subject_text")).otherwise(none),
        F.when(ok & is_full, F.array("clean")).otherwise(none),
        F.when(ok, F.transform("chunks", lambda c: c["text"])).otherwise(none),
    )
    whole, covers = texts, F.lit(1.0)
    fit = fits = None
    cap = min(lim.embed_max_tokens or fv.EMBED_MAX_TOKENS, fv.EMBED_MAX_TOKENS)
    if lim.long_texts == "parts":
        most = lim.embed_max_chars or (1 << 62)

        def fits():
            encode = tok.open()
            return lambda t: len(t) <= most and len(encode(t)) <= cap

    elif tok.length_based:
        texts = F.transform(
            texts, lambda t: tokens.truncate(t, tok, lim.embed_max_chars, lim.embed_max_tokens)
        )
    else:
        texts = F.transform(texts, lambda t: F.substring(t, 1, lim.embed_max_chars))
    if lim.long_texts == "prefix":
        covers = F.coalesce(_characters(texts) / F.nullif(_characters(whole), F.lit(0)), F.lit(1.0))
        if not tok.length_based and lim.embed_max_tokens:
            covers = F.lit(None).cast("double")  # only the model's tokenizer knows

            def fit():
                encode = tok.open()
                return lambda t: tokens.fit_to_tokens(t, encode, cap)

    answer = embedding_udf(config.embedder, fit=fit, fits=fits)(F.col("texts"))
    # Share of the characters of all texts that their vectors stand for.
    embedded = prepared.withColumns({"texts": texts, "vector_covers": covers}).withColumn("answer", answer)
    embedded = embedded.withColumns({"vectors": F.col("answer.vectors"), "embed_problem": F.col("answer.problem")})
    lead = has_subject.cast("int")
    chunk_vectors = F.slice(
        "vectors", lead + 1, F.greatest(F.lit(0), F.size("vectors") - lead)
    )
    no_vector = F.lit(None).cast("array<float>")
    with_vectors = embedded.withColumns(
        {
            "subject_embedding": F.when(
                has_subject, F.try_element_at("vectors", F.lit(1))
            ).otherwise(no_vector),
            "body_embedding": F.when(
                is_full, F.try_element_at("vectors", lead + 1)
            ).otherwise(no_vector),
            "chunks": F.when(
                F.col("body_kind") == "chunked",
                F.zip_with(
                    "chunks",
                    chunk_vectors,
                    lambda c, v: F.struct(
                        c["text"].alias("text"),
                        c["position"].alias("position"),
                        c["weight"].alias("weight"),
                        v.alias("embedding"),
                    ),
                ),
            ).otherwise(
                F.array().cast(
                    "array<struct<text:string,position:int,weight:double,embedding:array<float>>>"
                )
            ),
        }
    ).withColumn(
        "body_pooled_embedding",
        F.when(
            F.size("chunks") > 0,
            vectors.weighted_mean(
                F.transform("chunks", lambda c: c["embedding"]),
                F.transform("chunks", lambda c: c["weight"]),
            ).cast("array<float>"),
        ),
    )
    expect_subject = has_subject & (F.col("privacy_tier") != fv.SENSITIVE)
    expect_body = F.col("clean") != ""
    has_vector = getattr(config.embedder, "has_vector", lambda _: F.lit(True))
    chunk_problems = F.filter(
        F.transform(
            "chunks",
            lambda c: vectors.vector_problem(c["embedding"], "chunk embedding", has_vector(c["text"]), config.dim),
        ),
        lambda p: p.isNotNull(),
    )
    problem = F.coalesce(
        "prepare_problem",
        "embed_problem",
        vectors.vector_problem(
            F.col("subject_embedding"), "subject_embedding", expect_subject & has_vector(F.col("subject_text")), config.dim
        ),
        F.when(
            expect_body & F.col("body_embedding").isNull() & F.col("body_pooled_embedding").isNull(),
            F.lit("Body content to embed but no body_embedding or body_pooled_embedding"),
        ),
        F.when(
            F.col("body_embedding").isNotNull(),
            vectors.vector_problem(
                F.col("body_embedding"), "body_embedding", expect_body & has_vector(F.col("clean")), config.dim
            ),
        ),
        F.when(
            F.col("body_pooled_embedding").isNotNull(),
            vectors.vector_problem(
                F.col("body_pooled_embedding"), "body_pooled_embedding", expect_body & has_vector(F.col("clean")), config.dim
            ),
        ),
        F.try_element_at(chunk_problems, F.lit(1)),
    )
    return with_vectors.withColumn("problem", problem)


def _characters(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))


def transform(emails: DataFrame, config: EngineConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Results per mail, with the columns ``keep`` of the mail."""
    return embed(prepare(emails, config), config).select(*RESULT_COLUMNS, *keep)


def chunk_rows(results: DataFrame) -> DataFrame:
    """Chunk table rows of the successful results.

    The outer explode keeps the optimizer from inferring a filter over ``chunks``, which
    would evaluate the embedding twice on results that are not written yet.
    """
    return (
        results.where(F.col("problem").isNull())
        .select(F.col("id").alias("email_id"), F.explode_outer("chunks").alias("c"))
        .where(F.col("c").isNotNull())
        .select(
            "email_id",
            F.col("c.embedding").alias("chunk_embedding"),
            F.col("c.text").alias("chunk_text"),
            F.col("c.position").alias("chunk_position"),
            F.col("c.weight").alias("chunk_weight"),
        )
    )
