"""Quality classifier: a sparse rule ensemble over text statistics (operator 5).

Trees of a small random forest are cut into conjunctive rules (one per path from a root to any
node below it), a logistic regression with lasso keeps few of them, and the kept rules become one
Spark column expression.  Statistics come from whole texts; ids, sources, languages and labels are
no inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from postroom.llm.registry import prepare, query, table, written

#: Labelled rows that the rules are learned from, by a hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 17
ACCEPT = 0.7

STATISTICS = (
    "log_bytes", "mean_word", "upper", "digits", "stops", "shouts", "symbols", "bars", "other_punctuation", "non_ascii",
    "spaces", "mean_line", "distinct_lines", "longest_line", "distinct_words", "longest_word",
)

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:", "shouts": b"!?", "symbols": b"#$%&*@^~=+_",
    "bars": b"|", "other_punctuation": b"\"'()-/<>[\\]`{}", "spaces": b" \t\n\r\v\f",
}
_AT = {name: np.frombuffer(chars, np.uint8) for name, chars in _KINDS.items()}


def statistics(text: bytes) -> list[float]:
    """Shares and means of one text (UTF-8), in the order of ``STATISTICS``; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [s for line in text.split(b"\n") if (s := line.strip())]
    share = {name: float(counts[at].sum()) / n for name, at in _AT.items()}
    share |= {
        "log_bytes": math.log(n),
        "mean_word": sum(map(len, words)) / max(1, len(words)),
        "non_ascii": float(counts[128:].sum()) / n,
        "mean_line": math.log1p(n / max(1, len(lines))),
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "longest_line": max(map(len, lines), default=0) / n,
        "distinct_words": len(set(words)) / max(1, len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)),
    }
    return [share[s] for s in STATISTICS]


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the array ``stats``; null texts count as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            found = [statistics(t.as_py() or b"") for t in batch.column(last).cast(pa.binary())]
            columns = [batch.column(i) for i in range(last)] + [pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "stats"])

    schema = docs.select(*keep).schema.add("stats", ArrayType(DoubleType()))
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


#: (statistic, above, threshold): the statistic is above, or else at most, the threshold.
Condition = tuple[int, bool, float]


@dataclass
class RuleEnsemble:
    """Logistic sum of weighted rules; each rule is a conjunction of conditions."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, stats: str = "stats") -> Column:
        """Score from 0 to 1 as a column expression over the array of statistics."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(F.expr(rule_sql(conditions, stats)), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if {rule_sql(c, 'stats')}" for c, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def rule_sql(conditions: tuple[Condition, ...], stats: str) -> str:
    return " and ".join(f"{stats}[{k}] {'>' if above else '<='} {t!r}D" for k, above, t in conditions)


def tree_rules(node, path: dict | None = None) -> set[tuple[Condition, ...]]:
    """Rules of all paths from the root to a node below it; a tighter bound replaces a looser one."""
    path = path or {}
    found = {tuple((k, above, t) for (k, above), t in sorted(path.items()))} if path else set()
    if node.subtreeDepth() == 0:
        return found
    split = node.split()
    k, t = split.featureIndex(), split.threshold()
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        bound = path.get((k, above), t)
        found |= tree_rules(child, path | {(k, above): max(bound, t) if above else min(bound, t)})
    return found


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (y, stats) of at most ``train_rows`` labelled ids, chosen by a hash; an id labelled twice counts as its lower label."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most ``train_rows`` narrow rows: texts stay where they are read.
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    return with_statistics(rows, ("y",)).select(F.col("y").cast("double").alias("y"), "stats")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """A rule ensemble for label 1.  With one label only, or none, its score is that label's share, or 0.5."""
    prepare(docs.sparkSession)
    rows = written(training_rows(docs, labels, train_rows).repartition(8), "quality-training")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleEnsemble(math.log(share / (1 - share)))
    vectors = rows.select("y", array_to_vector("stats").alias("features"))
    forest = RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, subsamplingRate=0.7)
    rules: set[tuple[Condition, ...]] = set()
    for tree in forest.fit(vectors).trees:
        rules |= tree_rules(tree._java_obj.rootNode())
    if not rules:
        share = ones / n
        return RuleEnsemble(math.log(share / (1 - share)))
    ordered = sorted(rules)
    fired = F.array(*[F.expr(f"case when {rule_sql(r, 'stats')} then 1D else 0D end") for r in ordered])
    lasso = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=200)
    fitted = lasso.fit(rows.select("y", array_to_vector(fired).alias("features")))
    weights = [(r, float(w)) for r, w in zip(ordered, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(float(fitted.intercept), weights)


def score(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``score`` (higher: label 1 likelier) and ``predicted`` (1 from ``ACCEPT`` on).

    Null and empty texts are scored by their all-zero statistics.  Rows are scored alone: repeated
    rows get equal scores, no rows give none; other columns are ignored.
    """
    found = with_statistics(docs, keep).withColumn("score", model.column())
    return found.select(*keep, "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
