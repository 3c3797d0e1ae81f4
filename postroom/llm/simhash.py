"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 4).

Fingerprints link at three or fewer differing bits.  Half of that radius is one flipped bit on
one side and two on the other:

* Distance 0 to 2: every fingerprint emits itself and its 64 one-bit variants.  All that share a
  variant lie within two bits of each other, so each links to the least of them.
* Distance 3 joins an even and an odd number of set bits.  At least two of the three bits lie in
  the same half of the fingerprint: the odd one emits its two-bit variants within a half, the
  even one its one-bit variants.  All that share such a variant with an even one lie within
  three bits of it, and link to it.  Before the two-bit variants are made, the other half is
  matched (it differs by one bit at most), so only fingerprints with a possible partner emit them.

Sharing a variant proves the link, a group of any size needs no more edges than it has members,
and a variant has at most 65 (respectively 2,081) fingerprints around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postroom.llm.graph import components
from postroom.llm.registry import prepare, query, table, written

SHINGLE = 3
SEED = 42
RADIUS = 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, signed; A-Z are lowered, words part at ASCII white space."""
    import xxhash

    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):  # bounded memory for texts of any length
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(total, at + (1 << 16)))], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, fp, *keep) of whole texts; null and empty texts give 0."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    names = ["doc_id", "fp", *keep]
    ddl = ", ".join(["doc_id bigint, fp bigint", *[f"{c} {own.schema[c].dataType.simpleString()}" for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names)

    return own.mapInArrow(run, ddl)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: range, n: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for c in combinations(bits, n)]


def _each(masks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<bigint>"))


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")


def close_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at distance one or two."""
    variants = fps.select("fp", _each([0, *_flips(range(64), 1)]).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("v"))
    return _linked(variants.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("v")).alias("b")))


def odd_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at distance three, with those at one and two."""
    low = (1 << 32) - 1
    odd = F.bit_count("fp") % 2 == 1
    # side: the half that must match; role 0: odd, 1: even, 2: even with a flipped bit in that half
    sides = []
    for side, bits in ((0, range(32)), (1, range(32, 64))):
        masks = F.when(odd, F.array(F.lit(0)).cast("array<bigint>")).otherwise(F.array(*[F.lit(m) for m in [0, *_flips(bits, 1)]]).cast("array<bigint>"))
        v = F.col("fp").bitwiseXOR(F.col("mask"))
        same = v.bitwiseAND(F.lit(low)) if side == 0 else F.shiftrightunsigned(v, 32) + F.lit(1 << 32)
        role = F.when(odd, 0).when(F.col("mask") == 0, 1).otherwise(2)
        sides.append(fps.select("fp", F.explode(masks).alias("mask")).select("fp", same.alias("same"), role.alias("role")))
    per = Window.partitionBy("same")
    met = (
        sides[0]
        .union(sides[1])
        .select("*", F.min("role").over(per).alias("lo"), F.max("role").over(per).alias("hi"))
        .where("lo = 0 and hi > 0")
    )
    high = F.col("same") >= F.lit(1 << 32)  # the high half matches, the low one is flipped
    arrays = {}
    for name, n in (("two", 2), ("one", 1)):
        a, b = (F.array(*[F.lit(m) for m in _flips(bits, n)]).cast("array<bigint>") for bits in (range(32), range(32, 64)))
        arrays[name] = F.when(high, a).otherwise(b)
    masks = F.when(F.col("role") == 0, arrays["two"]).when(F.col("role") == 1, arrays["one"]).otherwise(F.array(F.lit(0)).cast("array<bigint>"))
    rest = F.col("fp").bitwiseXOR(F.col("mask"))
    rest = F.when(high, rest.bitwiseAND(F.lit(low))).otherwise(F.shiftrightunsigned(rest, 32))
    meet = met.select("fp", "role", "same", F.explode(masks).alias("mask")).select("fp", "role", "same", rest.alias("rest"))
    per = Window.partitionBy("same", "rest")
    hub = meet.select("fp", F.min(F.when(F.col("role") > 0, F.col("fp"))).over(per).alias("hub"), F.min("role").over(per).alias("lo"))
    return _linked(hub.where("lo = 0 and hub is not null").select(F.col("fp").alias("a"), F.col("hub").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of ``docs``.

    component_id is the smallest doc_id reachable over links of three or fewer differing bits.
    Null and empty texts have fingerprint 0 and link like any other.  A null doc_id takes part but
    never names a component unless nothing else is in it (then null).  Repeated rows share a
    component; no rows give no rows; other columns are ignored.
    """
    own = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(close_edges(fps).union(odd_edges(fps)))
    joined = fps.join(labels.withColumnRenamed("node", "fp"), "fp")
    named = written(joined.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    of_fp = written(labels.join(named, "label").select(F.col("node").alias("fp"), "component_id"), "component-of")
    of_fp = fps.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.join(written(of_fp, "component-of-all"), "fp").select("doc_id", "fp", "component_id")


def least_rows(docs: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """The ``key`` of one row of each component: that of the least (doc_id, key), null ids last.

    So a component that holds only null ids has a row too, and rows that share an id but belong to
    different components are told apart.  ``key`` is a column without nulls.
    """
    own = written(fingerprints(docs, shingle, (key,)), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)).alias("least")
    fps = written(own.groupBy("fp").agg(least), "distinct-fingerprints")
    labels = components(close_edges(fps).union(odd_edges(fps))).withColumnRenamed("node", "fp")
    named = fps.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("least").alias("least"))
    return named.select(F.col(f"least.{key}").alias(key))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
