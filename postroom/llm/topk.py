"""Exact top-k search by inner product with block-at-a-time pruning (operator 7).

Vectors are quantised to integers, put next to vectors of the same direction, and cut into ranges of
blocks; a block keeps its vectors (the forward index) and each component's largest and smallest value.
A query's bound for a block or a range is the sum of its terms' largest products.  A search of each
range by its own queries gives every query a k-th score to start from.  A query is then sent to a range
only if its bound for the range, taken from a small table of maxima, reaches that score; there blocks
are visited in the order of their bounds, until the next bound falls below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postroom.llm.registry import prepare, query, table, written

SCALE = 1024
K = 10
BLOCK = 256
#: Vectors in a range, queries in a slab and ranges in a pack of bounds: what one task holds at a time.
RANGE, SLAB, PACK = 16_384, 2_048, 4_096
#: Directions that vectors are sorted by: so many at most, taken from the vectors with the least hashes.
DIRECTIONS = 1_024

_LEAST = np.iinfo(np.int64).min


def quantise(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v): v holds floor(scale * x) as 64-bit integers.

    Rows whose id is null and vectors that are null or hold null or non-finite components are left out.
    A finite component that leaves 64 bits is an error: no integer stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(scale * v)
                if not (np.abs(v) < 2.0**63).all():
                    raise OverflowError(f"vector {i}: a component times {scale} does not fit 64 bits")
                ids.append(i)
                rows.append(v.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "v"])

    own = vectors.select(F.col(id_column).cast("long").alias("i"), F.col(vector_column).alias("x"))
    return own.mapInArrow(run, "vec_id bigint, v binary")


def directed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with ``lead``: the number of the unit vector in ``centres`` with the largest product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1).to_pylist(), centres.shape[1]).astype(np.float64)
            lead = (m @ centres.T).argmax(1) if len(m) and len(centres) else np.zeros(len(m), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead.astype(np.int32))], ["vec_id", "v", "lead"])

    return rows.mapInArrow(run, "vec_id bigint, v binary, lead int")


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), width)
    m = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        m[k, : len(r) // 8] = np.frombuffer(r, np.int64)
    return m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; in floating point only where all sums fit, an error beyond 64 bits."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 2**63:
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No product of a query with a vector between ``low`` and ``high`` is larger (queries x ranges).

    Exact where the sums fit; a float rounded up beyond that, as bounds need not fit 64 bits.
    """
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    top = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (high, low)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, queries.shape[1])
    sums = up.astype(np.float64) @ high.T.astype(np.float64) + down.astype(np.float64) @ low.T.astype(np.float64)
    return sums if top < 2**52 else sums + top * 2.0**-40


class Blocks:
    """Forward index of one range: blocks of vectors in the order given, each sorted by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, size: int = BLOCK):
        self.blocks = []
        for at in range(0, len(ids), size):
            order = np.argsort(ids[at : at + size], kind="stable")
            self.blocks.append((ids[at : at + size][order], vectors[at : at + size][order]))
        self.high = np.array([v.max(0) for _, v in self.blocks])
        self.low = np.array([v.min(0) for _, v in self.blocks])
        self.scored = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (queries x k), best first; unused places hold the least integer.

        ``floor``: scores that k candidates elsewhere are known to reach.
        """
        n = len(query_ids)
        scores, ids = np.full((n, k), _LEAST), np.full((n, k), np.iinfo(np.int64).max)
        bounds = _bounds(queries, self.high, self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        active = np.arange(n)
        for step in range(len(self.blocks)):
            block = order[active, step]
            # A block whose bound equals the k-th score may still hold a smaller id.
            going = bounds[active, block] >= np.maximum(scores[active, -1], floor[active])
            active, block = active[going], block[going]
            if not len(active):
                break
            for b in np.unique(block):
                who = active[block == b]
                own, vectors = self.blocks[b]
                got = _product(queries[who], vectors)
                got[own[None, :] == query_ids[who][:, None]] = _LEAST
                self.scored += got.size
                top = np.argsort(-np.maximum(got, _LEAST + 1), axis=1, kind="stable")[:, :k]
                all_scores = np.concatenate([scores[who], np.take_along_axis(got, top, 1)], 1)
                all_ids = np.concatenate([ids[who], own[top]], 1)
                best = np.lexsort((all_ids, -np.maximum(all_scores, _LEAST + 1)), axis=1)[:, :k]
                scores[who] = np.take_along_axis(all_scores, best, 1)
                ids[who] = np.take_along_axis(all_ids, best, 1)
        return scores, ids


@dataclass(frozen=True)
class Cost:
    """What a search shipped and scored, of what there was."""

    vectors: int
    queries: int
    ranges: int
    shipped: int  # rows (query, range) beyond a query's own range
    scored: int  # pairs (query, vector)

    @property
    def share(self) -> float:
        return self.scored / max(1, self.vectors * self.queries)


def top_k(vectors: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of ``search``."""
    return search(vectors, *args, **kwargs)[0]


def search(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    every: int = 100,
    scale: int = SCALE,
    range_rows: int = RANGE,
    slab_rows: int = SLAB,
    block: int = BLOCK,
) -> tuple[DataFrame, Cost]:
    """Rows (query_id, rank, vec_id, score) of every row whose id is divisible by ``every``, and their cost.

    Candidates are all rows with another id; equal scores go to the smaller id.  Unfit vectors
    (see ``quantise``) take no part; shorter vectors count as filled with zeros; vectors of any length
    are taken whole.  A component or a score beyond 64 bits is an error.  Repeated rows are
    candidates each; a query id that occurs more than once is asked once, with its least vector.
    No rows give no rows; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = written(quantise(vectors, id_column, vector_column, scale), "vectors")
    n, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    width = widest // 8
    # Vectors of one direction share a range and a block, so that bounds are tight.
    wanted = min(DIRECTIONS, n // block)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()  # DIRECTIONS rows at most
    centres = _matrix([bytes(r.v) for r in sample], width).astype(np.float64)
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    ranges = directed(rows, centres).repartitionByRange(max(1, -(-n // range_rows)), "lead", "vec_id").sortWithinPartitions("lead", "vec_id")
    index = written(ranges.select(F.spark_partition_id().alias("range"), "lead", "vec_id", "v"), "ranges")
    is_query = F.col("vec_id") % every == 0
    asked = index.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "range")).alias("q"))
    asked = written(asked.select("vec_id", "q.range", "q.v"), "queries")
    n_queries = asked.count()
    slabs = max(1, -(-n_queries // slab_rows))

    def load(left: pd.DataFrame) -> Blocks:
        left = left.sort_values(["lead", "vec_id"], kind="stable")
        return Blocks(left["vec_id"].to_numpy(), _matrix(list(left["v"]), width), block)

    def extremes(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(list(own["v"]), width)
        return pd.DataFrame({"range": [key[0]], "high": [m.max(0).tobytes()], "low": [m.min(0).tobytes()]})

    def first(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"home": [], "vec_id": [], "v": [], "floor": [], "scored": []})
        blocks = load(left)
        scores, _ = blocks.search(right["vec_id"].to_numpy(), _matrix(list(right["v"]), width), np.full(len(right), _LEAST), k)
        return pd.DataFrame({"home": key[0], "vec_id": right["vec_id"], "v": right["v"], "floor": scores[:, -1], "scored": [blocks.scored, *[0] * (len(right) - 1)]})

    def reach(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The ranges of a pack that a slab of queries must be sent to."""
        if not len(left) or not len(right):
            return pd.DataFrame({"range": [], "vec_id": [], "v": [], "floor": []})
        high, low = (_matrix(list(left[c]), width) for c in ("high", "low"))
        floor = right["floor"].to_numpy().astype(np.float64)[:, None]
        wins = _bounds(_matrix(list(right["v"]), width), high, low) >= floor - np.abs(floor) * 2.0**-50
        q, r = np.nonzero(wins)
        return pd.DataFrame({"range": left["range"].to_numpy()[r], "vec_id": right["vec_id"].to_numpy()[q], "v": right["v"].to_numpy()[q], "floor": right["floor"].to_numpy()[q]})

    def second(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        blocks, floor = load(left), right["floor"].to_numpy()
        scores, ids = blocks.search(right["vec_id"].to_numpy(), _matrix(list(right["v"]), width), floor, k)
        kept = (scores > _LEAST) & (scores >= floor[:, None])
        asker = np.repeat(right["vec_id"].to_numpy(), k).reshape(-1, k)
        out = pd.DataFrame({"query_id": asker[kept], "vec_id": ids[kept], "score": scores[kept]})
        # A row without ids counts the pairs that were scored.
        cost = pd.DataFrame({"query_id": pd.array([None], "Int64"), "vec_id": pd.array([None], "Int64"), "score": [blocks.scored]})
        return pd.concat([out.astype({"query_id": "Int64", "vec_id": "Int64"}), cost])

    slab = F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int").alias("slab")

    def spread(pairs: DataFrame) -> DataFrame:
        """The vectors of the ranges in ``pairs`` (range, slab), once for each slab that asks for them."""
        return index.join(written(pairs.select("range", "slab").distinct(), "pairs"), "range").select("range", "slab", "lead", "vec_id", "v")

    at_home = written(asked.select("range", slab, "vec_id", "v"), "at-home")
    ends = written(index.groupBy("range").applyInPandas(extremes, "range int, high binary, low binary"), "extremes")
    floors = spread(at_home).groupBy("range", "slab").cogroup(at_home.groupBy("range", "slab")).applyInPandas(first, "home int, vec_id bigint, v binary, floor bigint, scored bigint")
    floors = written(floors, "floors")
    # The stated queries against the maxima of all ranges, in blocks of both.
    packs = max(1, -(-(ends.agg(F.coalesce(F.max("range"), F.lit(-1))).first()[0] + 1) // PACK))
    every_slab, every_pack = (F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (slabs, packs))
    bounds = ends.select(F.floor(F.col("range") / PACK).cast("int").alias("pack"), every_slab.alias("slab"), "range", "high", "low")
    asking = floors.select(every_pack.alias("pack"), slab, "vec_id", "v", "floor")
    sent = bounds.groupBy("pack", "slab").cogroup(asking.groupBy("pack", "slab")).applyInPandas(reach, "range int, vec_id bigint, v binary, floor bigint")
    sent = written(sent.select("range", slab, "vec_id", "v", "floor"), "sent")
    found = spread(sent).groupBy("range", "slab").cogroup(sent.groupBy("range", "slab")).applyInPandas(second, "query_id bigint, vec_id bigint, score bigint")
    found = written(found, "found")
    scored = found.where("query_id is null").agg(F.coalesce(F.sum("score"), F.lit(0))).first()[0]
    cost = Cost(n, n_queries, ends.count(), sent.count(), scored + (floors.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.where("query_id is not null").select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    return best, cost


ORACLE = """with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 10"""


@query("op7_topk", ORACLE)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
