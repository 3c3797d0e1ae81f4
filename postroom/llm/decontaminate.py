"""Benchmark decontamination by size-partitioned MinHash containment search (operator 2).

A test item's sketch is a bottom-k MinHash: its first shingle hashes in an order that all share,
hashes of few items before hashes of many, then by value.  Items are partitioned by
their number of shingles n, which sets the sketch size: a text that holds at least the threshold's
share of n shingles misses at most ``n - ceil(threshold * n)`` of them, so one more hash than that
makes sure that it shares one with the sketch.  Unlike banded signatures, whose recall falls with
the length of the text around the passage, this finds every pair at any length; and a passage that many
items share is in few sketches, so it makes few candidates.  Candidates are verified on the shingles
themselves, each text once.  Items shorter than a shingle are found by their own words, wherever these
stand in a row.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import query, table, written

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch hashes in one broadcast (about 100 MB); more take further passes over the texts.
BROADCAST_HASHES = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_texts(words: str, shingle: int = SHINGLE) -> Column:
    """Distinct word shingles; fewer words than a shingle are one shingle, no words none."""
    at = f"sequence(1, greatest(1, size({words}) - {shingle - 1}))"
    made = f"array_distinct(transform({at}, i -> array_join(slice({words}, i, {shingle}), ' ')))"
    return F.expr(f"case when size({words}) > 0 then {made} else cast(array() as array<string>) end")


def shingle_hashes(words: str, shingle: int = SHINGLE) -> Column:
    """Hash of every shingle, repeats included; equal to ``xxhash64`` of its words."""
    more = "".join(f", get({words}, i + {k})" for k in range(1, shingle))
    return F.expr(f"transform(sequence(0, greatest(0, size({words}) - {shingle})), i -> xxhash64(get({words}, i){more}))")


def distinct_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, texts): rows (item_id, item) and (item, words); items of the same words are one ``item``."""
    base = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    members = base.select("item_id", F.sha2(F.array_join("words", " "), 256).alias("item"), "words")
    return members.select("item_id", "item"), members.groupBy("item").agg(F.any_value("words").alias("words"))


def sketches(texts: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Rows (item, n, needed, partition, words, sketch) of items of a shingle or more; needed: shingles to share."""
    long = texts.where(F.size("words") >= shingle).select("item", "words", F.array_distinct(shingle_hashes("words", shingle)).alias("hashes"))
    long = long.select("*", F.size("hashes").alias("n"))
    # The small slack keeps 0.8 * 5 at 4 in floating point.
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)).cast("int")
    own = long.select("item", needed.alias("needed"), "n", F.explode("hashes").alias("hash"))
    common = own.groupBy("hash").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class"))
    ordered = own.join(common, "hash").groupBy("item").agg(
        F.first("n").alias("n"), F.first("needed").alias("needed"), F.sort_array(F.collect_list(F.struct("class", "hash"))).alias("h")
    )  # bounded by the item's own length
    sketch = F.expr("transform(slice(h, 1, n - needed + 1), x -> x.hash)")
    sized = ordered.select("item", "n", "needed", F.floor(F.log2("n")).cast("int").alias("partition"), sketch.alias("sketch"))
    return sized.join(long.select("item", "words"), "item")


def _parts(keys: DataFrame, by: str) -> list[DataFrame]:
    """Rows of ``keys`` in parts that may be broadcast, all rows of one ``by`` in one part."""
    parts = max(1, -(-keys.count() // BROADCAST_HASHES))
    return [keys.where(F.pmod(F.xxhash64(by), F.lit(parts)) == k) for k in range(parts)]


def candidates(text: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, text, items): texts that share a sketch hash with items, once per row or equal rows."""
    offered = text.select("doc_id", "text", F.explode(shingle_hashes("words", shingle)).alias("hash"))
    keys = written(known.select("item", F.explode("sketch").alias("hash")), "sketch-hashes")
    found = None
    for part in _parts(keys, "item"):
        hits = offered.join(F.broadcast(part), "hash")
        # Hits of a text lie in one task, where the partial aggregate merges them; a text's items are no more
        # than the hits of its own shingles, and few items share a hash of a sketch.
        pair = hits.groupBy("doc_id", F.xxhash64("text").alias("_same"), F.length("text").alias("_length"))
        held = pair.agg(F.any_value("text").alias("text"), F.collect_set("item").alias("items")).select("doc_id", "text", "items")
        found = held if found is None else found.union(held)
    return found


def short_hits(text: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame | None:
    """Rows (doc_id, item, n, k): items shorter than a shingle whose words stand in a row in a text; None without such items."""
    short = written(texts.where(F.size("words") < shingle).select("item", F.size("words").alias("m"), F.array_join("words", " ").alias("gram")), "short-items")
    found = None
    for (m,) in short.select("m").distinct().orderBy("m").collect():  # lengths below a shingle's
        at = f"sequence(1, greatest(1, size(words) - {m - 1}))"
        grams = F.expr(f"array_distinct(transform({at}, i -> array_join(slice(words, i, {m}), ' ')))")
        offered = text.where(F.size("words") >= m).select("doc_id", F.explode(grams).alias("gram"))
        for part in _parts(short.where(F.col("m") == m), "item"):
            hits = offered.join(F.broadcast(part), "gram").select("doc_id", "item", F.lit(1).alias("n"), F.lit(1).alias("k"))
            found = hits if found is None else found.union(hits)
    return found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_shared, containment) at or above the threshold.

    containment: share of the item's distinct shingles that the whole text holds.  An item of
    fewer words than a shingle counts as one shingle, of all its words; a text holds it where they stand
    in a row.  Items and texts without words match nothing; rows with a null id take no part.  Rows that
    share a doc_id (item_id) are compared one by one and the pair keeps its best count.  Texts of any length
    are taken whole; other columns are ignored.  No rows on either side give no rows.
    """
    members, texts = (written(t, n) for t, n in zip(distinct_items(items), ("members", "items"), strict=True))
    known = written(sketches(texts, threshold, shingle), "sketches")
    text = docs.where("doc_id is not null").select("doc_id", "text", words_of(F.col("text")).alias("words"))
    own = shingle_texts("words", shingle).alias("own")
    held = candidates(text, known, shingle).select("doc_id", words_of(F.col("text")).alias("words"), "items").select("doc_id", own, "items")
    # Each candidate text is cut into shingles once and held against its items.
    wanted = known.select("item", "needed", F.size(shingle_texts("words", shingle)).alias("n"), shingle_texts("words", shingle).alias("wanted"))
    shared = held.select("doc_id", "own", F.explode("items").alias("item")).join(wanted, "item")
    shared = shared.select("doc_id", "item", "needed", "n", F.size(F.array_intersect("own", "wanted")).alias("k")).where("k >= needed").select("doc_id", "item", "n", "k")
    short = short_hits(text, texts, shingle)
    if short is not None:
        shared = shared.union(short)
    best = shared.join(members, "item").groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("k") / F.col("n"), "k", "n")).alias("b"))
    count = [F.col("b.n").cast("long").alias("n_shingles"), F.col("b.k").cast("long").alias("n_shared")]
    return best.select("doc_id", "item_id", *count, (F.col("b.k") / F.col("b.n")).alias("containment"))


_WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_SHINGLES_SQL = """select distinct {id}, array_to_string(w[i:i + 4], ' ') as s
  from (select {id}, {words} as w from {table}), unnest(range(1, len(w) - 3)) as u(i) where len(w) >= 5 and {id} is not null"""
ORACLE = f"""with d as ({_SHINGLES_SQL.format(id="doc_id", table="documents", words=_WORDS_SQL)}),
b as ({_SHINGLES_SQL.format(id="item_id", table="benchmark", words=_WORDS_SQL)}),
n as (select item_id, count(*) as n from b group by item_id),
short as (select item_id, w from (select item_id, {_WORDS_SQL} as w from benchmark) where len(w) between 1 and 4 and item_id is not null),
words as (select doc_id, {_WORDS_SQL} as w from documents where doc_id is not null)
select doc_id, item_id, n as n_shingles, count(*) as n_shared, count(*) / n as containment
from b join d using (s) join n using (item_id) group by doc_id, item_id, n having count(*) >= ceil(0.8 * n - 1e-9)
union all
select distinct doc_id, item_id, cast(1 as bigint), cast(1 as bigint), cast(1 as double) from short s join words d
  on contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(s.w, ' ') || ' ')"""


@query("op2_decontamination", ORACLE)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
