"""License scans as an exact set-similarity join of text blocks with license templates (operator 1).

Template words are ordered from the globally rarest to the most frequent, by counts over all
texts.  A block that holds at least ``needed`` of a template's words must hold one of its first
``|T| - needed + 1`` (prefix filter), must have at least ``needed`` template words (length filter),
and enough of both must follow the first common word (positional filter).  What passes is counted
exactly.  The templates, a fixed list, are the broadcast side; a text never leaves its task.

Blocks of a template with up to S words (a power of two) start at every S-th word and have 2 S
words, so any S consecutive words lie in the block in whose first half they start.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import prepare, query, table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """``phrase``: its words must stand consecutively, and every such place is reported.

    ``row``: a block counts only if the words stand consecutively in it.
    """

    label: str
    text: str
    threshold: float = 1.0
    phrase: bool = False
    row: bool = False

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text.encode())


#: Templates that a table of them may have: what is broadcast is bounded.
MOST_TEMPLATES = 10_000

# The three base phrases; names of public licenses (all words of the name in a
# row); paragraphs of public license texts (at least THRESHOLD of the words).
BASE = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)
NAMES = (
    Template("gpl-2", "gnu general public license version 2", row=True),
    Template("gpl-3", "gnu general public license version 3", row=True),
    Template("lgpl", "gnu lesser general public license", row=True),
    Template("agpl-3", "gnu affero general public license", row=True),
    Template("mpl-2", "mozilla public license version 2", row=True),
    Template("cc-by-nc", "creative commons attribution noncommercial license", row=True),
    Template("cc-by-sa", "creative commons attribution sharealike license", row=True),
    Template("gpl-2", "gnu gpl version 2", row=True),
    Template("gpl-3", "gnu gpl version 3", row=True),
    Template("apache-2", "apache 2 0 license", row=True),
    Template("isc", "under the isc license", row=True),
    Template("bsd", "redistributed under the bsd license", row=True),
)
PARAGRAPHS = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
        THRESHOLD,
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        THRESHOLD,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        THRESHOLD,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        THRESHOLD,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        THRESHOLD,
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile "
        "sell or distribute this software",
        THRESHOLD,
    ),
    Template(
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software",
        THRESHOLD,
    ),
    Template(
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
        "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        THRESHOLD,
    ),
    Template(
        "apache-2",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        THRESHOLD,
    ),
    Template(
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
        THRESHOLD,
    ),
    Template(
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
        "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
        "software even if advised of the possibility of such damage",
        THRESHOLD,
    ),
    Template(
        "isc",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all "
        "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
        "action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
        "this software",
        THRESHOLD,
    ),
    Template(
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        THRESHOLD,
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at http mozilla org mpl 2 0",
        THRESHOLD,
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original "
        "software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
        "but is not required altered source versions must be plainly marked as such and must not be misrepresented as being "
        "the original software this notice may not be removed or altered from any source distribution",
        THRESHOLD,
    ),
)
TEMPLATES = BASE + NAMES + PARAGRAPHS


def templates_from(rows: DataFrame) -> tuple[Template, ...]:
    """Templates out of a table (label, text[, threshold, phrase, row]); more than ``MOST_TEMPLATES`` are an error.

    Rows without a label or a word are left out; a missing threshold is ``THRESHOLD`` (1 for ``phrase`` and ``row``).
    """
    found = rows.limit(MOST_TEMPLATES + 1).collect()
    if len(found) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    made = []
    for r in (f.asDict() for f in found):
        strict = bool(r.get("phrase") or r.get("row"))
        share = 1.0 if strict else r.get("threshold") if r.get("threshold") is not None else THRESHOLD
        made.append(Template(r["label"], r["text"] or "", share, bool(r.get("phrase")), bool(r.get("row"))))
    return tuple(t for t in made if t.label and t.words)


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes; only A-Z are lowered."""
    return _WORD.findall(text.lower())


def needed_words(template: Template) -> int:
    return max(1, -int(-(len(set(template.words)) * template.threshold - 1e-9) // 1))


def block_step(template: Template) -> int:
    return 1 << max(2, (len(template.words) - 1).bit_length())


def in_a_row(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[at : at + len(phrase)] == phrase for at in range(len(words) - len(phrase) + 1))


class Index:
    """Prefix index over the templates, for one global order of their words."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int]):
        vocabulary = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(vocabulary)}
        self.templates = templates
        self.ordered = [sorted({self.rank[w] for w in t.words}) for t in templates]
        self.needed = [needed_words(t) for t in templates]
        self.words = [t.words for t in templates]
        # rank of a prefix word -> (template, its place in the template's order, block step)
        self.prefix: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        for k, order in enumerate(self.ordered):
            for place in range(len(order) - self.needed[k] + 1):
                self.prefix[vocabulary[order[place]]].append((k, place, block_step(templates[k])))
        self.prefix = dict(self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(template, first word of the block, words of the block, common words) at or above the threshold."""
        prefix, rank = self.prefix, self.rank
        candidates: dict[tuple[int, int, int], tuple[int, int]] = {}
        for at, word in enumerate(words):
            if word in prefix:
                for k, place, step in prefix[word]:
                    for block in (at // step - 1, at // step):
                        if block >= 0:
                            key = (step, block, k)
                            if key not in candidates or place < candidates[key][0]:
                                candidates[key] = (place, rank[word])
        found, last, held = [], None, []
        for (step, block, k), (place, first) in sorted(candidates.items()):
            if (step, block) != last:
                last = (step, block)
                held = sorted({rank[w] for w in words[block * step : (block + 2) * step] if w in rank})
            order, needed = self.ordered[k], self.needed[k]
            if len(held) < needed:
                continue
            if min(len(order) - place, len(held) - held.index(first)) < needed:
                continue
            common = len(set(order).intersection(held))
            if common >= needed:
                found.append((k, block * step, min(2 * step, len(words) - block * step), common))
        return found

    def scan(self, words: list[bytes]) -> tuple[list[dict], list[dict]]:
        """Places of phrases (each in the block in whose first half it starts) and matched blocks."""
        places, blocks = [], []
        for k, first, size, common in self.matches(words):
            template = self.templates[k]
            if not template.phrase:
                if template.row and not in_a_row(self.words[k], words[first : first + size]):
                    continue
                blocks.append({"label": template.label, "start": first, "words": size, "containment": common / len(self.ordered[k])})
                continue
            phrase = self.words[k]
            for at in range(first, first + block_step(template)):
                if words[at : at + len(phrase)] == phrase:
                    places.append({"label": template.label, "start": at, "words": len(phrase)})
        return sorted(places, key=lambda p: (p["start"], p["label"])), sorted(blocks, key=lambda b: (b["start"], b["label"], b["words"]))


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """Occurrences of the templates' words over all texts, summed in each task before the shuffle."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(w for w in words_of(text.as_py() or b"") if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in counted.collect()}  # at most one row per template word


_PLACES = "array<struct<label:string,start:bigint,words:bigint>>"
_BLOCKS = "array<struct<label:string,start:bigint,words:bigint,containment:double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``n_words``, ``places`` of phrases and ``blocks`` that match other templates.

    Places and blocks are in words from 0, by start.  Null and empty texts have no words and two
    empty arrays; each row is scanned alone, so repeated rows get equal answers and no rows give
    none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, word_frequencies(docs, templates)))
    own = docs.select(*keep, F.col("text").alias("_text"))
    found_ddl = f"n_words bigint, places {_PLACES}, blocks {_BLOCKS}"
    schema = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], found_ddl).schema:
        schema = schema.add(f)
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
    block = pa.struct([*place, pa.field("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            counts, places, blocks = [], [], []
            for text in batch.column(last).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                p, b = index.value.scan(words)
                counts.append(len(words))
                places.append(p)
                blocks.append(b)
            columns = [batch.column(i) for i in range(last)]
            columns += [pa.array(counts, pa.int64()), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "places", "blocks"])

    return own.mapInArrow(run, schema)


def _oracle() -> str:
    """Plain SQL: every position of a phrase, and every block of every other template."""
    phrases, templates = [], []
    for t in TEMPLATES:
        words = [w.decode() for w in t.words]
        listed = "[" + ", ".join(f"'{w}'" for w in (words if t.phrase else sorted(set(words)))) + "]"
        if t.phrase:
            phrases.append(
                f"select doc_id, '{t.label}' as label, i - 1 as start from d, unnest(range(1, len(w) - {len(words) - 2})) as u(i) "
                f"where w[i] = '{words[0]}' and w[i:i + {len(words) - 1}] = {listed}"
            )
        else:
            step = block_step(t)
            held = f"w[k * {step} + 1:(k + 2) * {step}]"
            row = f" and contains(' ' || array_to_string({held}, ' ') || ' ', ' {' '.join(words)} ')" if t.row else ""
            templates.append(
                f"select doc_id, '{t.label}' as label, c / {len(set(words))} as containment from (select doc_id, w, k, "
                f"len(list_intersect({held}, {listed})) as c from d, "
                f"unnest(range(0, (len(w) - 1) // {step} + 1)) as u(k) where list_has_any(w, {listed})) where c >= {needed_words(t)}{row}"
            )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
p as ({" union all ".join(phrases)}),
t as ({" union all ".join(templates)}),
pd as (select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels
  from p group by doc_id),
ld as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from p union all select doc_id, label from t) group by doc_id),
sd as (select doc_id, max(containment) as score from (select doc_id, 1.0 as containment from p union all select doc_id, containment from t) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
from d left join pd using (doc_id) left join ld using (doc_id) left join sd using (doc_id)"""


@query("op1_licenses", _oracle())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "blocks.label")).alias("labels"),
        best.alias("score"),
    )
