from __future__ import annotations

import random

from postroom.llm import licenses


def plain_blocks(words: list[bytes], template: licenses.Template):
    """Every block and its containment, without any filter."""
    step, wanted = licenses.block_step(template), set(template.words)
    for first in range(0, len(words), step):
        block = words[first : first + 2 * step]
        share = len(wanted & set(block)) / len(wanted)
        if share >= template.threshold - 1e-12:
            yield first, len(block), share


def test_filters_lose_no_block():
    rng = random.Random(6)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.words}) + [b"mit", b"und", b"xyz"] * 20
    index = licenses.Index(licenses.TEMPLATES, {w: rng.randint(0, 9) for w in vocabulary})
    seen = 0
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 300]))]
        for _ in range(2):
            inserted = list(rng.choice(licenses.TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, 4])):
                inserted[rng.randrange(len(inserted))] = b"other"
            at = rng.randint(0, len(words))
            words[at:at] = inserted
        want = {(k, *b) for k, t in enumerate(licenses.TEMPLATES) for b in plain_blocks(words, t)}
        got = {(k, first, size, common / len(index.ordered[k])) for k, first, size, common in index.matches(words)}
        assert got == want
        seen += len(want)
        places, _ = index.scan(words)
        plain = [(i, t.label) for t in licenses.BASE for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
        assert [(p["start"], p["label"]) for p in places] == sorted(plain)
    assert seen > 300


def test_nulls_long_repeated_rows_and_whole_paragraphs(spark):
    mit = licenses.PARAGRAPHS[0].text.replace("software", "Software,")
    rows = [
        (1, None, "c"), (2, "", "c"), (3, "Released UNDER the MIT-license. under the mit license", "c"), (4, "x " * 200_000 + mit, "c"),
        (None, "CC BY-NC 4.0", "c"), (5, "mit under the Apache licence", "c"), (6, "CCİ BY NC", "c"), (3, "under the mit license", "c"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, places string")
    got = [(r.doc_id, r.n_words, [(p.label, p.start) for p in r.places], sorted({b.label for b in r.blocks})) for r in licenses.scan(docs).collect()]
    assert got[0] == (1, 0, [], []) and got[1] == (2, 0, [], [])
    assert got[2] == (3, 9, [("mit", 1), ("mit", 5)], [])
    assert got[3][1] == 200_000 + len(licenses.PARAGRAPHS[0].words) and got[3][2:] == ([], ["mit"])
    assert got[4] == (None, 5, [("cc-by-nc", 0)], []) and got[5][2:] == ([], []) and got[6][2] == []
    assert got[7][:3] == (3, 4, [("mit", 0)])
    assert licenses.scan(docs.limit(0)).collect() == []


def labels(text: str, templates=licenses.TEMPLATES) -> list[str]:
    return sorted({b["label"] for b in licenses.Index(templates, {}).scan(licenses.words_of(text.encode()))[1]})


def test_names_stand_in_a_row():
    assert labels("not under the gnu general public license; see version 2 of our guide") == []
    assert labels("GNU General Public License version 3 replaced version 2") == ["gpl-3"]
    assert labels("the GNU General Public License, Version 2, applies") == ["gpl-2"]
    assert labels("a license of the gnu public general version 2 kind") == []


def test_paragraphs_of_full_texts_and_clean_prose():
    for t in licenses.PARAGRAPHS:
        words = t.text.split()
        words[len(words) // 2] = "changed"
        assert t.label in labels("Some code. " * 9 + " ".join(words))
    prose = "The authors of this report are liable for its claims. Permission to use the hall was granted by the state, without any warranty. " * 20
    assert labels(prose) == []


def test_templates_out_of_a_table(spark, monkeypatch):
    import pytest

    rows = spark.createDataFrame([("own", "our own special terms apply here", None, False), ("own-2", "own terms", None, True), (None, "x", None, False), ("none", None, None, False)], "label string, text string, threshold double, row boolean")
    made = licenses.templates_from(rows)
    assert [(t.label, t.threshold, t.row) for t in made] == [("own", 0.8, False), ("own-2", 1.0, True)]
    assert labels("Our own special terms may apply here.", made) == ["own"] and labels("own terms", made) == ["own-2"]
    docs = spark.createDataFrame([(1, "these are own terms")], "doc_id long, text string")
    assert [b.label for b in licenses.scan(docs, made).first().blocks] == ["own-2"]
    monkeypatch.setattr(licenses, "MOST_TEMPLATES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        licenses.templates_from(rows)
