from __future__ import annotations

import re

from threadlake.llm.licence_scan import SENTENCE, THRESHOLD, _words, anchor_words, licence_matches, template_bigrams
from threadlake.llm.licence_texts import TEMPLATES


def brute(rows):
    shapes = template_bigrams(TEMPLATES)
    out = []
    for doc, text in rows:
        if text is None:
            continue
        t = text.lower().replace("licence", "license")
        scopes = {"document": [t], "line": t.split("\n"), "sentence": re.split(SENTENCE, t)}
        for scope, parts in scopes.items():
            for place, part in enumerate(parts):
                words = _words(part)
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
                scored = [(2 * len(pairs & set(p)) / (len(pairs) + len(p)), -i, name) for i, (name, p) in enumerate(shapes)]
                dice, _, name = max(scored)
                if pairs and dice >= THRESHOLD:
                    out.append((doc, scope, place, name, round(dice, 9), len(pairs)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [
        (1, "Some prose here.\nReleased under the MIT Licence.\nMore prose."),
        (2, "Prose. Licensed under the Apache License, Version 2.0. And prose."),
        (3, None),
        (4, ""),
        (5, "licensed"),
        (6, mit),
        (6, mit),
        (7, mit.replace("sublicense, ", "").replace("free of charge", "at no charge")),
        (8, "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
        (None, "This work is licensed under the GNU General Public License, version 2."),
        (9, "This work is about a general public."),
        (10, (mit + "\n") * 3),
    ]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id bigint, text string, dice string")
    got = [(r.doc_id, r.scope, r.place, r.licence, round(r.dice, 9), r.n_bigrams) for r in licence_matches(frame).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert {r[0] for r in got} == {1, 2, 6, 7, 8, None, 10}
    assert licence_matches(frame.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, documents):
    plan = licence_matches(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


def test_anchor_words_are_needed():
    """Without its anchored bigrams no template keeps enough to reach the threshold."""
    shapes = template_bigrams(TEMPLATES)
    for threshold in (0.3, 0.8, 1.0):
        anchors = set(anchor_words(shapes, threshold))
        for _, pairs in shapes:
            left = [p for p in pairs if not anchors & set(p.split(" "))]
            assert 2 * len(left) / (len(left) + len(pairs)) < threshold
