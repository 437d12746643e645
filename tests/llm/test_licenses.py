import re
import time

from feedloom.llm import license_rules, licenses
from tests.llm.conftest import rows_of

TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "the MIT License and the MIT-License; apache license",
    "This program is under the GNU Lesser General Public License version 2.1 or later. GNU General Public License too.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "Licensed under CC BY-NC 4.0.",
    "mit licenses, permit license, mit\nlicense\tmit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this. All rights reserved.",
    "und mit der Lizenz", "", "MİT license Kit licenſe",
]


def brute(text):
    """All places by regular expressions over the words, and containment by comparing all pairs."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    norm = " " + "  ".join(words).lower() + " "
    spans = []
    for rank, rule in enumerate(license_rules.rules()):
        spans += [(rule.level, rank, m.start(), m.end(), rule.label, rule.weight) for m in re.finditer(license_rules.spaced(rule.pattern), norm)]
    left = [x for x in spans if not any(y[2] <= x[2] and y[3] >= x[3] and y[0] <= x[0] and (y[2:4] != x[2:4] or y[:2] < x[:2]) for y in spans)]
    labels = base | {x[4] for x in left}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((x[5] for x in left), default=0.0)


def test_as_by_brute_force(make, prose):
    texts = TEXTS + [prose(1) + " " + TEXTS[2] + " " + prose(2) + TEXTS[0], f"{TEXTS[0]} {prose(3, words=20)} " * 200]
    assert rows_of(licenses.report(make(*texts))) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=repr)


def test_every_rule_passes_prefilter_and_gate():
    for rule in license_rules.rules():
        pattern = license_rules.spaced(rule.pattern)
        assert f" {rule.keyword} " in pattern or re.search(rf"\b{rule.keyword}\b", pattern)
        needs = pattern.replace("[cs]", "c")
        assert any(w in needs for w in licenses.PREFILTER), rule


def test_the_text_of_every_named_license_names_it(make):
    sentences = {(r[1], re.sub(r"\(\?:(?:([^|()]*)\|[^()]*)\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", r[3]))) for r in license_rules.TEXTS}
    sentences = [(label, s.replace("[123]", "2").replace("[23]", "2").replace("e?", "e")) for label, s in sorted(sentences)]
    assert {name[0] for name in license_rules.NAMES} <= {label for label, _ in sentences}
    rows = licenses.report(make(*[f"Notice.\n{s.capitalize()}; so it is." for _, s in sentences])).collect()
    for row in rows:
        label, sentence = sentences[row.doc_id]
        assert label in row.labels.split(","), sentence


def test_thousands_of_places_in_one_text_take_seconds(make):
    docs = make("the mit license x " * 20_000, "licensed under the apache license version 2 0 or the mit license " * 4_000)
    start = time.time()
    one, two = sorted(licenses.report(docs).collect())
    assert time.time() - start < 25
    assert (one.n_words, one.n_base, one.last_word, one.labels) == (80_000, 20_000, 79_997, "mit")
    assert (two.n_base, two.labels) == (8_000, "apache,mit")
    spans = licenses.detections(docs.filter("doc_id = 0")).selectExpr("count(*) n", "min(first_word) a", "max(first_word) b", "max(n_words) w").first()
    assert tuple(spans) == (20_000, 0, 79_996, 3)


def test_detections_have_places(make):
    rows = licenses.detections(make(TEXTS[0])).collect()
    assert [(r.label, r.first_word, r.n_words) for r in rows] == [("apache", 0, 8)]


def test_awkward_rows(awkward):
    assert rows_of(licenses.report(awkward)) == sorted(((r.doc_id, *brute(r.text)) for r in awkward.collect()), key=repr)
    assert licenses.report(awkward.limit(0)).count() == 0
