"""License scan against exact containment at every place."""

import random

from tagflow.llm import license as lic


def brute(text, templates, share, size):
    words = lic.words_of(text)
    found = set()
    for lid, t in templates:
        tw = lic.words_of(t)
        if not tw:
            continue
        own = min(size, len(tw))
        want = {tuple(tw[i:i + own]) for i in range(len(tw) - own + 1)}
        grams = [tuple(words[i:i + own]) for i in range(len(words) - own + 1)]
        span = len(tw) - own + 1
        for i in range(len(grams)):
            if len(want & set(grams[i:i + span])) >= share * len(want):
                found.add(lid)
    return found


def test_scan_finds_every_template(spark):
    rng = random.Random(5)
    templates = [*lic.TEMPLATES, ("long", " ".join(f"t{i}" for i in range(90))), ("empty", " . "), ("none", None)]
    filler = lambda: " ".join(rng.choice(["the", "of", "license", "version", "under", "a", "work", "is"]) for _ in range(rng.randint(0, 90)))
    docs = []
    for i in range(200):
        t = filler()
        if i % 2:
            words = (rng.choice(templates[:-2])[1]).upper().split()
            if len(words) > 30 and rng.random() < 0.5:
                words[0] = "changed"
            t += ",\n".join(["", " ".join(words)]) + " " + filler()
        docs.append(t)
    docs += [None, "", "MIT", "Released under the MIT License.\n" * 3]
    table = spark.createDataFrame(templates, "license_id string, text string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, licenses int")
    got = {r.doc_id: r.licenses for r in lic.with_licenses(df, table).collect()}
    for i, t in enumerate(docs):
        want = brute(t, templates, 0.8, 5)
        assert want <= {m.license_id for m in got[i]}, i
    assert [(m.license_id, m.n_places, m.containment, m.first_word) for m in got[203]] == [("MIT", 3, 1.0, 0)]
    assert got[200] == [] and got[201] == []
    plain = {r.doc_id: r.licenses for r in lic.with_licenses(df).collect()}
    assert [m.license_id for m in plain[203]] == ["MIT"]
    assert lic.with_licenses(df.limit(0)).count() == 0


def test_built_in_texts_and_wordings():
    rows = lic.built_in()
    classes = lic.compile_templates(rows, lic.BANDS, lic.SHINGLE)
    ids = lambda texts: [{m[0] for m in g} for g in lic.scan(texts, classes, lic.BANDS, 0.8, True)]
    lgpl = "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either " \
           "version 3 of the License, or (at your option) any later version."
    cases = [("It is distributed under the MIT License", {"MIT"}), ("see the Apache License 2.0", {"Apache-2.0"}),
             ("Use: GNU General Public License v2", {"GPL-2.0"}), ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
             ("Licensed under CC BY-ND 4.0.", {"CC-BY-ND-4.0"}), ("# SPDX-License-Identifier: AGPL-3.0-only", {"AGPL-3.0"}),
             ("You may use it under " + lgpl, {"LGPL-3.0"}), ("Redistribute under " + lgpl.replace("Lesser ", ""), {"GPL-3.0"}),
             ("Redistribute under " + lgpl.replace("Lesser", "Affero"), {"AGPL-3.0"}),
             ("either version 2 of the License, or (at your option) any later version", set()),
             ("the license of a general public work", set())]
    for (text, want), got in zip(cases, ids([t for t, _ in cases])):
        assert got == want, text
    full = [(lid, text) for lid, text, _ in rows if len(text.split()) > 100]
    assert len(full) >= 20
    texts = ["word " * 40 + text + " end" * 300 for _, text in full]
    for (lid, _), got in zip(full, ids(texts)):
        assert lid in got and len({x for x in got if x.split("-")[0] == lid.split("-")[0]}) == 1, (lid, got)
    gpl = dict(full)["GPL-3.0"]
    as_affero = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1).replace("29 June", "19 November", 1)
    as_affero = as_affero.replace("GNU General Public License as published", "GNU Affero General Public License as published")
    assert ids([as_affero]) == [{"AGPL-3.0"}]
    assert [x[1] for x in lic.scan(["under the MIT License.\n" * 3], classes, lic.BANDS, 0.8, True)[0]] == [3]
