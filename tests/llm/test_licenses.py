import re

import numpy as np
import pytest

from robusteval.llm import licenses


def brute(text):
    classes, weights, intercept, threshold = licenses.model()
    low = (text or "").lower()
    found = []
    for line in low.split("\n"):
        if not any(a in line for a in licenses.ANCHORS):
            continue
        words = licenses.words_of(line)
        z = intercept + sum((weights[b] for b in {licenses.bucket(g) for g in licenses.grams_of(words)}), np.zeros(len(classes)))
        p = licenses.softmax(z[None])[0]
        k = int(p[:-1].argmax())
        pairs = {g for g in licenses.grams_of(words, 2) if " " in g}
        known = {g for t in (*licenses.TEMPLATES[classes[k]], *licenses.CALLED[classes[k]]) for g in licenses.grams_of(licenses.words_of(t), 2) if " " in g}
        similar = len(pairs & known) / len(pairs) if pairs else 0.0
        if p[k] >= threshold:
            found.append((similar >= licenses.CONFIRM, float(p[k]), similar, classes[k]))
        else:
            found.append(None)
    sure = [f for f in found if f]
    best = max(sure, default=None)
    lines = sum(bool(re.search(r"\S", x, re.ASCII)) for x in low.split("\n"))
    return len(found), len(sure), sum(f[0] for f in sure), best[3] if best else ("unknown" if found else None), best and round(best[1], 6), lines


def agree(r, text):
    n, sure, ok, name, p, lines = brute(text)
    assert (r.n_candidates, r.n_predicted, r.n_confirmed, r.license) == (n, sure, ok, name)
    assert p is None and r.probability is None or r.probability == pytest.approx(p, abs=2e-6)
    assert r.n_paragraphs == lines


NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 3.0.", "cc-by-sa"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
]


def test_the_model_knows_notices_and_leaves_the_rest_unknown(spark):
    rows = [(i, f"Some prose before.\n{t}\nand after.", k) for i, (t, k) in enumerate(NOTICES)]
    calm = ["He applied for a hunting licence in May.", "The guitar came with a lifetime warranty and a case.", "All rights reserved by the publisher.", "our mit students drank apache coffee with a gnu"]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100 + i, t) for i, t in enumerate(calm)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].license for i, _, _ in rows] == [k for _, _, k in rows]
    assert all(got[i].confirmed for i, _, _ in rows)
    assert [got[100 + i].license for i in range(4)] == ["unknown"] * 3 + [None]


def test_weights_are_sparse():
    _, weights, _, threshold = licenses.model()
    assert (weights != 0).mean() < 0.2
    assert 0.5 <= threshold < 0.95


#: Notices and sentences that no training text equals, as they occur in the wild.
UNSEEN = [
    ("MIT licensed, see the file for details", "mit"),
    ("of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including", "mit"),
    ("The library is distributed under the permissive MIT licence.", "mit"),
    ("Unless required by law, it is provided under the Apache License, Version 2.0 on an as is basis.", "apache"),
    ("Dual use of this module is allowed by the Apache 2.0 license text.", "apache"),
    ("This file is part of Foo, free software under the GNU General Public License v2", "gpl"),
    ("It is distributed under the terms of the GNU General Public License, either version 2 of the License, or any later version.", "gpl"),
    ("Foo comes with the GPLv3 licence", "gpl"),
    ("This library is free software; you can redistribute it under the GNU Lesser General Public License as published", "lgpl"),
    ("linking is allowed by the LGPL version 2.1", "lgpl"),
    ("Use of this code is governed by a BSD-style license, see the file.", "bsd"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", "bsd"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ("The browser part is subject to the Mozilla Public License 1.1", "mpl"),
    ("Content on this site is licensed under a Creative Commons Attribution 3.0 License.", "cc-by"),
    ("Photos are by the author, CC BY 2.0", "cc-by"),
    ("Encyclopedia text is available under the Creative Commons Attribution-ShareAlike License; more terms may apply.", "cc-by-sa"),
    ("Maps: CC BY-SA 2.0, contributors", "cc-by-sa"),
    ("Lectures are shared under a Creative Commons Attribution-NonCommercial 3.0 Unported licence", "cc-by-nc"),
    ("Slides are CC BY-NC 2.0", "cc-by-nc"),
    ("The author released the code to the public domain.", "public-domain"),
    ("the data set is dedicated to the public domain with CC0", "public-domain"),
]
NOT_OURS = [
    "The contents of this file are under the Eclipse Public License v1.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "see the GNU Affero General Public License v3 for more details",
    "available under the Creative Commons Attribution-NoDerivatives licence",
    "Licensed under the Acme Public License version 2",
    "the Sun Public License applies",
    "Licensed under the Vim License",
    "Licensed under the Open Software License version 3.0",
    "subject to the terms of the Q Public License, v. 1.0",
    "Licensed under the Ruby License",
    "BSL 1.1 License",
    "ISC license text",
    "He was licensed in 2004 to practise law",
    "Copyright (c) 2020 The Authors",
    "The general public may visit the museum on Sunday",
    "free of charge to any person over sixty",
    "The new edition, version 2.0, of the terms was read aloud",
    "This work was never published in his lifetime",
    "no permission was granted to any person to deal in furs",
    "The foundation gave a notice to every contributor",
]


def test_precision_and_recall_on_unseen_notices(spark):
    rows = [(i, t) for i, t in enumerate([*(t for t, _ in UNSEEN), *NOT_OURS])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    named = [got[i].license if got[i].n_predicted else None for i in range(len(rows))]
    right = sum(a == b for a, (_, b) in zip(named, UNSEEN))
    told = sum(a is not None for a in named)
    print("recall", right / len(UNSEEN), "precision", right / told)
    assert right / len(UNSEEN) >= 0.8 and right / told >= 0.9


def test_the_mit_notice_over_four_lines_is_found(spark):
    text = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "a\rb c\x85d")], "doc_id long, text string")).collect()
    assert (got[0].license, got[0].confirmed, got[0].n_paragraphs) == ("mit", True, 4)
    assert got[1].n_paragraphs == 1


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = licenses.op5_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        agree(r, texts[r.doc_id])


def test_edge_rows(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "\n\n \n"), (3, "license"), (4, "LICENSE\nMIT License\n" * 40), (5, "x " * 60000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(docs)
    for r in got:
        agree(r, dict(docs)[r.doc_id])
    assert licenses.scan(df.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, sf_dir):
    """Of the scan; the query deals a table of one row group over the cores first."""
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def lit_score(words):
    """(probability, family) of words by the whole model, nothing skipped."""
    classes, weights, intercept, threshold, owners = licenses.fitted()
    lit = {licenses.bucket(g) for g in licenses.grams_of(words) if owners.get(licenses.bucket(g)) == g}
    p = licenses.softmax((intercept + sum((weights[b] for b in lit), np.zeros(len(classes))))[None])[0]
    return (float(p[:-1].max()), classes[int(p[:-1].argmax())]) if p[:-1].max() >= threshold else None


def unfiltered(text):
    """The finds of every window of every line, no anchor asked: one a line."""
    out = []
    for line in (text or "").lower().split("\n"):
        words = licenses.words_of(line)
        starts = range(0, max(1, len(words) - licenses.WINDOW + licenses.STRIDE), licenses.STRIDE)
        found = [f for i in starts if (f := lit_score(words[i : i + licenses.WINDOW]))]
        if found:
            out.append(max(found))
    return out


BARE = [
    ("Available under CC BY 4.0.", "cc-by"),
    ("Distributed under the GPL v3.", "gpl"),
    ("Released under the GNU GPL, version 2 or later.", "gpl"),
    ("Released under CC BY-NC-SA 3.0 for non commercial use.", "cc-by-nc"),
]


def test_notices_without_an_anchor_are_found(spark):
    df = spark.createDataFrame([(i, f"Some prose before it.\n{t}\nand after.") for i, (t, _) in enumerate(BARE)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (text, family) in enumerate(BARE):
        assert not any(a in text.lower() for a in licenses.ANCHORS)
        assert (got[i].license, got[i].n_candidates, got[i].n_predicted) == (family, 1, 1)


def test_the_scan_of_lines_skips_nothing(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: (r.text or "") + ("\n" + BARE[i % 4][0] if i % 5 == 0 else "") for i, r in enumerate(rows)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        found = unfiltered(texts[r.doc_id])
        assert r.n_predicted == len(found)
        assert (r.license in {name for _, name in found}) if found else r.license in (None, "unknown")


PROSE = " ".join(f"w{i} the of and" for i in range(1000))


def test_a_notice_inside_a_long_line_is_found_and_confirmed(spark):
    texts = [(i, f"{PROSE} {t} {PROSE}", k) for i, (t, k) in enumerate([*NOTICES[:5], BARE[0]])]
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, _, family in texts:
        assert (got[i].license, got[i].confirmed) == (family, True)


def test_a_notice_wrapped_over_lines_is_found(spark):
    text = "This work is\nreleased by us under\nthe GNU\nGeneral Public\nLicense, version 3\nor any later one."
    other = "Some words stand before it and then it is available under the terms of CC\nBY-NC 4.0 for all who come to read it here."
    df = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].license, got[1].confirmed) == ("gpl", True)
    assert got[2].license == "cc-by-nc"


#: Sentences that deny a licence or speak of one, and what the earlier model missed.
DENIED = [
    "Not licensed under the GPL.", "This program is not released under the MIT License.", "The MIT license plate was stolen from the car.", "He later joined the Apache Software Foundation.",
    "this book is not in the public domain", "Nobody may use it under the Apache License, as it is not licensed under the Apache License.", "She gave a talk about the GNU General Public License and its history",
]


def test_denials_and_mentions_are_no_licences(spark):
    rows = list(enumerate([*DENIED, "Creative Commons Zero v1.0 Universal", "License :: OSI Approved :: Apache Software License", "Released under the MIT License."]))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[k].n_predicted for k in range(len(DENIED)))
    assert [got[k].license for k in range(len(DENIED), len(rows))] == ["public-domain", "apache", "mit"]
