"""License scan: a trained classifier of paragraphs, confirmed by templates.

Each paragraph (a line of a text) is cut into words and hashed 1- to 3-grams; a sparse multinomial logistic regression gives each
licence family and "unknown" a probability. A family is predicted only if its
probability reaches a threshold calibrated on held-out notices; otherwise the
paragraph is unknown. A prediction is confirmed if enough of the paragraph's
2-grams occur in the family's templates.

The model is trained here, on the fixed notices below with words dropped,
exchanged and added, against kinds of paragraphs of the unknown class:
notices of other licences, notices whose licence's name is exchanged for an
invented one, and sentences that deny a licence or speak of it without granting it: some
thousand short paragraphs, on the driver, once a process. The threshold is
calibrated on whole notices held out: in each of FOLDS parts the model is trained
without the part's notices and all their variants, and the threshold is the least
at which PRECISION of the families predicted for held-out notices are right.
Scoring is one projection of DataFrame functions: no shuffle, no Python. The
weights travel as one literal array.

A line of more than 24 words is scored in windows of 24 words, one at every 8, and
takes its best window's finding. Lines up to the next blank one may be a wrapped notice, so
the 16 words on either side of each line break are scored too; a family found there
counts besides the lines, once a block of lines, unless one of them is confirmed
for it or confirmed with a higher probability. A prediction is confirmed by all words of its window or the best 8. Every paragraph is scored. The full score is skipped only where the positive parts
of the weights prove that no family can reach the threshold, so nothing is lost.

Defined results: a null or empty text has no paragraph and no licence; ties
between families go to the first by name; a document's licence is its most
probable confirmed paragraph's, else its most probable predicted one's; rows are
independent, so repeated rows and null ids don't matter; whole texts are read;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robusteval.llm.common import spread_documents

UNKNOWN = "unknown"
BUCKETS = 2**18
#: Long lines are scored in windows of so many words, one at every STRIDE words: any
#: run of WINDOW - STRIDE + 1 words lies whole in one of them.
WINDOW, STRIDE = 24, 8
#: Words on either side of a line break that are scored together.
REACH = 16
#: A bucket has a weight only if so many training paragraphs light it.
SEEN = 3
#: A paragraph that holds one of these counts as a candidate even if the model
#: finds no licence in it (fixed values); they don't decide what is scored.
ANCHORS = ("licen", "copyright", "spdx", "public domain", "permission is", "redistribut", "warrant", "creative commons", "copyleft", "all rights reserved")
#: Words of a notice, by family (fixed values: the usual grants of each licence).
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This software is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License, Version 2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms are permitted provided that the above copyright notice is retained in all such forms.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "This code is distributed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 3-Clause License",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC-SA 3.0 for non commercial use.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it under the terms of the GNU Lesser General Public License.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU Lesser General Public License, version 2.1",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "Licensed under the MIT license.",
        "This project is distributed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The MIT License (MIT)",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License, Version 2.0",
    ],
    "public-domain": [
        "This work is released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This file has been placed in the public domain by its author.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
#: Sentences with an anchor that grant none of these (fixed values).
OTHERS = (
    "She lost her driving licence on the way to the city.",
    "Copyright 2021 Example Press. All rights reserved.",
    "All rights reserved; no part of this book may be reproduced without permission.",
    "The council will license the new cafe next month.",
    "A fishing licence is required on this lake.",
    "The maker gives a warranty of two years on all parts.",
    "The software is sold under a commercial license agreement with the vendor.",
    "Her licence plate was stolen and the insurance did not pay.",
    "The king could redistribute the land among the farmers.",
    "This product is licensed for use by registered customers only.",
    "The police had a warrant to search the house.",
    "Poetic license allows the writer to bend the facts.",
    "The bar was licensed to sell beer and wine until midnight.",
    "The film is protected by copyright law in many countries.",
    "Please read the license terms before you install the program.",
    "The doctor is licensed in three states.",
    "Permission is needed from the owner before you enter.",
    "A public domain name server answers these requests.",
)
#: Notices of licences that are none of the families (fixed values).
NEAR = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Eclipse Public License 2.0",
    "SPDX-License-Identifier: EPL-2.0",
    "Use of this software is governed by the Business Source License 1.1.",
    "Licensed under the BSL 1.1 License.",
    "SPDX-License-Identifier: BUSL-1.1",
    "Licensed under the Elastic License 2.0.",
    "Licensed under the Server Side Public License, version 1.",
    "ISC License",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "SPDX-License-Identifier: ISC",
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "Licensed under the AGPL version 3 or later.",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "SPDX-License-Identifier: CC-BY-ND-4.0",
    "Permission is granted to copy this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Artistic License 2.0.",
    "This software is provided as is, without any express or implied warranty, under the zlib License.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This database is made available under the Open Database License.",
    "Released under the Microsoft Public License.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the PostgreSQL License.",
    "Licensed under the Python Software Foundation License.",
)
#: Names by which a notice is one of a family (fixed values).
OWN_NAMES = ("apache", "bsd", "gnu", "gpl", "lgpl", "mit", "mozilla", "mpl")
#: What each family is called where it is only named (fixed values).
CALLED = {
    "apache": ("Apache License", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache License, Version 2.0", "Apache 2 licence", "ASL 2.0 of the Apache Software Foundation", "Apache Software License"),
    "bsd": ("BSD license", "BSD 3-Clause License", "2-clause BSD license", "BSD-2-Clause", "BSD-style license", "New BSD License", "Simplified BSD licence"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "CC BY 2.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 licence"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence", "Creative Commons Attribution-NonCommercial 3.0 licence"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 3.0 licence", "Creative Commons Attribution Share Alike 4.0 International"),
    "gpl": ("GNU General Public License", "GNU General Public License v2", "GNU GPL", "GNU GPL version 3", "GPL v3", "GPLv3", "GPLv2", "GPL-3.0-or-later", "GNU General Public Licence, version 2 or any later version"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL v3", "LGPLv3", "LGPL-2.1", "GNU Lesser General Public Licence, version 2.1", "GNU Library General Public License"),
    "mit": ("MIT License", "MIT license", "MIT licence", "Expat MIT License", "MIT", "MIT/X11 License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL, v. 2.0", "Mozilla Public Licence, version 1.1"),
    "public-domain": ("public domain", "CC0", "CC0 1.0 Universal", "CC0-1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal", "Creative Commons Zero"),
}
#: What licences are called that are none of the families (fixed values).
NEAR_CALLED = (
    "Eclipse Public License", "EPL-2.0", "Business Source License", "BSL 1.1", "Elastic License", "Server Side Public License", "ISC License", "ISC",
    "GNU Affero General Public License", "GNU AGPL", "AGPL v3", "AGPLv3", "AGPL-3.0", "Affero GPL", "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-NC-ND 4.0",
    "Creative Commons Attribution-NoDerivatives License", "Creative Commons Attribution-NoDerivs 3.0 licence", "Creative Commons Attribution-NonCommercial-NoDerivatives License", "Creative Commons Attribution-NonCommercial-NoDerivs 3.0",
    "GNU Free Documentation License", "GFDL", "Boost Software License", "Artistic License 2.0", "zlib License", "Zlib", "European Union Public Licence", "EUPL-1.2",
    "Common Development and Distribution License", "CDDL-1.0", "SIL Open Font License", "Open Database License", "Microsoft Public License", "Academic Free License",
    "PostgreSQL License", "Python Software Foundation License", "W3C Software Notice and License", "IBM Public License", "commercial license", "proprietary license",
)
#: Sentences a licence is named in (fixed values).
FRAMES = (
    "{}", "{}.", "Licensed under the {}.", "Licensed under {}", "Released under the {}.", "Released under {}", "Distributed under the {}.", "distributed under the terms of the {}",
    "This project is licensed under the {}.", "This work is available under the {}.", "Available under {}.", "Shared under a {}", "Subject to the terms of the {}.", "{} - see the LICENSE file for details",
    "License: {}", "SPDX-License-Identifier: {}", "License :: OSI Approved :: {}", "Dual-licensed under {}", "Dual-licensed under the {} and a commercial licence.", "The code is published under the {}", "Use of this source code is governed by the {} that can be found in the LICENSE file.", "under {}", "Text is offered under the {}; additional terms may apply.",
)
#: Sentences that deny a licence, and sentences that speak of one and grant none (fixed values).
DENIALS = (
    "Not licensed under the {}.", "This program is not released under the {}.", "It is not available under the {}", "no longer distributed under the {}", "The code was never published under {}",
    "This work is not in the {}", "this file isn't licensed under {}", "cannot be distributed under the terms of the {}", "Nothing here is released under the {}.", "The book is not under the {}", "we do not use the {}", "the {} does not apply to this work", "neither licensed under the {} nor free", "It may not be redistributed under the {}.", "not subject to the {}",
)
MENTIONS = (
    "The {} plate was stolen from the car.", "He wrote a book about the {}.", "She later joined the {} and moved away.", "A talk on the {} and its history", "students discussed the {} in class", "many projects use the {} today", "The {} was written in the eighties.",
    "how the {} differs from other licences", "the {} is a popular choice", "lawyers argued about the {} for years", "what does the {} say about patents", "he asked whether the {} would do", "the authors of the {} met in spring", "In the meantime the {} had become common.",
)
#: Words that paragraphs are padded with in training (fixed values).
FILLERS = "the of and in to a is it that for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
_WORD = r"[a-z0-9]+"


def words_of(paragraph: str) -> list[str]:
    return re.findall(_WORD, paragraph.lower())


def grams_of(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def bucket(gram: str) -> int:
    """As pmod(xxhash64(gram), BUCKETS) has it: the hash's low bits."""
    return xxhash.xxh64_intdigest(gram, 42) % BUCKETS


#: Words that begin a grant, exchanged for each other in training (fixed values).
GRANTS = ("licensed", "released", "distributed", "available", "published", "provided", "shared", "offered")
#: Licence names that no other text holds by chance (fixed values).
NAMES = ("gpl", "lgpl", "mpl", "bsd", "cc0", "spdx", "mozilla", "sharealike", "noncommercial")


def variants(paragraph: str, rng: random.Random, count: int, spoil: bool) -> list[list[str]]:
    """A paragraph's words, as they are and changed as copies in the wild are."""
    out = [words_of(paragraph)]
    for _ in range(count):
        words = [w if not w.isdigit() or rng.random() < 0.5 else str(rng.randrange(1, 5)) for w in out[0]]
        if spoil:
            if rng.random() < 0.5:
                words = [rng.choice(GRANTS) if w in GRANTS else w for w in words]
            if len(words) > 12 and rng.random() < 0.5:
                start = rng.randrange(len(words) - 9)
                words = words[start : start + rng.randrange(9, len(words))]
            words = [w for w in words if rng.random() > 0.05]
        for _ in range(rng.choice((0, 0, 0, 2, 5, 12))):
            words.insert(rng.choice((0, len(words))), rng.choice(FILLERS))
        out.append(words)
    return out


FOLDS, PRECISION = 4, 0.95


def model() -> tuple[tuple[str, ...], np.ndarray, np.ndarray, float]:
    """Classes (families, then unknown), weights (BUCKETS, classes), intercepts and
    the probability from which a family is believed."""
    return fitted()[:4]


def invented(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def training(rng: random.Random) -> list[tuple[list[str], int, int]]:
    """(words, class, notice) of all training paragraphs. Those made from one notice,
    or that name one licence alike, share its number."""
    rows: list[tuple[list[str], int, int]] = []
    families = sorted(TEMPLATES)
    unknown = len(families)
    notices = 0

    def add(paragraphs: list[list[str]], k: int) -> None:
        nonlocal notices
        rows.extend((w, k, notices) for w in paragraphs)
        notices += 1

    def named(name: str, count: int) -> list[list[str]]:
        return [variants(rng.choice(FRAMES).format(name), rng, 1, False)[-1] for _ in range(count)]

    for k, family in enumerate(families):
        for text in TEMPLATES[family]:
            own = variants(text, rng, 14, True)
            add(own, k)
            if set(own[0]) & set(OWN_NAMES):
                notices -= 1
                names = [invented(rng) for _ in own]
                add([[name if w in OWN_NAMES else w for w in words] for words, name in list(zip(own, names))[::4]], unknown)
        for name in CALLED[family]:
            add(named(name, 16), k)
            add([variants(frame.format(name), rng, 1, False)[-1] for frame in (*rng.sample(DENIALS, 3), *rng.sample(MENTIONS, 2))], unknown)
    for text in OTHERS:
        add(variants(text, rng, 9, False), unknown)
    for text in NEAR:
        add(variants(text, rng, 9, True), unknown)
    for name in NEAR_CALLED:
        add(named(name, 12), unknown)
    for _ in range(60):
        kind = rng.choice(("License", "Public License", "License 2.0", "licence", "Software License"))
        add(named(f"{invented(rng)} {kind}", 2), unknown)

    def prose() -> list[str]:
        return [rng.choice(FILLERS) for _ in range(rng.randint(3, 25))]

    def put(words: list[str], word: str) -> None:
        words.insert(rng.randrange(len(words)), word)

    pairs = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams_of(words_of(t), 2) if " " in g and not set(g.split()) & {*NAMES, *OWN_NAMES}})
    common = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)} - set(NAMES))
    for kind, count in (("speaks", 200), ("shares", 400), ("pairs", 300), ("names", 75)):
        for n in range(count):
            words = prose()
            if kind == "speaks":
                put(words, rng.choice(("license", "licensed", "copyright", "warranty", "licence", "redistribute")))
            elif kind == "shares":
                for _ in range(rng.randint(1, 3)):
                    word = rng.choice(common)
                    for _ in range(rng.randint(1, 3)):
                        put(words, word)
            elif kind == "pairs":
                put(words, rng.choice(pairs))
            else:
                put(words, ("mit", "apache", "gnu", "cc", "nc")[n % 5])
            add([words], unknown)
    rng.shuffle(rows)
    return rows


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple[str, ...], np.ndarray, np.ndarray, float, dict[int, str]]:
    """The model, and of each bucket the gram that lit it in training: another gram
    that falls there by chance counts for nothing, however long a text is."""
    classes = (*sorted(TEMPLATES), UNKNOWN)
    rows = training(random.Random(11))
    met = Counter(g for words, _, _ in rows for g in set(grams_of(words)))
    owners: dict[int, str] = {}
    for gram, _ in sorted(met.items(), key=lambda kv: (-kv[1], kv[0])):
        owners.setdefault(bucket(gram), gram)
    lit = [{b for g in grams_of(words) if owners[b := bucket(g)] == g} for words, _, _ in rows]
    counts = Counter(b for buckets in lit for b in buckets)
    used = sorted(b for b, n in counts.items() if n >= SEEN)
    column = {b: i for i, b in enumerate(used)}
    x = np.zeros((len(rows), len(used)), dtype=np.float32)
    for r, buckets in enumerate(lit):
        x[r, [column[b] for b in buckets if b in column]] = 1.0
    y, notice = np.array([k for _, k, _ in rows]), np.array([n for _, _, n in rows])
    p = np.zeros((len(rows), len(classes)))
    for fold in range(FOLDS):
        out = notice % FOLDS == fold
        own, intercept = train(x[~out], y[~out], len(classes), rounds=120)
        p[out] = softmax(x[out] @ own + intercept)
    dense, intercept = train(x, y, len(classes))
    weights = np.zeros((BUCKETS, len(classes)))
    weights[used] = dense
    return classes, weights, intercept, calibrate(p, y), owners


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, l1: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an L1 penalty, by accelerated proximal
    gradient steps; weights that the penalty holds at zero stay out of the model."""
    n = len(x)
    pace = np.float32(n / 5 / (x.sum(axis=1).max() + 1))
    w, b = np.zeros((x.shape[1], classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    vw, vb, t = w.copy(), b.copy(), 1.0
    target = np.eye(classes, dtype=np.float32)[y]
    for _ in range(rounds):
        error = (softmax(x @ vw + vb) - target) / np.float32(n)
        nw, nb = vw - pace * (x.T @ error), vb - pace * error.sum(axis=0)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - pace * np.float32(l1), np.float32(0))
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        push = np.float32((t - 1) / nt)
        vw, vb = nw + push * (nw - w), nb + push * (nb - b)
        w, b, t = nw, nb, nt
    return np.round(w.astype(np.float64), 3), np.round(b.astype(np.float64), 3)


def calibrate(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least threshold, from a half up, such that of the held-out paragraphs whose
    best family passes it the given share are of that family."""
    best, top = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1)
    for t in np.arange(0.5, 0.9501, 0.01):
        passed = top >= t
        if not passed.any() or (best[passed] == y[passed]).mean() >= precision:
            break
    return round(float(t), 4)


def literal(values: list, kind: str) -> Column:
    """A constant array or struct: folded into one literal of the plan."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def anchored(text: Column) -> Column:
    out = F.lit(False)
    for a in ANCHORS:
        out = out | text.contains(a)
    return out


def one(expr: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(expr), then), F.lit(0))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))


def gram(words: Column, i: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])


def starts(words: Column, n: int) -> Column:
    """Where the n-grams of words begin."""
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def adding(table: Column, width: int, k: int):
    return lambda total, row: total + F.get(table, row * width + k)


def windows(words: Column) -> Column:
    """Words as they are, or if they are many in windows of WINDOW words that overlap."""
    last = F.size(words) - (WINDOW - STRIDE) - 1
    return F.when(F.size(words) <= WINDOW, F.array(words)).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(STRIDE)), lambda i: F.slice(words, i + 1, WINDOW)))


class Scorer:
    """The model as columns: literal tables of the buckets that have a weight."""

    def __init__(self):
        classes, weights, intercept, self.threshold, owners = fitted()
        self.families, self.intercept = classes[:-1], intercept
        lit = np.flatnonzero((weights != 0).any(axis=1))
        slot = np.full(BUCKETS, -1)
        slot[lit] = np.arange(len(lit))
        # what each bucket can at most add to a family's lead over unknown
        lead = np.maximum(np.round(weights[lit, :-1] - weights[lit, -1:], 3), 0.0)
        self.need = intercept[-1] - intercept[:-1] + math.log(self.threshold / (1 - self.threshold)) - 1e-6
        if (self.need <= 0).any():
            self.need[:] = -math.inf  # a paragraph without a weight might pass: nothing is skipped
        self.tables = F.struct(
            literal(slot.tolist(), "array<int>").alias("slot"),
            literal([owners[b] for b in lit.tolist()], "array<string>").alias("owners"),
            literal(lead.ravel().tolist(), "array<double>").alias("lead"),
            literal(weights[lit].ravel().tolist(), "array<double>").alias("table"),
        )

    def bound(self, then) -> Column:
        """then() with the tables at hand, which are in the plan once."""

        def run(t: Column) -> Column:
            self.slot, self.owners, self.lead, self.table = t["slot"], t["owners"], t["lead"], t["table"]
            return then()

        return one(self.tables, run)

    def slots(self, words: Column) -> Column:
        """The distinct buckets of the words' grams that have a weight."""

        def of(n: int) -> Column:
            at = lambda i: F.get(self.slot, F.pmod(F.xxhash64(gram(words, i, n)), F.lit(BUCKETS)).cast("int"))
            lit = F.filter(starts(words, n), lambda i: at(i) >= 0)
            own = F.filter(lit, lambda i: F.get(self.owners, at(i)) == gram(words, i, n))
            return F.transform(own, at)

        return F.array_distinct(F.flatten(F.array(*[of(n) for n in (1, 2, 3)])))

    def possible(self, slots: Column) -> Column:
        """False only if no family can reach the threshold: p >= t needs a lead over
        unknown of log(t / (1 - t)), and positive parts bound the lead, also that of
        any part of the words."""
        c = len(self.families)
        ok = F.lit(False)
        for k in range(c):
            most = F.aggregate(slots, F.lit(0.0), adding(self.lead, c, k))
            ok = ok | (most >= float(self.need[k]))
        return ok

    def find(self, words: Column) -> Column:
        """struct(confirmed, probability, similarity, family) of a paragraph's words;
        null if it is unknown."""
        return one(self.slots(words), lambda slots: F.when(self.possible(slots), one(self.logits(slots), lambda z: self.decided(z, words))))

    def best(self, words: Column) -> Column:
        """The best finding among the windows of words, null if there is none."""
        return one(self.slots(words), lambda slots: F.when(self.possible(slots), F.array_max(F.transform(windows(words), self.find))))

    def logits(self, slots: Column) -> Column:
        c = len(self.intercept)
        return F.array(*[F.aggregate(slots, F.lit(float(self.intercept[k])), adding(self.table, c, k)) for k in range(c)])

    def decided(self, z: Column, words: Column) -> Column:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        best = F.array_max(F.slice(z, 1, len(self.families)))
        name = F.get(F.array(*[F.lit(x) for x in self.families]), F.array_position(z, best).cast("int") - 1)
        return one(F.struct(name.alias("name"), (F.exp(best - top) / total).alias("p")), lambda s: F.when(s["p"] >= self.threshold, self.confirmed(s, words)))

    def confirmed(self, s: Column, words: Column) -> Column:
        own = F.lit(None).cast("array<string>")
        for family in self.families:
            known = known_pairs(family)
            own = F.when(s["name"] == family, literal(known, "array<string>")).otherwise(own)
        return one(one(own, lambda known: similarity(words, known)), lambda v: F.struct((v >= CONFIRM).alias("confirmed"), s["p"].alias("probability"), v.alias("similarity"), s["name"].alias("family")))


#: Share of 2-grams that the family's templates must hold, of all words of a window
#: or of its best RUN words.
CONFIRM, RUN = 0.5, 8


def known_pairs(family: str) -> list[str]:
    """The 2-grams of a family's templates and of what it is called."""
    return sorted({g for t in (*TEMPLATES[family], *CALLED[family]) for g in grams_of(words_of(t), 2) if " " in g})


def similarity(words: Column, known: Column) -> Column:
    share = lambda pairs: F.size(F.array_intersect(pairs, known)) / F.size(F.array_distinct(pairs))

    def whole(words: Column) -> Column:
        return one(F.transform(starts(words, 2), lambda i: gram(words, i, 2)), share)

    runs = F.array_max(F.transform(starts(words, RUN), lambda i: one(F.slice(words, i + 1, RUN), whole)))
    return F.when(F.size(words) > 1, F.greatest(whole(words), runs)).otherwise(F.lit(0.0))


def over_breaks(paragraph: Column) -> Column:
    """For each line break inside a paragraph, the REACH words on either side of it,
    across further breaks too."""
    tokens = F.regexp_extract_all(paragraph, F.lit(f"({_WORD}|\\n)"), F.lit(1))

    def cut(tokens: Column) -> Column:
        marks = F.filter(starts(tokens, 1), lambda i: F.get(tokens, i) == "\n")
        # a break's place among the words: its place less the breaks before it
        places = F.array_distinct(F.transform(marks, lambda i, j: i - j))

        def around(words: Column) -> Column:
            inner = F.filter(places, lambda i: (i > 0) & (i < F.size(words)))
            return F.transform(inner, lambda i: F.slice(words, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)) + REACH))

        return one(F.filter(tokens, lambda t: t != "\n"), around)

    return one(tokens, cut)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_candidates, n_predicted, n_confirmed, license,
    probability, similarity, confirmed) for every row of docs."""
    scorer = Scorer()
    text = F.coalesce(F.lower(F.col(text_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("low"))

    # every line is scored; a candidate is one with a finding or an anchor
    def lines(paragraph: Column, maybe: Column) -> Column:
        finding = lambda line: F.struct(anchored(line).alias("anchor"), F.when(maybe, one(split_words(line), scorer.best)).alias("best"))
        return F.filter(F.transform(F.split(paragraph, "\n"), finding), lambda p: p["anchor"] | p["best"].isNotNull())

    def wrapped(paragraph: Column, found: Column) -> Column:
        # a window may cut a line's notice (BY-NC to BY), so it has to beat the confirmed lines
        sure = F.filter(F.transform(found, lambda p: p["best"]), lambda b: b["confirmed"])
        beaten = lambda b: F.exists(sure, lambda c: (c["family"] == b["family"]) | (c["probability"] >= b["probability"]))
        new = F.filter(F.transform(over_breaks(paragraph), scorer.find), lambda b: b.isNotNull() & ~beaten(b))
        each = lambda new: F.transform(F.array_distinct(F.transform(new, lambda b: b["family"])), lambda f: F.array_max(F.filter(new, lambda b: b["family"] == f)))
        return F.transform(one(new, each), lambda b: F.struct(F.lit(False).alias("anchor"), b.alias("best")))

    def joined(paragraph: Column, maybe: Column) -> Column:
        more = F.when(maybe & paragraph.contains("\n"), F.lit(True)).otherwise(False)
        return one(lines(paragraph, maybe), lambda found: F.when(more, F.concat(found, wrapped(paragraph, found))).otherwise(found))

    def read(paragraph: Column) -> Column:
        return one(one(one(split_words(paragraph), scorer.slots), scorer.possible), lambda maybe: joined(paragraph, maybe))

    found = scorer.bound(lambda: F.flatten(F.transform(F.split("low", r"\n\s*\n"), read)))
    rows = rows.select("doc_id", F.size(F.filter(F.split("low", "\n"), lambda line: line.rlike(r"\S"))).cast("long").alias("n_paragraphs"), found.alias("found"))
    predicted = F.filter(F.transform("found", lambda p: p["best"]), lambda b: b.isNotNull())
    rows = rows.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_candidates"), predicted.alias("predicted"))
    rows = rows.select("*", F.array_max("predicted").alias("best"))
    return rows.select(
        "doc_id",
        "n_paragraphs",
        "n_candidates",
        F.size("predicted").cast("long").alias("n_predicted"),
        F.size(F.filter("predicted", lambda p: p["confirmed"])).cast("long").alias("n_confirmed"),
        F.coalesce("best.family", F.when(F.col("n_candidates") > 0, F.lit(UNKNOWN))).alias("license"),
        F.round("best.probability", 6).alias("probability"),
        F.round("best.similarity", 6).alias("similarity"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread_documents(spark, sf_dir))
