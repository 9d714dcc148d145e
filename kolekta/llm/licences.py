"""Licence scan: a paragraph classifier trained here, with a calibrated unknown
class, whose predictions a comparison with templates confirms.

A paragraph is a line, or a run of lines up to one that ends a sentence. Its features are hashed word 1-, 2- and 3-grams. A multinomial logistic
regression (Spark ML) learns the families from variants of TEMPLATES and the
unknown class from paragraphs of the corpus. A part of the training rows is
kept back to fit the temperature that calibrates the probabilities; what no
family claims with PROBABILITY is unknown. A family counts only if one of its
templates stands in the paragraph, to CONTAINED of the template's word pairs,
or one of its short CORES does, as a run of words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import blocks, byte_texts, plain_words, read_table, stored

# FIXED VALUES: notices as the licences or their stewards word them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "BSD": [
        "Licensed under the BSD License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License",
        "GNU General Public License Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "All-rights-reserved": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited.",
    ],
}

# The shortest wordings that name a family by themselves.
CORES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License", "Apache-2.0 License", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["MIT License", "MIT-licensed", "SPDX-License-Identifier: MIT"],
    "BSD": ["BSD License", "BSD-style license", "BSD 2-Clause License", "BSD 3-Clause License",
            "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL": ["GNU General Public License", "GNU GPL", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "SPDX-License-Identifier: AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "All-rights-reserved": ["All rights reserved"],
}
# END OF FIXED VALUES

UNKNOWN = "unknown"
BITS = 15
#: Paragraphs of the corpus that the unknown class is learned from, and their longest size in bytes.
SAMPLE, SAMPLE_BYTES = 2048, 2000
#: Variants of each template, and the share of training rows kept back for calibration.
VARIANTS, HELD_BACK = 24, 4
PROBABILITY, CONTAINED = 0.5, 0.8


def paragraphs(text: bytes) -> list[bytes]:
    """Lines, and what wrapped lines (up to one that ends in . ! ? or :, or an empty one) are together."""
    out, run = [], []
    for line in [*text.split(b"\n"), b""]:
        line = line.strip()
        if line:
            run.append(line)
            out.append(line)
        if run and (not line or line[-1:] in b".!?:"):
            if len(run) > 1:
                out.append(b" ".join(run))
            run = []
    return out


def grams(words: list[list[bytes]], bits: int = BITS):
    """(paragraph, index, scale): hashed 1-, 2- and 3-grams of some paragraphs, and
    the weight 1/sqrt(n) that each of a paragraph's n features has."""
    import numpy as np
    from xxhash import xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    h = np.fromiter((xxh64_intdigest(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    shift, whole, index, where = np.uint64(64 - bits), h, [], []
    for n in (1, 2, 3):
        if n > 1:
            whole = (whole[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[n - 1:] if len(h) >= n else whole[:0]
        same = of[:len(whole)] == of[n - 1:] if len(whole) else np.zeros(0, bool)
        index.append(((whole * np.uint64(0xD6E8FEB86659FD93)) >> shift)[same].astype(np.int64))
        where.append(of[:len(whole)][same])
    of = np.concatenate(where)
    n = np.bincount(of, minlength=len(words))
    return of, np.concatenate(index), 1.0 / np.sqrt(np.maximum(n, 1))


def variants(seed: int = 7):
    """(family, text) of altered templates and cores: words dropped, notices before, other words after."""
    import random
    draw = random.Random(seed)
    filler = "project module work file data text source author page value version name part list".split()
    for family, templates in TEMPLATES.items():
        for t in [*templates, *CORES[family]]:
            yield family, t
            for k in range(VARIANTS):
                words = [w for w in t.split() if len(t.split()) < 8 or draw.random() > 0.04]
                before = ["", "Copyright (c) 20%02d" % draw.randrange(100), "SPDX", "//", "This"][k % 5].split()
                after = [draw.choice(filler) for _ in range(draw.randrange(0, 12, 3))]
                yield family, " ".join([*before, *words, *after])


def spaced(words: list[bytes]) -> bytes:
    """Words with a space around each: a run of words stands in others if its form does."""
    return b" " + b" ".join(words) + b" "


class Classifier:
    """Weights (features by classes), biases, the temperature, the templates' word pairs and the cores."""

    def __init__(self, names, weights, bias, temperature):
        self.names, self.weights, self.bias, self.temperature = names, weights, bias, temperature
        self.pairs = {f: [set(zip(w, w[1:])) for w in (plain_words(t.encode()) for t in ts)] for f, ts in TEMPLATES.items()}
        self.cores = {f: [spaced(plain_words(t.encode())) for t in ts] for f, ts in CORES.items()}

    def logits(self, words):
        import numpy as np
        of, index, scale = grams(words)
        out = np.stack([np.bincount(of, c[index], len(words)) for c in self.weights.T], 1)
        return out * scale[:, None] + self.bias

    def probabilities(self, words):
        import numpy as np
        x = self.logits(words) / self.temperature
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def contained(self, family: str, words: list[bytes]) -> float:
        """Largest share of a template's word pairs that the paragraph holds; 1 if it holds a core."""
        whole = spaced(words)
        if any(core in whole for core in self.cores[family]):
            return 1.0
        own = set(zip(words, words[1:]))
        return max((len(t & own) / len(t) for t in self.pairs[family]), default=0.0)

    def find(self, texts: list[bytes]) -> list[dict[str, float]]:
        """Confirmed families of each text with their largest probability."""
        import numpy as np
        split = [[plain_words(p) for p in paragraphs(t)] for t in texts]
        flat, of = [p for ps in split for p in ps], [i for i, ps in enumerate(split) for _ in ps]
        found: list[dict[str, float]] = [{} for _ in texts]
        if not flat:
            return found
        p = self.probabilities(flat)
        p[:, self.names.index(UNKNOWN)] = 0
        for i in np.flatnonzero(p.max(1) >= PROBABILITY):
            k = int(p[i].argmax())
            family = self.names[k]
            if self.contained(family, flat[i]) >= CONTAINED:
                best = found[of[i]]
                best[family] = max(best.get(family, 0.0), float(p[i, k]))
        return found


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on variants of the templates and at most ``sample`` corpus paragraphs.

    The sample takes paragraphs of at most SAMPLE_BYTES and the smallest
    hashes that hold no template and no core; each task passes on its own smallest.
    """
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    spark = docs.sparkSession
    templates = [set(zip(w, w[1:])) for ts in TEMPLATES.values() for w in (plain_words(t.encode()) for t in ts)]
    cores = [spaced(plain_words(t.encode())) for ts in CORES.values() for t in ts]

    def pick(batches):
        import heapq

        import pyarrow as pa
        from xxhash import xxh64_intdigest
        least: list = []
        for b in batches:
            for t in byte_texts(b.column(0)):
                for p in set(paragraphs(t)):
                    key = -(xxh64_intdigest(p, 3) >> 1)
                    if len(p) > SAMPLE_BYTES or (len(least) >= sample and key <= least[0][0]):
                        continue
                    words = plain_words(p)
                    own, whole = set(zip(words, words[1:])), spaced(words)
                    if any(core in whole for core in cores) or any(len(t & own) >= CONTAINED * len(t) for t in templates):
                        continue
                    (heapq.heappushpop if len(least) >= sample else heapq.heappush)(least, (key, p))
        yield pa.RecordBatch.from_arrays([pa.array([-k for k, _ in least], pa.int64()),
                                          pa.array([p.decode(errors="replace") for _, p in least], pa.string())], ["h", "p"])

    # Written first: a collected limit would send the first rows of every task to the driver.
    picked = stored(docs.select("text").mapInArrow(pick, "h long, p string").distinct().orderBy("h", "p").limit(sample),
                    "paragraphs").collect()
    rows = [(f, t) for f, t in variants()] + [(UNKNOWN, r.p) for r in picked] + [(UNKNOWN, "")]
    names = [UNKNOWN, *TEMPLATES]
    words = [plain_words(t.encode()) for _, t in rows]
    of, index, scale = grams(words)
    held = np.arange(len(rows)) % HELD_BACK == 1
    vectors = []
    for i in range(len(rows)):
        k, n = np.unique(index[of == i], return_counts=True)
        vectors.append((float(names.index(rows[i][0])), Vectors.sparse(1 << BITS, k.tolist(), (n * scale[i]).tolist())))
    fit = spark.createDataFrame([v for v, h in zip(vectors, held) if not h], ["label", "features"]).coalesce(1).cache()
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=1e-4, standardization=False).fit(fit)
    fit.unpersist()
    found = Classifier(names, model.coefficientMatrix.toArray().T.copy(), model.interceptVector.toArray(), 1.0)
    logits = found.logits([w for w, h in zip(words, held) if h])
    truth = np.array([names.index(f) for (f, _), h in zip(rows, held) if h])

    def loss(t):
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), truth]).mean())

    found.temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return found


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, licence, probability, families) of every row of ``docs(doc_id, text)``.

    families: the confirmed families, sorted; licence: the most probable (the
    first of equals), null if none, as for null and empty texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(
        (classifier.names, classifier.weights.astype("float32"), classifier.bias, classifier.temperature))

    def run(batches):
        import pyarrow as pa
        c = Classifier(*held.value)
        for b in batches:
            texts = byte_texts(b.column(1))
            for i, k in blocks(texts):
                found = c.find(texts[i:k])
                best = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, k - i), pa.array([x for x, _ in best], pa.string()), pa.array([p for _, p in best]),
                     pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                    ["doc_id", "licence", "probability", "families"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, licence string, probability double, families array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: licence families found in every document."""
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
