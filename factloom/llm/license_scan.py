"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Terms are weighted by their document frequency over all documents (counted by Spark for the templates' terms only, a
few hundred, so the counts are bounded; other terms weigh as if unseen). A text's header lines, and paragraphs of
adjacent lines, that speak of licensing are compared with every template; the best one at or above the threshold is
the document's own licence; one that states a licence which no template matches is `unknown` and inherits none. Licence files give theirs to their directory. Directories, not documents, walk up their
ancestors by joins on the path; documents then take what their own directory has found.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

THRESHOLD = 0.5
TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
HINTS = ("licen", "copyright", "permission", "redistribut", "public domain", "spdx", "warrant")

# Phrases of public licence headers and files by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only LGPL-3.0-or-later"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only AGPL-3.0-or-later"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "ISC": ("Released under the ISC License. SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
#: Creative Commons licences by attribution, in short and long wording, for each version.
CREATIVE_COMMONS = {
    "BY": ("Attribution",),
    "BY-SA": ("Attribution-ShareAlike",),
    "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs"),
    "BY-NC": ("Attribution-NonCommercial", "Attribution-Non-Commercial"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-ShareAlike"),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}
for _kind, _names in CREATIVE_COMMONS.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _short = [f"Licensed under {x} {_version}." for x in (f"CC {_kind}", f"CC-{_kind}", f"CC {_kind.replace('-', ' ')}")]
        _long = [f"This work is licensed under a Creative Commons {x} {_version} International License." for n in _names for x in (n, n.replace("-", " "))]
        _links = [f"SPDX-License-Identifier: CC-{_kind}-{_version}", f"https://creativecommons.org/licenses/{_kind.lower()}/{_version}/ license"]
        TEMPLATES[f"CC-{_kind}-{_version}"] = tuple(dict.fromkeys((*TEMPLATES.get(f"CC-{_kind}-{_version}", ()), *_short, *_long, *_links)))

#: What a text has whose stated licence no template matches.
UNKNOWN = "unknown"
STATED = re.compile(r"\blicen[sc]ed\s+(?:to\s+\S+\s+)?under\b|\b(?:released|distributed|published|available|provided)\s+under\b[^.]{0,80}\blicen[sc]e|spdx-license-identifier\s*:\s*\S")

VOCABULARY = frozenset(t for texts in TEMPLATES.values() for x in texts for t in TERM.findall(x.lower()))


class Weights:
    """TF-IDF vectors of the templates, and the cosine of any text to them."""

    def __init__(self, n_docs: int, frequency: dict[str, int]):
        self.idf = {t: 1 + math.log((1 + n_docs) / (1 + frequency.get(t, 0))) for t in VOCABULARY}
        self.unseen = 1 + math.log(1 + n_docs)
        self.templates = [(name, v) for name in sorted(TEMPLATES) for x in TEMPLATES[name] for v in [self.unit(x)]]

    def unit(self, text: str) -> dict[str, float]:
        counts = Counter(TERM.findall(text.lower()))
        v = {t: n * self.idf.get(t, self.unseen) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str) -> tuple[float, str]:
        v = self.unit(text)
        return max((sum(w * v[t] for t, w in own.items() if t in v), name) for name, own in self.templates)


def hinted(text: str) -> bool:
    return any(h in text for h in HINTS)


def units(text: str) -> list[str]:
    """Lines that speak of licensing, and runs of adjacent non-blank lines around them."""
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            run.append(line)
            continue
        marked = [x for x in run if hinted(x.lower())]
        out += marked
        if marked and len(run) > 1:
            out.append(" ".join(run))
        run = []
    return out


def own_license(text: str | None, weights: Weights, threshold: float = THRESHOLD) -> tuple[str | None, float]:
    """The best template's name and cosine; below the threshold UNKNOWN where a licence is stated, else None (0 where nothing speaks of it)."""
    if not text or not hinted(text.lower()):
        return None, 0.0
    told = units(text)
    score, name = max(map(weights.best, told), default=(0.0, None))
    if score < threshold:
        name = UNKNOWN if any(STATED.search(x.lower()) for x in told) else None
    return name, round(min(1.0, score), 6)


def term_frequencies(docs: DataFrame, text: Column) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each term of the templates."""

    @F.pandas_udf("array<string>")
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sorted(VOCABULARY.intersection(TERM.findall((t or "").lower()))) for t in batch], dtype=object)

    counted = docs.select(F.explode_outer(terms(text)).alias("term")).groupBy("term").count().collect()
    return docs.count(), {r["term"]: r["count"] for r in counted if r["term"] is not None}


def scan(docs: DataFrame, id_col: str, text_col: str, path_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, inherited_from): a row for each row of docs.

    A licence file is one whose name is LICENSE, LICENCE, COPYING or NOTICE with any extension; its directory has the
    licence of its best-scored file (ties: first by name). A document without a licence of its own takes that of the
    nearest directory above it, its own included. Null and empty texts have none of their own; a null path inherits
    nothing. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    weights = Weights(*term_frequencies(rows, F.col("text")))

    @F.pandas_udf("name string, score double")
    def licensed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([own_license(t, weights, threshold) for t in batch], columns=["name", "score"])

    parts = F.split("path", "/")
    each = rows.select("doc_id", "path", licensed("text").alias("l"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("file"))
    each = cut(each.selectExpr("doc_id", "path", "dir", "file", "l.name AS own_license", "l.score AS own_score"))
    files = each.where("own_license IS NOT NULL AND upper(file) RLIKE '^(LICEN[SC]E|COPYING|NOTICE)([.].*)?$'")
    given = files.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license", "path")).alias("license"))
    steps = "transform(sequence(0, size(split(dir, '/'))), n -> struct(n AS depth, array_join(slice(split(dir, '/'), 1, n), '/') AS up))"
    above = each.select("dir").where("dir IS NOT NULL").distinct().selectExpr("dir", f"inline(array_distinct({steps}))")
    found = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("near"))
    out = each.join(found, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "near.license").alias("license"), F.when(~own, F.col("near.up")).alias("inherited_from"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence of every document. The tables have no paths, so a document's path is made of its source and id; a short
    document that speaks of licensing stands as its directory's licence file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = "IF(char_length(text) < 1000 AND text ILIKE '%licen%', concat('LICENSE.', doc_id), concat(doc_id, '.txt'))"
    path = f"concat_ws('/', coalesce(source, 'none'), CAST(doc_id div 1000 AS STRING), CAST(doc_id div 50 AS STRING), {name})"
    return scan(docs.selectExpr("doc_id", "text", f"{path} AS path"), "doc_id", "text", "path")
