"""License scan by MinHash bands over overlapping text windows, in DataFrame operations only.

Words are runs of letters and digits in lower case; a shingle is five
consecutive words.  Every document's shingle hashes are compared with those of
all templates, which leaves the documents that can match at all.  Their
shingles are cut into overlapping windows at each scale of template sizes: a
scale is a power of two at least twice a template's shingles, and windows begin
every half scale, so that some window holds the whole template, and is under four times
its size.  Windows and templates meet on MinHash bands of one row.  A template of
which a share t is there has a similarity of t / (5 - t) or more with that window,
so that BANDS bands miss it with a chance of (1 - t / (5 - t)) ** BANDS: one in ten
thousand at the threshold of 0.8.  A retrieved template is verified by exact
containment: the share of its shingles that the document has.  identify() then leaves the best of
templates that rival each other, such as the versions of a license.

Defined cases: a null text or one of fewer than five words has no shingle and
matches nothing; a template of fewer than five words is never matched; a
document may match several templates, or one in several places, and gives one
row for each template; a template spread over a text longer than its window may
be missed; repeated documents give a row each; a very long text is hashed whole
within its row and its windows are rows of their own; an empty table gives no
rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

WIDTH = 5
BANDS = 44
THRESHOLD = 0.8
#: Shingles of all templates up to which a plan holds them as a set; more are joined.
LITERAL_SHINGLES = 200_000

_GNU = "This {0} is free software{2} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} {} International License."

# Notices by which works say their license, and whole licenses.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": _GNU.format("program", "Affero General Public License", ":", ",", 3),
    "Artistic-2.0": "Released under the Artistic License 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-4.0": _CC.format("Attribution", "4.0"),
    "CC-BY-NC-4.0-notice": _CC.format("Attribution-NonCommercial", "4.0"),
    "CC-BY-NC-ND-4.0": _CC.format("Attribution-NonCommercial-NoDerivatives", "4.0"),
    "CC-BY-NC-SA-4.0": _CC.format("Attribution-NonCommercial-ShareAlike", "4.0"),
    "CC-BY-ND-4.0": _CC.format("Attribution-NoDerivatives", "4.0"),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-1.0-notice": _GNU.format("program", "General Public License", ";", ";", 1),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": _GNU.format("program", "General Public License", ";", ";", 2),
    "GPL-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.0-notice": _GNU.format("library", "Library General Public License", ";", ";", 2),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-notice": _GNU.format("library", "Lesser General Public License", ";", ";", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-notice": _GNU.format("program", "Lesser General Public License", ":", ",", 3),
    "MPL-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
}
TEMPLATES = NOTICES | {f"{p.stem}-license": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, text) rows."""
    return spark.createDataFrame(list(templates.items()), "license string, text string")


def _with_shingles(df: DataFrame) -> DataFrame:
    """df with h, the hashes of all shingles of text in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    each = ", ".join(f"__w[i + {j}]" for j in range(WIDTH))
    return df.withColumn("h", F.expr(f"if(size(__w) < {WIDTH}, array(), transform(sequence(0, size(__w) - {WIDTH}), i -> xxhash64({each})))")).drop("__w")


def _scale() -> Column:
    """A power of two, at least twice the size of h; 0 without shingles."""
    return F.when(F.size("h") == 0, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * F.size("h")))).cast("int"))


def _bands(values: str) -> Column:
    """(band, value) pairs: the least of the values' hashes under each band's seed."""
    seeds = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(seeds, lambda s: F.struct(s.alias("band"), F.array_min(F.transform(values, lambda x: F.xxhash64(s, x))).alias("value")))


def _known(spark: SparkSession, templates: DataFrame | None) -> DataFrame:
    table = templates if templates is not None else template_table(spark)
    # written: else the hashes of long texts are made again for every use
    shingles = written(_with_shingles(table).select("license", F.array_distinct("h").alias("h")), "license-templates")
    return shingles.withColumn("scale", _scale()).where("scale > 0")


def _candidates(docs: DataFrame, shingles: list[int], most: int) -> DataFrame:
    """A table of row, doc_id, h and hits (the templates' shingles that the document has) for every document that has any."""
    own = _with_shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    if len(shingles) <= most:
        # one look into a set for each shingle of a document, however many the templates have
        own = own.withColumn("hits", F.expr(f"array_distinct(filter(h, x -> x in ({', '.join(f'{x}L' for x in shingles)})))"))
        # the id comes first: Spark moves no filter below it, and so hashes no text twice
        return written(own.withColumn("row", F.monotonically_increasing_id()).where("size(hits) > 0"), "license-candidates")
    table = written(own.withColumn("row", F.monotonically_increasing_id()), "license-shingles")
    every = docs.sparkSession.createDataFrame([(x,) for x in shingles], "x long")
    hits = table.select("row", F.explode(F.array_distinct("h")).alias("x")).join(every, "x").groupBy("row").agg(F.collect_list("x").alias("hits"))
    return written(table.join(hits, "row"), "license-candidates")


def _matches(docs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """row, doc_id, license, share and hits (the template's shingles that the document has) of each document and template that it holds."""
    rows = known.collect()
    if not rows:
        return docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("share"), F.array().cast("array<bigint>").alias("hits")).where("false")
    can = _candidates(docs, sorted({x for r in rows for x in r["h"]}), LITERAL_SHINGLES)
    # a document with fewer of the templates' shingles than the least template of a scale needs holds none of them
    least = {s: threshold * min(len(r["h"]) for r in rows if r["scale"] == s) for s in sorted({r["scale"] for r in rows})}
    scales = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(0.999 * n).alias("least")) for s, n in least.items()])
    starts = can.select("row", "h", "hits", F.explode(F.filter(scales, lambda x: F.size("hits") >= x["least"])).alias("x")).select("row", "h", "hits", "x.scale")
    starts = starts.withColumn("at", F.explode(F.expr("sequence(1, size(h), greatest(1, scale div 2))")))
    window = starts.select("row", "scale", "hits", F.slice("h", F.col("at"), F.col("scale")).alias("w")).where(F.arrays_overlap("w", "hits"))
    banded = window.select("row", "scale", F.explode(_bands("w")).alias("x")).select("row", "scale", "x.band", "x.value")
    of_templates = known.select("license", "scale", F.explode(_bands("h")).alias("x")).select("license", "scale", "x.band", "x.value")
    if len(rows) <= 10_000:  # BANDS rows for each template
        of_templates = F.broadcast(of_templates)
    pairs = banded.join(of_templates, ["scale", "band", "value"]).select("row", "license").distinct()
    sets = known.select("license", F.col("h").alias("t"))
    sets = F.broadcast(sets) if len(rows) <= 10_000 else sets
    checked = pairs.join(can.select("row", "doc_id", F.col("hits").alias("own")), "row").join(sets, "license")
    checked = checked.select("row", "doc_id", "license", F.size("t").alias("n"), F.array_intersect("t", "own").alias("hits"))
    return checked.select("row", "doc_id", "license", F.round(F.size("hits") / F.col("n"), 6).alias("share"), "hits").where(F.col("share") >= threshold)


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license and containment, one row for each document and template that it holds.

    templates: (license, text), a small table that grows with licenses, not with documents: it is collected.
    """
    return _matches(docs, _known(docs.sparkSession, templates), threshold).select("doc_id", "license", F.col("share").alias("containment"))


def identify(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """scan() without the templates that a rival explains better.

    A template goes if the document holds another one, of a higher score (shingles found less shingles missing), and less
    than the threshold of what sets it apart from that one.  A document that holds two versions in full keeps both.
    """
    known = _known(docs.sparkSession, templates)
    found = written(_matches(docs, known, threshold), "license-matches")
    one, other = known.select("license", F.col("h").alias("t")), known.select(F.col("license").alias("rival"), F.col("h").alias("s"))
    apart = one.join(other, (F.col("license") != F.col("rival")) & F.arrays_overlap("t", "s")).select("license", "rival", F.array_except("t", "s").alias("apart"))
    score = (F.size("hits") * (2 - 1 / F.col("share"))).alias("score")
    mine = found.select("row", "license", "hits", score)
    rivals = found.select("row", F.col("license").alias("rival"), score.alias("best"))
    pairs = mine.join(rivals, "row").where("license != rival and (best > score or best = score and rival < license)")
    lost = pairs.join(F.broadcast(apart), ["license", "rival"]).where((F.size("apart") == 0) | (F.size(F.array_intersect("apart", "hits")) < threshold * F.size("apart")))
    return found.join(lost.select("row", "license").distinct(), ["row", "license"], "left_anti").select("doc_id", "license", F.col("share").alias("containment"))
