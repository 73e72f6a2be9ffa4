"""License notices in documents, with DataFrame functions only.

Texts and templates are words (runs of letters and digits, lower case) and their five-word
shingles.  Templates of fewer than WINDOW shingles are retrieved by any one of their shingles, so
a notice that contains three quarters of them is always met.  Longer templates are cut into
windows of WINDOW shingles, every half window, and so are documents.  A window has BANDS MinHash
values, one a band; a document's window lies at most a quarter window away from a template's, so
their similarity is 0.6 or more for a verbatim copy and a band agrees with a chance of 1 - 0.4**12.

A retrieved template is verified by exact containment: the share of its distinct shingles that
occur in the part of the document that can hold it around the hit.  Notices that differ by a word
or a version hold most of each other's shingles; of such rivals only the most contained is reported
at a hit.

Full texts of licenses are known by a passage of their opening, so a part of one without it is not found.

Windows are arrays inside their row; only hits (row, place, band key and the shingles around) leave
it, and meet the templates' keys, whose number depends on the templates alone.

Defined cases: null and empty texts, and texts under five words, have no notices; repeated rows are
reported once; null ids are allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize, rows_of, text_of

CONTAINMENT = 0.75
WINDOW = 12
BANDS = 12

# fixed values: public license notices
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT licensed": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "Apache-2.0 notice": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-2.0 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
        "your option) any later version."
    ),
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."
    ),
    "LGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "BSD-3-Clause": (  # after the holder's name, which differs
        "nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MPL-1.1 notice": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not "
        "use this file except in compliance with the License."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
    "CC-BY-ND-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."
    ),
    "CC-BY-NC-SA-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    ),
    "CC-BY-NC-ND-4.0 notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."
    ),
    # full texts, by a passage of their opening that no other license has
    "Apache-2.0 text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, "
        "reproduction, and distribution as defined by Sections 1 through 9 of this document."
    ),
    "GPL-2.0 text": (
        "Preamble The licenses for most software are designed to take away your freedom to share and change it. By "
        "contrast, the GNU General Public License is intended to guarantee your freedom to share and change free "
        "software--to make sure the software is free for all its users."
    ),
    "GPL-3.0 text": (
        "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The "
        "licenses for most software and other practical works are designed to take away your freedom to share and change "
        "the works."
    ),
    "AGPL-3.0 text": (
        "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software."
    ),
    "LGPL-2 text": (  # 2.0 and 2.1
        "Preamble The licenses for most software are designed to take away your freedom to share and change it. By "
        "contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free "
        "software--to make sure the software is free for all its users."
    ),
    "LGPL-2.1 text": (
        "This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public "
        "License, version 2, hence the version number 2.1."
    ),
    "LGPL-3.0 text": (
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the "
        "GNU General Public License, supplemented by the additional permissions listed below."
    ),
    "MPL-2.0 text": (
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that "
        "creates, contributes to the creation of, or owns Covered Software."
    ),
    "CC0-1.0 text": (
        "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE "
        "LEGAL SERVICES."
    ),
}


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; null below five words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def joined(left: Column, right: Column, shift: int, n: Column) -> Column:
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))

    def of_five(h: Column) -> Column:
        pairs = F.array(joined(h, h, 1, F.size(h) - 1))
        fours = F.transform(pairs, lambda p: joined(p, p, 2, F.size(p) - 2))
        return F.when(F.size(h) >= 5, F.get(F.transform(fours, lambda q: joined(q, h, 4, F.size(q) - 1)), F.lit(0)))

    return F.get(F.transform(F.array(hashed), of_five), F.lit(0))


def _band_keys(window: Column) -> list[Column]:
    """MinHash of a window for each band, under orders that differ by an exclusive or."""
    orders = [F.xxhash64(F.lit(band), F.lit(17)) for band in range(BANDS)]
    return [F.xxhash64(F.lit(band), _least(window, order)) for band, order in enumerate(orders)]


def _least(window: Column, order: Column) -> Column:
    return F.array_min(F.transform(window, lambda s: s.bitwiseXOR(order)))


def _windows(all_shingles: Column) -> Column:
    """(start, shingles) of the windows, the last one flush with the end."""
    last = F.greatest(F.size(all_shingles) - WINDOW, F.lit(0))
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(WINDOW // 2)), last))
    return F.transform(
        starts, lambda i: F.struct(i.alias("start"), F.slice(all_shingles, i + 1, F.lit(WINDOW)).alias("window"))
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, its distinct shingles, and the keys that retrieve it."""
    rows = spark.createDataFrame(list(templates.items()), "license string, t_text string")
    rows = rows.withColumn("all", shingles(F.col("t_text"))).where("all is not null").drop("t_text")
    long_keys = F.flatten(F.transform(_windows(F.col("all")), lambda w: F.array(*_band_keys(w["window"]))))
    return rows.select(
        "license",
        F.array_distinct("all").alias("own"),
        F.when(F.size("all") < WINDOW, F.col("all")).otherwise(F.array_distinct(long_keys)).alias("keys"),
        (F.size("all") < WINDOW).alias("short"),
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment and the first shingle of the hit, for each notice found in a document."""
    spark = docs.sparkSession
    table = materialize(template_table(spark, templates), "templates")
    known = table.collect()  # as large as the templates given
    short = sorted({k for r in known if r["short"] for k in r["keys"]})
    long = sorted({k for r in known if not r["short"] for k in r["keys"]})
    own = {r["license"]: set(r["own"]) for r in known}
    rivals = [
        (a, [sorted(other) for b, other in own.items() if a != b and len(mine & other) >= CONTAINMENT * len(mine)])
        for a, mine in own.items()
    ]
    reach = max((len(r["own"]) for r in known), default=1)
    text = text_of(docs, text_col)
    rows = rows_of(docs, id_col, key=F.xxhash64(text), s=shingles(text))

    def around(start: Column) -> Column:
        first = F.greatest(start - reach + 1, F.lit(0))
        return F.slice("s", first + 1, F.lit(2 * reach + WINDOW))

    single = F.filter(
        F.transform("s", lambda x, i: F.struct(i.alias("start"), x.alias("hit"))), lambda p: p["hit"].isin(short)
    )

    def in_window(w: Column) -> Column:
        hits = F.filter(F.array(*_band_keys(w["window"])), lambda k: k.isin(long))
        return F.transform(hits, lambda k: F.struct(w["start"].alias("start"), k.alias("hit")))

    banded = F.flatten(F.transform(_windows(F.col("s")), in_window))
    hits = F.concat(*([single] if short else []), *([banded] if long else []), F.array().cast("array<struct<start:int,hit:bigint>>"))
    described = F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), h["hit"].alias("hit"), around(h["start"]).alias("near"))
    )
    # written before any filter, which the optimizer would repeat inside the loops over the shingles
    found = materialize(
        rows.select("doc_id", "key", F.when(F.col("s").isNotNull(), described).alias("hits")), "hits"
    )
    found = found.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.*")
    described = table.join(spark.createDataFrame(rivals, "license string, rivals array<array<bigint>>"), "license")
    keyed = described.select("license", "own", "rivals", F.explode(F.array_distinct("keys")).alias("hit"))

    def share(template: Column) -> Column:
        return F.size(F.array_intersect(F.col("near"), template)) / F.size(template)

    verified = found.join(F.broadcast(keyed), "hit").withColumn("containment", share(F.col("own")))
    verified = verified.where(F.col("containment") >= CONTAINMENT)
    verified = verified.where(~F.exists("rivals", lambda r: share(r) > F.col("containment")))
    return verified.groupBy("doc_id", "key", "license").agg(
        F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_shingle")
    ).drop("key")
