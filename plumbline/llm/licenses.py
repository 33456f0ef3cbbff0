"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A file's units are its lines with a licence cue, each alone and with the one or two lines after it (notices and titles run over
lines) while these are `NOTICE_CHARS` together, the ids of `SPDX-License-Identifier` lines, and, if its name is that of a licence file, its whole text.
Units and templates are sparse TF-IDF vectors, with document frequencies over all units and templates;
dot products come from an equi-join on the token. A file takes the template most like any of its units, from
`THRESHOLD` on (ties: the smaller licence id); a whole text that is almost a template, from `VERBATIM` on, goes before lines, which
licences share. Of the long licences (Apache, GNU, Mozilla, Eclipse, Boost) titles and notices are
templates, not the whole texts. A file without one inherits that of the nearest
directory, its own or an ancestor, with a licence file (of several there the most alike, then the smaller id); ancestors
are exploded from distinct directories and equi-joined.

Null and empty texts have no units and can only inherit; a file with a null path inherits nothing. Repeated rows each
get their row. Extra columns are kept out.

Texts are read three times: for the files' names, for the tokens of lines and for those of licence files. All else follows from what
these wrote, so that no plan holds a scan of the texts more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .licence_texts import WHOLE

THRESHOLD, VERBATIM = 0.6, 0.85
#: Lines are joined as long as they could be a notice or a title, the longest of which has about 250 characters.
NOTICE_CHARS = 300
BROADCAST_ROWS = 100_000
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)s?([-._].*)?$"
CUE = r"(?i)licen[cs]|creative commons|copyright|permission|redistribut|public domain|all rights"

# Notices as their licences word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Copyright. All rights reserved. Licensed under the Apache License, Version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Proprietary", "Copyright. All rights reserved."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *WHOLE,
]
#: By rule: each licence by its id, those of the GNU family also by the two forms that replaced it.
TEMPLATES += [(i, f"spdx-{i}{form}") for i in sorted({i for i, _ in TEMPLATES} - {"Proprietary"}) for form in ("", "-only", "-or-later") if not form or "GPL" in i]
SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9.+() -]+)"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def _words(units: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens)."""
    return units.select(*keys, F.expr(r"regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*', 0)").alias("tokens"))


def _tokens(said: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, tf)."""
    return said.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def named_as_licence(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE)


def units(files: DataFrame) -> DataFrame:
    """(a, b, unit, text) of files (a, b, path, text), `a` and `b` their names; the whole text of a licence file is unit -1."""
    rows = files.select("a", "b", F.split("text", r"\n").alias("ls"))
    # Of line i: unit 4 i its ids, 4 i + k it and what follows it, k lines in all. Ids become words of their own.
    ids = F.regexp_extract_all(F.regexp_extract("line", SPDX, 1), F.lit("[A-Za-z0-9][A-Za-z0-9.+-]*"), F.lit(0))
    names = F.array_join(F.transform(F.filter(ids, lambda x: ~x.isin("AND", "OR", "WITH")), lambda x: F.concat(F.lit("spdx-"), x)), " ")
    after = lambda i, k: F.array_join(F.slice("ls", i + 1, F.lit(k)), " ")
    few = lambda i, k: (F.length(after(i, k)) <= NOTICE_CHARS) if k > 1 else F.lit(True)
    lines = F.transform("ls", lambda line, i: F.when(line.rlike(CUE), F.struct(i.alias("i"), line.alias("line"), F.array(*(F.when((i + k <= F.size("ls")) & few(i, k), after(i, k)) for k in (1, 2, 3))).alias("texts"))))
    found = rows.select("a", "b", F.explode(F.array_compact(lines)).alias("c")).select("a", "b", "c.i", "c.line", "c.texts")
    each = found.select("a", "b", "i", F.posexplode(F.concat(F.array(F.when(names != "", names)), "texts")).alias("k", "text")).where("text IS NOT NULL")
    named = files.where(named_as_licence(F.col("path"))).where("text <> ''")
    return each.select("a", "b", (4 * F.col("i") + F.col("k")).alias("unit"), "text").unionByName(named.select("a", "b", F.lit(-1).alias("unit"), "text"))


def matches(found: DataFrame, copies: DataFrame, patterns: DataFrame) -> DataFrame:
    """(a, b, unit, license_id, score): each unit's best template. `copies` (a, b, m) are names of rows that are there m times, not once."""
    patterns = patterns.where("text IS NOT NULL").select("license_id", "text", F.xxhash64("license_id", "text").alias("template")).dropDuplicates(["template"])
    keys = ("a", "b", "unit")
    said = materialize(_words(found, *keys))
    # Texts are not shuffled to find copies: their counts are divided instead.
    of_units = _tokens(said, *keys).join(copies, ["a", "b"], "left").select(*keys, "token", F.expr("tf div coalesce(m, 1)").alias("tf"))
    of_patterns = _tokens(_words(patterns, "license_id", "template"), "license_id", "template")
    seen = of_units.select("token").unionByName(of_patterns.select("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = said.select(*keys).distinct().select(F.lit(1)).unionByName(patterns.select(F.lit(1))).agg(F.count("*").alias("n_units"))
    idf = seen.join(F.broadcast(n)).select("token", (F.log((1 + F.col("n_units")) / (1 + F.col("df"))) + 1).alias("idf"))
    weigh = lambda df, *by: df.join(idf, "token").select(*by, "token", (F.col("tf") * F.col("idf")).alias("w"))
    unit_w, pattern_w = weigh(of_units, *keys), weigh(of_patterns, "license_id", "template")
    norm = lambda df, *by: df.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit_norm, pattern_norm = norm(unit_w, *keys), norm(pattern_w, "license_id", "template")
    # Templates are a given table: broadcast only if it is small, else an ordinary join.
    small = of_patterns.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = pattern_w.join(pattern_norm, ["license_id", "template"]).select("license_id", "template", "token", (F.col("w") / F.col("norm")).alias("v"))
    side = F.broadcast(side) if small else side
    dots = unit_w.join(side, "token").groupBy(*keys, "license_id", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(unit_norm, list(keys)).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("o"), "license_id")).alias("best"))
    return best.select(*keys, "best.license_id", (-F.col("best.o")).alias("score"))


def scan(files: DataFrame, patterns: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license_id, score, found, licence_dir) of files (id, path, text); found: own, inherited or null."""
    text = F.coalesce("text", F.lit(""))
    # Files go by 128 bits of path and text; two equal files are one.
    name = [F.xxhash64(F.lit(i), F.col("path"), F.col("path").isNull(), text) for i in (0, 1)]
    whole = files.select("id", "path", text.alias("text"), name[0].alias("a"), name[1].alias("b"))
    rows = materialize(whole.drop("text"))
    copies = rows.groupBy("a", "b").agg(F.count("*").alias("m")).where("m > 1")
    hits = matches(units(whole.drop("id")), copies, patterns).where(F.col("score") >= threshold)
    first = (F.col("unit") == -1) & (F.col("score") >= VERBATIM)
    best = F.min(F.struct((~first).alias("part"), (-F.col("score")).alias("o"), "license_id"))
    own = materialize(hits.groupBy("a", "b").agg(best.alias("best")).select("a", "b", F.struct("best.o", "best.license_id").alias("own")))
    joined = rows.join(own, ["a", "b"], "left")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    licence_files = rows.where("path IS NOT NULL").where(named_as_licence(F.col("path"))).join(own, ["a", "b"])
    of_dir = licence_files.select(folder.alias("licence_dir"), "own").groupBy("licence_dir").agg(F.min("own").alias("of_dir"))
    # A directory and its ancestors, the root as ''.
    folders = rows.where("path IS NOT NULL").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    up = F.expr("transform(sequence(0, IF(folder = '', 0, size(parts))), n -> struct(n, array_join(slice(parts, 1, n), '/') AS dir))")
    ancestors = folders.withColumn("parts", parts).select("folder", F.explode(up).alias("a")).select("folder", "a.n", F.col("a.dir").alias("licence_dir"))
    nearest = ancestors.join(of_dir, "licence_dir").groupBy("folder").agg(F.max_by(F.struct("licence_dir", "of_dir"), "n").alias("near"))
    joined = joined.withColumn("folder", folder).join(nearest, "folder", "left")
    given = F.coalesce("own", "near.of_dir")
    return joined.select(
        "id",
        "path",
        given["license_id"].alias("license_id"),
        (-given["o"]).alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("found"),
        F.when(F.col("own").isNull(), F.col("near.licence_dir")).alias("licence_dir"),
    )


def files_of_documents(docs: DataFrame) -> DataFrame:
    """The documents laid out as files, as the table has no paths: source/thousand/hundred/id, each hundredth one a licence file of its thousand."""
    n = F.col("doc_id")
    thousand = F.floor(n / 1000).cast("string")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.when(n % 100 == 0, F.concat_ws("/", "source", thousand, F.concat(F.lit("LICENSE-"), n.cast("string"))))
        .otherwise(F.concat_ws("/", "source", thousand, F.floor(n / 100).cast("string"), F.concat(n.cast("string"), F.lit(".txt"))))
        .alias("path"),
        "text",
    )
