"""Licence scans, in DataFrame functions only.

Header lines and licence files are sparse TF-IDF vectors over words and pairs
of words; the template with the greatest cosine is their licence. Terms weigh
by their frequency over all different units of the scan and the templates.
Units that are repeated, as most notices are, are scored once. Files without a
licence of their own inherit that of the nearest ancestor directory that holds
a licence file, found by joining the prefixes of their directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.plans.lineage import cut, small

_GNU = (("GPL", "2.0", "general", "june 1991"), ("GPL", "3.0", "general", "29 june 2007"), ("LGPL", "2.1", "lesser general", "february 1999"), ("LGPL", "3.0", "lesser general", "29 june 2007"), ("AGPL", "3.0", "affero general", "19 november 2007"))
_COMMONS = (("by", "attribution"), ("by-sa", "attribution-sharealike"), ("by-nc", "attribution-noncommercial"), ("by-nd", "attribution-noderivatives"), ("by-nc-sa", "attribution-noncommercial-sharealike"))
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: The notices by which licences are declared, and the texts of short licences, in words.
TEMPLATES = {
    "MIT": ("released under the mit license", "licensed under the mit license", "mit license", _GRANT.partition(" of this software")[0], f"mit license copyright {_GRANT} the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    "ISC": ("isc license", "licensed under the isc license", "isc license copyright permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    "Apache-2.0": ("licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "you may not use this file except in compliance with the license", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0"),
    "BSD-2-Clause": ("bsd 2-clause license", f"bsd 2-clause license copyright all rights reserved {_BSD} {_AS_IS}"),
    "BSD-3-Clause": ("released under the bsd license", "bsd 3-clause license", "redistribution and use in source and binary forms with or without modification are permitted", f"bsd 3-clause license copyright all rights reserved {_BSD} {_ENDORSE} {_AS_IS}"),
    "MPL-2.0": ("subject to the terms of the mozilla public license version 2.0", "mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    "CC0-1.0": ("dedicated to the public domain under cc0 1.0 universal", "creative commons cc0 1.0 universal"),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
    "All-rights-reserved": ("all rights reserved",),
}
#: The families whose notices differ in name and version only.
for _name, _version, _kind, _date in _GNU:
    _n = _version.removesuffix(".0")
    TEMPLATES[f"{_name}-{_version}"] = (f"gnu {_kind} public license version {_n}", f"this work is licensed under the gnu {_kind} public license version {_n}", f"gnu {_kind} public license version {_n} {_date}", f"{_name.lower()} v{_n} license", f"{_name.lower()}-{_version} license", f"under the terms of the gnu {_kind} public license as published by the free software foundation either version {_n} of the license or at your option any later version")
for _short, _long in _COMMONS:
    for _version in ("2.0", "3.0", "4.0"):
        TEMPLATES[f"CC-{_short.upper()}-{_version}"] = (f"cc {_short} {_version}", f"licensed under cc {_short} {_version}", f"creative commons {_long} {_version} international license" if _version == "4.0" else f"creative commons {_long} {_version} unported license")
#: A licence that stands only where no other does, since others quote it.
QUOTED = "All-rights-reserved"
#: A line is a header line if it has one of these, one of which is in every template.
TRIGGER = r"(?i)licen[sc]e|rights reserved|permission|permitted|general public|public domain|apache|mozilla public|creative commons|spdx|(?:released|distributed|available) under|\bcc[ -]by\b"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|copyright)([.-].*)?$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
MIN_COSINE = 0.6


def template_rows() -> list[tuple[str, int, str]]:
    """``(license, template, text)``; names as SPDX writes them are notices too."""
    named = {name: (*texts, f"spdx-license-identifier {name.lower()}") if name != QUOTED else texts for name, texts in TEMPLATES.items()}
    return [(name, k, t) for name, texts in sorted(named.items()) for k, t in enumerate(texts)]


def _counts(units: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, term, n)``: words and pairs of words next to each other."""
    words = units.select(*keys, F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select(*keys, F.explode(F.concat("w", pairs)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def templates(spark: SparkSession) -> DataFrame:
    """``(license, template, term, n)``; a few thousand rows, made of the constants above."""
    return _counts(spark.createDataFrame(template_rows(), "license string, template int, text string"), "license", "template")


def unit_licenses(units: DataFrame) -> DataFrame:
    """``(unit, license, cosine)`` of different units ``(unit, text)`` whose best cosine is at least MIN_COSINE.

    The inverse document frequency of a term is ln((1 + N) / (1 + n)) + 1, n of
    N units and templates having it. A unit's best template is the one with the
    greatest cosine (of four digits), then the first name, QUOTED last.
    """
    known = cut(templates(units.sparkSession), "templates")
    counts = cut(_counts(units, "unit"), "terms")
    both = counts.select("term").union(known.select("term"))
    total = units.count() + len(template_rows())
    idf = cut(both.groupBy("term").agg((F.log(F.lit(1.0 + total) / (1 + F.count("*"))) + 1).alias("idf")), "idf")
    weighed = counts.join(small(idf), "term").withColumn("weight", F.col("n") * F.col("idf"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    # The templates' side comes from constants.
    parts = known.join(idf, "term").withColumn("part", F.col("n") * F.col("idf"))
    lengths = parts.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("part") * F.col("part"))).alias("length"))
    parts = cut(parts.join(lengths, ["license", "template"]).select("license", "template", "term", (F.col("part") / F.col("length")).alias("part")), "template_vectors")
    dots = weighed.join(F.broadcast(parts), "term").groupBy("unit", "license", "template").agg(F.sum(F.col("weight") * F.col("part")).alias("dot"))
    scored = dots.groupBy("unit", "license").agg(F.max("dot").alias("dot")).join(norms, "unit").select("unit", "license", F.round(F.col("dot") / F.col("norm"), 4).alias("cosine")).where(F.col("cosine") >= MIN_COSINE)
    best = scored.groupBy("unit").agg(F.min(F.struct((F.col("license") == QUOTED).alias("quoted"), (-F.col("cosine")).alias("low"), "license")).alias("best"))
    return best.select("unit", "best.license", (-F.col("best.low")).alias("cosine"))


def directory(path: Column) -> Column:
    """The part before the last slash; empty for a file at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and all above it, with their depths: ``array<struct<depth, dir>>``; the root is empty, at depth 0."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(id, path, license, cosine, origin, license_dir)``, one row per row of ``files``.

    ``origin``: ``own`` if a header line, alone or with the line after it (or,
    in a licence file, the whole text too) reaches MIN_COSINE; the greatest
    cosine wins, then the first name, and QUOTED only without another. Else ``inherited`` from the nearest directory, its own first, with a
    licence file that has one (of several, the greatest cosine, then the first
    name); else ``none`` with nulls.

    Null and empty texts declare nothing; null paths lie at the root and are no
    licence files. Repeated rows each give their row; an empty table gives
    none. Other columns, of whatever name, are not read.
    """
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    folder = F.array_join(F.filter(F.split(F.coalesce(directory(F.col("path")), F.lit("")), "/"), lambda p: p != ""), "/")
    named = F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))
    full = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    # Each header line, and it with the line after it.
    lines = F.array_compact(F.flatten(F.transform(full, lambda x, i: F.when(x.rlike(TRIGGER), F.array(x, F.concat(x, F.lit(" "), F.get(full, i + 1)))).otherwise(F.array().cast("array<string>")))))
    units = F.when(F.col("text").rlike(TRIGGER), F.when(named, F.array_append(lines, F.col("text"))).otherwise(lines)).otherwise(F.array().cast("array<string>"))
    slim = cut(rows.select("row", "id", "path", folder.alias("dir"), named.alias("is_license"), F.coalesce(units, F.array().cast("array<string>")).alias("units")), "headers")
    apart = slim.select("row", F.explode(F.array_distinct("units")).alias("text")).withColumn("unit", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))
    different = cut(apart.groupBy("unit").agg(F.min("text").alias("text")), "units")
    found = cut(unit_licenses(different), "unit_licenses")
    order = F.struct((F.col("license") == QUOTED).alias("quoted"), (-F.col("cosine")).alias("low"), "license")
    own = apart.drop("text").join(small(found), "unit").groupBy("row").agg(F.min(order).alias("own"))
    declared = cut(slim.drop("units").join(own, "row", "left"), "declared")

    holders = declared.where(F.col("is_license") & F.col("own").isNotNull()).groupBy("dir").agg(F.min("own").alias("held"))
    # One row for each distinct directory and ancestor, however many files it has.
    above = declared.where(F.col("own").isNull()).select("dir").distinct().select(F.col("dir").alias("leaf"), F.inline(ancestors(F.col("dir"))))
    nearest = above.join(holders, "dir").groupBy("leaf").agg(F.max(F.struct("depth", "dir", "held")).alias("near"))
    judged = declared.join(small(cut(nearest, "nearest")), declared["dir"] == F.col("leaf"), "left")
    have = F.col("own").isNotNull()
    from_dir = ~have & F.col("near").isNotNull()
    return judged.select(
        "id",
        "path",
        F.when(have, F.col("own.license")).when(from_dir, F.col("near.held.license")).alias("license"),
        F.when(have, -F.col("own.low")).when(from_dir, -F.col("near.held.low")).alias("cosine"),
        F.when(have, "own").when(from_dir, "inherited").otherwise("none").alias("origin"),
        F.when(have, F.col("dir")).when(from_dir, F.col("near.dir")).alias("license_dir"),
    )
