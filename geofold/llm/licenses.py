"""License scans: canonical text digests looked up in a table of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in order, for Java's and RE2's regular expressions alike.  After the fourth,
# every word stands between two spaces of its own, so that neighbours can both be replaced.
CANONICAL = [
    (r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*(?:\(c\)|©|[12]\d\d\d|yyyy|<year>)[^\n]*$", " "),
    # Lines of a wrapped sentence or list are no copyright lines; the sign kept before them is no word.
    (r"(?m)^([ \t]*(?:copyright(?:[ \t]+(?:notices?|holders?|owners?|licen[cs]es?|interests?|statements?|disclaimers?|laws?|treaty|treaties|and|or|in|is|on|to|of|for)\b|[ \t]*[,.;)/]|[ \t]*$)|\(c\)[ \t]+(?:you|under|the|any|if|in|to)\b))", r"- \1"),
    (r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", " "),
    (r"[^\p{L}\p{N}]+", "  "),
    (" (?:licence|licences|licensed|licenced|licenses) ", " license "),
    (" (?:organisation|organisations|organizations) ", " organization "),
    (" favour ", " favor "),
    (" non  commercial ", " noncommercial "),
    (" sub  license ", " sublicense "),
    (r" (?:version|v) *(\d)", r" version  \1"),
    (" whilst ", " while "),
    (" https ", " http "),
]
# Licence texts that fit on a page, and the notices projects use in place of the text.
KNOWN = {
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
}
# Heading lines that files of the short licences have.
TITLES = {
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"),
}
#: Whole licence texts, a file each.
FOLDER = Path(__file__).with_name("license_texts")


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of ``KNOWN``, the whole texts of ``FOLDER``, and both under their usual headings."""
    rows = list(KNOWN.items()) + [(f.stem, f.read_text("utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    return rows + [(name, f"{title}\n\n{text}") for name, text in rows for title in TITLES.get(name, ())]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words and digits only, equivalent spellings made one, single spaces."""
    out = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    for pattern, to in CANONICAL:
        out = F.regexp_replace(out, pattern, to.replace(r"\1", "$1"))
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_sql(text: str) -> str:
    out = f"(' ' || lower(coalesce({text}, '')) || ' ')"
    for pattern, to in CANONICAL:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def digest_table(spark, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the known texts (``known_texts`` if none are given), made canonical by the same expressions as the documents."""
    rows = spark.createDataFrame(known_texts() if known is None else list(known.items()), "license string, _text string")
    rows = rows.select("license", F.sha2(canonical(F.col("_text")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """key, ``digest``, ``n_canonical`` and ``license`` (null where the whole text is no known licence).

    A null text counts as empty; empty texts get the digest of the empty string and no licence.  Repeated rows and
    null keys stay as they are, an empty table gives none, and other columns are not read.  ``known`` may have any
    size: it has one row a digest, and the planner broadcasts it only if it is small.
    """
    df = docs.select(F.col(key), canonical(F.col(text)).alias("_canonical"))
    df = df.select(key, F.sha2("_canonical", 256).alias("digest"), F.length("_canonical").cast("long").alias("n_canonical"))
    known = digest_table(docs.sparkSession) if known is None else known
    return df.join(known.where(F.col("digest") != F.sha2(F.lit(""), 256)), "digest", "left").select(key, "digest", "n_canonical", "license")


def scan_sql() -> str:
    """The query's rows over ``documents`` as DuckDB SQL."""
    values = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in known_texts())
    return f"""
with known as (select sha256({canonical_sql('t')}) as digest, min(license) as license from (values {values}) as v(license, t) group by 1),
docs as (select doc_id, {canonical_sql('text')} as c from documents)
select doc_id, sha256(c) as digest, length(c)::bigint as n_canonical, license
from docs left join known on known.digest = sha256(docs.c) and docs.c <> ''"""
