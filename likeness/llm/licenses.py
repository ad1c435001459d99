"""Licence scans by canonical digest, with DataFrame functions alone.

Texts are brought to a canonical form (lower case, no copyright lines, one spelling for
equivalent words, no punctuation, single spaces) and hashed; the digests are looked up
among those of known licence texts. Whole documents are looked up, and so is each of
their lines as a text of its own, since a notice is often one line of a larger document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key

# Equivalent spellings, the canonical one second.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("non-commercial", "noncommercial"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("https://", "http://"),
)
# Notices as their publishers word them, by SPDX identifier.
KNOWN = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": (
        "This work is licensed under the GNU General Public License, version 3."
    ),
    "CC-BY-4.0-notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}
# Up to this many licences are sent to every task, at 64 bytes a digest; more are joined.
MOST_KNOWN = 10_000

# Only \n ends a line, in Java and in RE2 alike.
COPYRIGHT = r"(^|\n)[ \t]*(copyright|©|\(c\)|all rights reserved)[^\n]*"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null texts count as empty."""
    form = F.lower(F.coalesce(text, F.lit("")))
    form = F.regexp_replace(form, COPYRIGHT, "\n")
    for other, chosen in SPELLINGS:
        form = F.replace(form, F.lit(other), F.lit(chosen))
    return F.trim(F.regexp_replace(form, MARKS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: dict[str, str]) -> DataFrame:
    """(license, digest); of equal canonical texts the first name stays."""
    if len(known) > MOST_KNOWN:
        rows = spark.createDataFrame(list(known.items()), "license string, text string")
    else:
        pairs = [
            F.struct(F.lit(name).alias("license"), F.lit(text).alias("text"))
            for name, text in known.items()
        ]
        kind = "array<struct<license:string,text:string>>"
        listed = F.array(*pairs) if pairs else F.expr(f"CAST(array() AS {kind})")
        rows = spark.range(1).select(F.explode(listed).alias("l")).select("l.*")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def with_licenses(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    known: dict[str, str] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: the id, ``digest`` of the whole canonical text,
    ``license`` it is known as (null: none), ``n_license_lines`` and ``line_licenses``
    (sorted distinct names, comma-joined) of its lines that are known notices as a whole.

    Null and empty texts have the digest of the empty text, and no licence unless a known
    text is empty too. Repeated rows each give a row with the same findings; rows of one id, or
    of none, with different texts have their own. Other columns are left out. The texts are not
    shuffled.
    """
    known = KNOWN if known is None else known
    table = known_digests(docs.sparkSession, known)
    table = F.broadcast(table) if len(known) <= MOST_KNOWN else table
    body = F.coalesce(F.col(key(text)), F.lit(""))
    name, raw = F.col(key(id)), F.sha2(body, 256)
    whole = docs.select(name.alias(id), digest(body).alias("digest"), raw.alias("raw"))
    whole = whole.join(table, "digest", "left")
    lines = docs.select(
        name.alias("line_id"), raw.alias("line_raw"), F.posexplode(F.split(body, "\n")).alias("at", "line")
    )
    found = (
        lines.select("line_id", "line_raw", "at", digest(F.col("line")).alias("digest"))
        .join(table, "digest")
        .groupBy("line_id", "line_raw", "at", "license")  # repeated rows count once
        .agg(F.count("*"))
        .groupBy("line_id", "line_raw")
        .agg(
            F.count("*").alias("n_license_lines"),
            F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"),
        )
    )
    same = whole[key(id)].eqNullSafe(found["line_id"]) & (whole["raw"] == found["line_raw"])
    return whole.join(found, same, "left").select(
        key(id),
        "digest",
        "license",
        F.coalesce("n_license_lines", F.lit(0).cast("long")).alias("n_license_lines"),
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
    )


def sql_canonical(column: str) -> str:
    """The canonical form in DuckDB SQL."""
    form = f"lower(coalesce({column}, ''))"
    form = f"regexp_replace({form}, '{COPYRIGHT}', chr(10), 'g')"
    for other, chosen in SPELLINGS:
        form = f"replace({form}, '{other}', '{chosen}')"
    return f"trim(regexp_replace({form}, '{MARKS}', ' ', 'g'))"


def sql_licenses() -> str:
    """``with_licenses`` of ``documents`` in DuckDB SQL."""
    values = ", ".join(
        "('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in KNOWN.items()
    )
    return f"""
    WITH texts(name, text) AS (VALUES {values}),
    known AS (
        SELECT sha256({sql_canonical("text")}) AS digest, min(name) AS license
        FROM texts GROUP BY 1
    ),
    whole AS (
        SELECT doc_id, sha256({sql_canonical("text")}) AS digest FROM documents
    ),
    lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
    ),
    found AS (
        SELECT doc_id, license AS name, count(*) AS n
        FROM lines JOIN known ON sha256({sql_canonical("line")}) = known.digest
        GROUP BY 1, 2
    ),
    summed AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_license_lines,
               string_agg(name, ',' ORDER BY name) AS line_licenses
        FROM found GROUP BY 1
    )
    SELECT w.doc_id, w.digest, k.license,
           coalesce(s.n_license_lines, 0) AS n_license_lines,
           coalesce(s.line_licenses, '') AS line_licenses
    FROM whole w LEFT JOIN known k ON w.digest = k.digest
    LEFT JOIN summed s ON w.doc_id IS NOT DISTINCT FROM s.doc_id
    """
