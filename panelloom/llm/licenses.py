"""Licence scan by Dice coefficient over word bigrams, in Spark expressions only.

Units are the lines of a document and, where there are several, the document as
a whole. A unit is normalised to lower-case words of letters and digits and
compared by its bigrams, repeats counted, to each template. A Dice coefficient
of t needs at least n * t / (2 - t) and at most n * (2 - t) / t bigrams for a
template of n. A unit has one bigram less than words, so units that fit no
template are passed over by counting blanks, and templates that do not fit a
unit are never compared with it.

``scan`` compares units alone. ``scan_all`` also compares windows of each
template's word count over the words that no unit has claimed, line ends as
blanks, so that a notice may be wrapped or stand among other words. A window of
Dice t lacks few bigrams of its template, so of the longest ones, one more than
may be lacking, it holds at least one: only windows around these are compared.

Edge cases: null and empty texts, and units of fewer than two words, match no
template. A document without a match is returned with a null licence. Of equal
scores the smaller template name wins. Rows repeated whole keep their number.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import read, whole_text

LEAST = 0.8
# Short notices of public licences.
TEMPLATES = {
    "agpl-3": "This program is licensed under the GNU Affero General Public License, version 3.",
    "all-rights": "All rights reserved.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "bsd-3": "Use of this source code is governed by a BSD-style license.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mpl-2": "This work is licensed under the Mozilla Public License, version 2.0.",
    "public-domain": "This is free and unencumbered software released into the public domain.",
}
_NOT_WORD = r"[^\p{L}\p{N}\n]+"


def bigrams(text: str) -> list[str]:
    """Bigrams of a template, repeats numbered, with the normalisation of ``scan``."""
    words = re.findall(r"[^\W_]+", text.lower())
    seen: Counter[str] = Counter()
    out = []
    for a, b in zip(words, words[1:]):
        seen[f"{a} {b}"] += 1
        out.append(f"{a} {b} {seen[f'{a} {b}']}")
    return out


def bounds(n: int) -> tuple[float, float]:
    """Least and greatest number of bigrams that can match a template of n."""
    return n * LEAST / (2 - LEAST), n * (2 - LEAST) / LEAST


def _count(unit: Column) -> Column:
    """Bigrams of a normalised unit: its single blanks."""
    return F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit("")))


def _plain(words: Column) -> Column:
    return F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1),
        F.slice(words, F.lit(2), F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def _numbered(plain: Column) -> Column:
    def numbered(x: Column, i: Column) -> Column:
        times = F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda y: y == x))
        return F.concat_ws(" ", x, times.cast("string"))

    return F.transform(plain, numbered)


def _bigrams(unit: Column) -> Column:
    return _numbered(_plain(F.split(unit, " ", -1)))


def anchors(shape: list[str]) -> list[str]:
    """Bigrams of which every window that reaches LEAST holds at least one."""
    lacking = len(shape) - math.ceil(LEAST * len(shape) - 1e-9)
    plain = sorted({b.rsplit(" ", 1)[0] for b in shape}, key=lambda b: (-len(b), b))
    return plain[: lacking + 1]


def _unit_hits(docs: DataFrame, shapes: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lines, line_hits, hits): hits of each line, null where none, and those of all units."""
    low = min(bounds(len(b))[0] for b in shapes.values())
    high = max(bounds(len(b))[1] for b in shapes.values())
    fits_any = lambda n: n.between(F.lit(low), F.lit(high))
    normal = docs.select("doc_id", F.regexp_replace(F.lower(whole_text()), _NOT_WORD, " ").alias("normal"))
    lines = normal.select(
        "doc_id", F.filter(F.transform(F.split("normal", "\n", -1), lambda x: F.trim(x)), lambda x: x != "").alias("lines")
    )
    total = F.aggregate("lines", F.lit(-1), lambda n, x: n + _count(x) + 1)
    whole = F.when((F.size("lines") > 1) & fits_any(total), F.array(F.array_join("lines", " ")))
    units = lines.select("doc_id", "lines", F.coalesce(whole, F.array().cast("array<string>")).alias("whole"))
    pairs = units.select(
        "doc_id",
        "lines",
        F.transform("lines", lambda x: F.when(fits_any(_count(x)), _bigrams(x))).alias("line_pairs"),
        F.transform("whole", _bigrams).alias("whole_pairs"),
    )

    def best(b: Column) -> Column:
        """Greatest score, then smallest name, among the templates of fitting size."""
        found = []
        for name, shape in shapes.items():
            least, most = bounds(len(shape))
            common = F.size(F.array_intersect(b, F.array(*map(F.lit, shape))))
            dice = F.lit(2.0) * common / (F.size(b) + len(shape))
            fits = F.size(b).between(F.lit(least), F.lit(most))
            found.append(F.when(fits, F.when(dice >= LEAST, F.struct((-dice).alias("d"), F.lit(name).alias("n")))))
        return F.array_min(F.array(*found))

    met = pairs.select(
        "doc_id",
        "lines",
        F.transform("line_pairs", lambda b: F.when(b.isNotNull(), best(b))).alias("line_hits"),
        F.filter(F.transform("whole_pairs", best), lambda h: h.isNotNull()).alias("whole_hits"),
    )
    hits = F.concat(F.filter("line_hits", lambda h: h.isNotNull()), "whole_hits")
    return met.select("doc_id", "lines", "line_hits", "whole_hits", hits.alias("hits"))


def _result(hits: DataFrame, matches: Column) -> DataFrame:
    top = F.array_min("hits")
    return hits.select(
        "doc_id",
        top["n"].alias("license"),
        F.round(-top["d"], 6).alias("score"),
        matches.cast("bigint").alias("matches"),
    )


def _shapes(templates: dict[str, str]) -> dict[str, list[str]]:
    return {name: bigrams(text) for name, text in sorted(templates.items())}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, score, matches): best template and number of units that match any."""
    return _result(_unit_hits(docs, _shapes(templates)), F.size("hits"))


def _window_hits(name: str, shape: list[str]) -> Column:
    """Windows over the column ``plain`` of bigrams that match the template: (d, n, at, end)."""
    m, size = len(shape), F.size("plain")
    wanted = F.array(*map(F.lit, shape))
    near = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("plain", i).isin(anchors(shape)))
    starts = F.array_distinct(
        F.flatten(F.transform(near, lambda i: F.sequence(F.greatest(i - (m - 1), F.lit(0)), F.least(i, size - m))))
    )

    def compared(at: Column) -> Column:
        common = F.size(F.array_intersect(_numbered(F.slice("plain", at + 1, F.lit(m))), wanted))
        return F.struct((-common / F.lit(float(m))).alias("d"), F.lit(name).alias("n"), at.alias("at"), (at + m + 1).alias("end"))

    found = F.filter(F.transform(starts, compared), lambda h: h["d"] <= -LEAST)
    return F.when(size >= m, found).otherwise(F.array().cast(WINDOW))


WINDOW = "array<struct<d:double,n:string,at:int,end:int>>"


def scan_all(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """As ``scan``, with windows in what no unit matched; windows that overlap count as one match."""
    shapes = _shapes(templates)
    some = "|".join(sorted({a for shape in shapes.values() for a in anchors(shape)}))
    # A line that matched is a break no bigram reaches over.
    rest = F.array_join(F.zip_with("lines", "line_hits", lambda x, h: F.when(h.isNull(), x).otherwise("\n")), " ")
    open_ = _unit_hits(docs, shapes).select("doc_id", "hits", F.when(F.size("whole_hits") == 0, rest).alias("rest"))
    entered = F.concat(F.lit(" "), "rest", F.lit(" ")).rlike(f" (?:{some}) ")
    plain = open_.select("doc_id", "hits", F.when(entered, _plain(F.split("rest", " ", -1))).alias("plain"))
    windows = F.when(F.size("plain") > 0, F.concat(*[_window_hits(n, b) for n, b in shapes.items()]))
    found = plain.select("doc_id", "hits", F.coalesce(windows, F.array().cast(WINDOW)).alias("windows"))
    ordered = F.sort_array(F.transform("windows", lambda w: F.struct(w["at"].alias("at"), w["end"].alias("end"))))
    apart = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, w: F.struct(
            F.greatest(s["end"], w["end"]).alias("end"), (s["n"] + F.when(w["at"] >= s["end"], 1).otherwise(0)).alias("n")
        ),
        lambda s: s["n"],
    )
    both = F.concat("hits", F.transform("windows", lambda w: F.struct(w["d"].alias("d"), w["n"].alias("n"))))
    counted = found.select("doc_id", both.alias("hits"), (F.size("hits") + apart).alias("_matches"))
    return _result(counted, F.col("_matches"))


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_all(read(spark, folder, "documents"))
