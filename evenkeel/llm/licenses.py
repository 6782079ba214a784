"""License scans by an exact set-similarity join of text lines with license templates, in built-in expressions only.

A line is a set of words, a template too; they join when the line holds at least ``CONTAINMENT`` of the template's words. The words
of all templates are ordered by the number of documents that hold them, rarest first. A line that reaches the threshold of t words
must hold one of the template's first |T|-t+1 words (prefix filter), must have t template words at all (length filter), and the words
from the first common one on must still be enough on both sides (positional filter); what passes is counted exactly.

The templates are a parameter and become literals of the plan; the frequencies are one row for each of their words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import register, table
from .fingerprint import let

CONTAINMENT = 0.9
#: Fixed values of the contract: phrase and label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _set(text: str) -> list[str]:
    return sorted(set(re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))))


def line_words(text: Column) -> Column:
    """The words of every line."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(low, "\n"), lambda line: F.regexp_extract_all(line, F.lit(_WORD), F.lit(0)))


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many documents each of the words is; words of no document are left out."""
    own = F.array_intersect(F.lit(words), F.flatten(line_words(F.col("text"))))
    return {r.word: r.n for r in docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _matches(known: Column, words: list[str], least: int) -> Column:
    """How many of a template's words (rarest first) a line has, 0 if under ``least``; ``known``: its template words in the same order."""
    prefix = words[: len(words) - least + 1]
    common = F.array_intersect(F.lit(words), known)
    first = F.get(common, F.lit(0))
    left_t = len(words) - F.array_position(F.lit(words), first) + 1
    left_b = F.size(known) - F.array_position(known, first) + 1
    count = let(common, lambda c: F.when((left_t >= least) & (left_b >= least) & (F.size(c) >= least), F.size(c)).otherwise(0))
    return F.when((F.size(known) >= least) & F.arrays_overlap(F.lit(prefix), known), count).otherwise(0)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` with ``__words`` (their number), ``__starts`` (of the base phrases, by label) and ``__found`` (label and containment).

    A null text is empty. Repeated rows are scanned each for itself, so nothing is shuffled but the frequencies.
    """
    sets = [(label, _set(text)) for label, text in templates if _set(text)]
    seen = frequencies(docs, sorted({w for _, words in sets for w in words}))
    rank = lambda w: (seen.get(w, 0), w)
    vocabulary = sorted({w for _, words in sets for w in words}, key=rank)

    def starts(words: Column, phrase: list[str]) -> Column:
        n = F.size(words) - len(phrase)
        same = lambda i: F.array_contains(F.array(F.lit(True)), _all([F.get(words, i + k) == p for k, p in enumerate(phrase)]))
        return F.when((n >= 0) & _all([F.array_contains(words, p) for p in phrase]), F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), same)).otherwise(F.array().cast("array<int>"))

    def found(known: Column) -> Column:
        out = []
        for label, words in sets:
            words = sorted(words, key=rank)
            least = math.ceil(containment * len(words) - 1e-9)
            most = F.array_max(F.transform(known, lambda k: _matches(k, words, least)))
            out.append(F.struct(F.lit(label).alias("label"), (most / F.lit(float(len(words)))).alias("containment")))
        return F.filter(F.array(*out), lambda x: x["containment"] > 0)

    least_words = min((math.ceil(containment * len(w) - 1e-9) for _, w in sets), default=1)

    def row(lines: Column) -> Column:
        known = F.filter(F.transform(lines, lambda w: F.array_intersect(F.lit(vocabulary), w)), lambda k: F.size(k) >= least_words)
        return F.struct(
            F.aggregate(lines, F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("__words"),
            let(F.flatten(lines), lambda w: F.array(*[
                F.struct(F.lit(label).alias("label"), starts(w, phrase.split()).alias("at")) for phrase, label in base
            ])).alias("__starts"),
            let(known, found).alias("__found"),
        )

    return docs.withColumn("__scan", let(line_words(F.col("text")), row)).select(*[F.col(f"`{c}`") for c in docs.columns], "__scan.*")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sql() -> str:
    arrays = ", ".join("({!r}, {})".format(label, "[" + ", ".join(f"'{w}'" for w in _set(text)) + "]") for label, text in TEMPLATES)
    hits = []
    for phrase, label in BASE:
        own = phrase.split()
        match = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(own))
        hits.append(f"SELECT d, i, '{label}' AS label FROM d, unnest(range(len(w) - {len(own) - 1})) AS u(i) WHERE list_contains(w, 'license') AND {match}")
    word = "'" + _WORD + "'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
e AS MATERIALIZED (SELECT d, doc_id, t, regexp_extract_all(t, {word}) AS w FROM d),
base AS (SELECT d, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own
         FROM ({" UNION ALL ".join(h.replace("FROM d,", "FROM e,") for h in hits)}) GROUP BY d),
templates(label, tokens) AS (VALUES {arrays}),
lines AS (SELECT d, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) AS b FROM e),
found AS (SELECT d, label, max(len(list_intersect(b, tokens)) / len(tokens)) AS c FROM lines, templates
          WHERE len(list_intersect(b, tokens)) >= ceil({CONTAINMENT} * len(tokens) - 1e-9) GROUP BY d, label),
method AS (SELECT d, list(label) AS own, max(c) AS score FROM found GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.own, []), coalesce(method.own, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM e LEFT JOIN base USING (d) LEFT JOIN method USING (d)"""


@register("op4_license_scan", _sql())
def op4(spark, sf_dir) -> DataFrame:
    """Per document: words, places and labels of the base phrases, all labels, and the best containment (1 for a base phrase)."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    at = F.flatten(F.transform("__starts", lambda s: s["at"]))
    own = F.transform(F.filter("__starts", lambda s: F.size(s["at"]) > 0), lambda s: s["label"])
    more = F.transform("__found", lambda f: f["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    rows = rows.select("doc_id", "__words", "__found", at.alias("at"), own.alias("own"), more.alias("more"))
    best = F.coalesce(F.array_max(F.transform("__found", lambda f: f["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("__words").alias("n_words"), F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        joined(F.col("own")).alias("base_labels"), joined(F.concat("own", "more")).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(best).alias("score"),
    )
