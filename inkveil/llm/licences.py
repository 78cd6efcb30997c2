"""Licence notices: a trained paragraph classifier whose findings a template must confirm.

Paragraphs are the lines of a text.  Those with a licence word go to a
multinomial logistic regression over sparse word n-grams (one to three words).
It is trained here, on the driver, on the templates below, on cut and extended
forms of them, and on sentences that only sound like licences.  Its temperature
is fitted to forms left out of training, so that probabilities mean what they
say; what no family reaches ``SURE`` for is ``unknown`` if it still isn't likely
to be prose.  A family stands if a template of it has ``CONFIRMED`` of its words
in the paragraph.

Everything after training is one SQL expression inside the document's row: no
exchange, no Python.

Edge cases: NULL and empty texts have no paragraphs; repeated paragraphs count
each; very long paragraphs are judged whole; an empty table gives an empty
result; extra columns pass through.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from inkveil.functions.columns import quote, quotes

# Short notices by family, as commonly written.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License",
        "This project is released under the Apache License 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "This software is licensed under the MIT License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL version 3.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced without prior written permission.",
    ],
}
# Sentences with licence words that are none.
PROSE = [
    "She renewed her driving license at the town office last week.",
    "The restaurant lost its license after the second inspection.",
    "A license to fish costs ten euros a year.",
    "He had no permission to enter the building.",
    "The rights of the workers were the subject of the meeting.",
    "Copyright law was discussed in the second lecture.",
    "They reserved a table for all of us.",
    "Version 2 of the plan came with no warranty that it would work.",
    "The public was granted free entry to the museum.",
    "The licensed pilot took the new version of the plane for a test.",
    "A general told the public that the work was done.",
    "The source of the river was not permitted to visitors.",
]
GATE = r"licen[cs]|copyright|rights reserved|permission|redistribution|creative commons|warrant|public domain"
WORD = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"
GRAMS = 3
SURE, PROSE_LIKELY, CONFIRMED = 0.6, 0.5, 0.8
FAMILIES = [*TEMPLATES]

_python_word = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _python_word.findall(text.lower())


def grams_of(words: list[str]) -> Iterator[str]:
    for n in range(1, GRAMS + 1):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i : i + n])


def forms(text: str) -> list[list[str]]:
    """A notice as it is, without a word at either end, and inside other words."""
    words = words_of(text)
    shorter = [words[1:], words[:-1]] if len(words) > 4 else []
    return [words, *shorter, ["the", "file", "is", *words], [*words, "see", "the", "notice"]]


@functools.lru_cache(maxsize=1)
def model() -> tuple[dict[str, list[float]], list[float]]:
    """Weights per n-gram and class, and offsets; the last class is prose.  Divided by the fitted temperature."""
    samples = [(form, k, i) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f] for i, form in enumerate(forms(t))]
    samples += [(form, len(FAMILIES), i) for t in PROSE for i, form in enumerate(forms(t))]
    vocabulary = sorted({g for form, _, _ in samples for g in grams_of(form)})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(samples), len(vocabulary)))
    for row, (form, _, _) in enumerate(samples):
        for g in set(grams_of(form)):
            x[row, place[g]] = 1.0
    y = np.eye(len(FAMILIES) + 1)[[k for _, k, _ in samples]]
    held = np.array([i == 2 for _, _, i in samples])  # one shortened form of each is left out
    weights, offsets = np.zeros((len(vocabulary), y.shape[1])), np.zeros(y.shape[1])

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    own, target = x[~held], y[~held]
    for _ in range(400):
        error = softmax(own @ weights + offsets) - target
        weights -= 0.5 * (own.T @ error / len(own) * 4 + 0.002 * weights)
        offsets -= 0.5 * error.mean(0)
    z, truth = x[held] @ weights + offsets, y[held]
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log((softmax(z / t) * truth).sum(1) + 1e-12).sum())
    kept = np.abs(weights).max(1) > 0.02
    return (
        {g: [round(float(v), 6) for v in weights[i] / temperature] for g, i in place.items() if kept[i]},
        [round(float(v), 6) for v in offsets / temperature],
    )


def _logits(grams: str, weights: dict[str, list[float]], offsets: list[float]) -> str:
    """Sums of the weights of the known, distinct n-grams.  Unknown ones are dropped by a hash set first."""
    table = ", ".join(f"{quote(g)}, array({', '.join(f'{v!r}D' for v in w)})" for g, w in weights.items())
    known = f"filter({grams}, g -> g IN ({quotes([*weights])}))"
    start = f"array({', '.join(f'{v!r}D' for v in offsets)})"
    return f"aggregate({known}, {start}, (a, g) -> zip_with(a, map({table})[g], (p, q) -> p + q))"


def findings(text: str = "text") -> str:
    """SQL for an array of ``line, family, probability, confirmed`` of a text's licence paragraphs."""
    weights, offsets = model()
    one = "transform(sequence(1, size(w)), i -> w[i - 1])"
    more = ", ".join(
        f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')) ELSE cast(array() AS array<string>) END"
        for n in range(2, GRAMS + 1)
    )
    grams = f"CASE WHEN size(w) = 0 THEN cast(array() AS array<string>) ELSE array_distinct(concat({one}, {more})) END"
    lines = f"filter(transform(split(coalesce({text}, ''), '\\n'), (l, n) -> struct(n AS line, lower(l) AS l)), x -> x.l RLIKE {quote(GATE)})"
    with_words = f"transform({lines}, x -> struct(x.line AS line, regexp_extract_all(x.l, {quote(WORD)}, 0) AS w))"
    with_logits = f"transform({with_words}, x -> struct(x.line AS line, x.w AS w, transform(array(x.w), w -> {_logits(grams, weights, offsets)})[0] AS z))"
    shares = f"transform({with_logits}, x -> struct(x.line AS line, x.w AS w, transform(x.z, v -> exp(v - array_max(x.z)) / aggregate(x.z, 0D, (s, u) -> s + exp(u - array_max(x.z)))) AS p))"
    best = f"array_position(slice(x.p, 1, {len(FAMILIES)}), array_max(slice(x.p, 1, {len(FAMILIES)})))"
    covered = "CASE " + " ".join(
        f"WHEN f = {k + 1} THEN greatest(0D, " + ", ".join(
            f"size(array_intersect(array({quotes(sorted(set(words_of(t))))}), x.w)) / {len(set(words_of(t)))}D" for t in TEMPLATES[family]
        ) + ")" for k, family in enumerate(FAMILIES)
    ) + " END"
    names = f"array({quotes(FAMILIES)})"
    judged = (
        f"transform({shares}, x -> transform(array({best}), f -> struct(x.line AS line,"
        f" CASE WHEN x.p[f - 1] >= {SURE}D THEN {names}[cast(f - 1 AS int)] WHEN x.p[{len(FAMILIES)}] < {PROSE_LIKELY}D THEN 'unknown' END AS family,"
        f" round(x.p[cast(f - 1 AS int)], 3) AS probability, {covered} >= {CONFIRMED}D AS confirmed))[0])"
    ).replace("x.p[f - 1]", "x.p[cast(f - 1 AS int)]")
    return f"filter({judged}, x -> x.family IS NOT NULL)"


def scanned(df: DataFrame, text: str = "text", into: str = "licences") -> DataFrame:
    """Add the findings; ``confirmed`` is false for unknown ones."""
    found = F.expr(findings(f"`{text}`"))
    return df.withColumn(into, F.when(F.lower(text).rlike(GATE), found).otherwise(F.expr("cast(array() AS array<struct<line:int,family:string,probability:double,confirmed:boolean>>)")))


def twin_sql() -> str:
    """The same for DuckDB: n-grams joined to the weights, sums per paragraph."""
    weights, offsets = model()

    def literal(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ", ".join(f"({literal(g)}, {k}, {v!r}::DOUBLE)" for g, w in weights.items() for k, v in enumerate(w))
    base = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(offsets))
    templates = ", ".join(
        f"({k}, {t}, {literal(w)}, {len(words)})"
        for k, f in enumerate(FAMILIES) for t, text in enumerate(TEMPLATES[f]) for words in [sorted(set(words_of(text)))] for w in words
    )
    names = ", ".join(f"({k}, {literal(f)})" for k, f in enumerate(FAMILIES))
    grams = " UNION ".join(
        f"SELECT r, line, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT r, line, w, unnest(range(1, len(w) - {n - 2})) AS i FROM p)"
        for n in range(1, GRAMS + 1)
    )
    last = len(FAMILIES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, unnest(range(0, len(string_split(t, chr(10))))) AS line, unnest(string_split(lower(t), chr(10))) AS l FROM d),
p AS (SELECT r, line, regexp_extract_all(l, '{WORD}') AS w FROM l WHERE regexp_matches(l, '{GATE}')),
weights(g, k, v) AS (VALUES {rows}), base(k, v) AS (VALUES {base}), names(k, family) AS (VALUES {names}),
templates(k, t, w, n) AS (VALUES {templates}),
grams AS ({grams}),
z AS (
  SELECT p.r, p.line, base.k, any_value(base.v) + coalesce(sum(weights.v), 0) AS z
  FROM p CROSS JOIN base LEFT JOIN grams ON grams.r = p.r AND grams.line = p.line
  LEFT JOIN weights ON weights.g = grams.g AND weights.k = base.k GROUP BY p.r, p.line, base.k),
s AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY r, line) AS share FROM z),
best AS (
  SELECT r, line, arg_max(k, share) FILTER (k < {last}) AS k, max(share) FILTER (k < {last}) AS share,
    max(share) FILTER (k = {last}) AS prose FROM s GROUP BY r, line),
covered AS (
  SELECT r, line, max(c) AS c FROM (
    SELECT best.r, best.line, templates.t, count(*) FILTER (list_contains(p.w, templates.w)) / any_value(templates.n) AS c
    FROM best JOIN p USING (r, line) JOIN templates USING (k) GROUP BY best.r, best.line, templates.t)
  GROUP BY r, line),
found AS (
  SELECT r, CASE WHEN share >= {SURE} THEN names.family WHEN prose < {PROSE_LIKELY} THEN 'unknown' END AS family, c >= {CONFIRMED} AS confirmed
  FROM best JOIN covered USING (r, line) JOIN names USING (k))
SELECT doc_id,
  coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (family <> 'unknown' AND confirmed), '') AS licences,
  count(*) FILTER (family <> 'unknown' AND confirmed) AS n_confirmed,
  count(*) FILTER (family <> 'unknown' AND NOT confirmed) AS n_unconfirmed,
  count(*) FILTER (family = 'unknown') AS n_unknown
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id
"""
