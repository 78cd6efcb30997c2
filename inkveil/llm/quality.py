"""Quality rules whose verdict takes the document's host into account.

Each document is measured once.  Four soft rules are counted per host; the
rate of each rule is shrunk towards all hosts by a beta prior that is fitted
to the hosts themselves (moments), so a host with three documents proves
little and one with thousands speaks for itself.  Where a host's shrunk rate
of a rule reaches ``HOST_RATE``, its documents that fail this very rule go.
Documents that fail no rule stay, whatever their host.

Edge cases: NULL or empty text has no words and fails the base rule; a NULL
host is a host of its own; repeated rows count each; an empty table gives an
empty result; other columns pass through and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inkveil.llm.common import WORD_PATTERN, batch_udf, small_or_all, staged

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Soft rules: they only count where they are the habit of a host.
SOFT_RULES = {
    "thin": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 10 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "n_dup_lines >= 3",
}
HOST_RATE = 0.5
# Bounds of the prior's weight, in documents: hosts alike give a heavy prior, unlike ones a light one.
PRIOR_WEIGHT = (2.0, 1000.0)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_words = re.compile(WORD_PATTERN).findall
_symbols = re.compile(r"[#*$%&|<>]").findall
_has_word = re.compile(WORD_PATTERN).search


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of five found at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Windows get exact numbers step by step: pairs, pairs of pairs, and the fifth word.
    for step, keep in ((1, len(words) - 1), (2, len(words) - 3)):
        pairs = ids[:keep] * (int(ids.max()) + 1) + ids[step : step + keep]
        if step == 1:
            singles = ids
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = ids[:n] * (int(singles.max()) + 1) + singles[WINDOW - 1 :]
    _, number, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[number] > 1)
    if not len(starts):
        return 0
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(steps)))


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five measures of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _words(text)
    lines = Counter(line for line in text.split("\n") if _has_word(line)) if "\n" in text else {}
    return (
        len(words),
        sum(map(len, words)),
        len(_symbols(text)),
        sum(lines.values()) - len(lines),
        repeated_words(words),
    )


@batch_udf(MEASURES)
def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in MEASURES.split(", ")]
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=names, dtype="int64")


def base_failed(of: str) -> Column:
    return F.expr(f"{of}.n_words < {MIN_WORDS} OR 100 * {of}.n_repeat_words > {MAX_REPEAT_PERCENT} * {of}.n_words")


def soft_failed(rule: str, of: str) -> Column:
    return F.expr(re.sub(r"\bn_", f"{of}.n_", SOFT_RULES[rule]))


def host_rates(df: DataFrame, host: Column, text: str = "text") -> DataFrame:
    """``host, n_docs`` and per rule the shrunk rate; one row per host, summed map-side so that a hot host is no burden."""
    measured = df.select(host.alias("host"), _measures(F.col(text)).alias("m"))
    hosts = staged(
        measured.groupBy("host").agg(
            F.count("*").alias("n_docs"),
            *(F.sum(soft_failed(rule, "m").cast("long")).alias(rule) for rule in SOFT_RULES),
        ),
        "quality-hosts",
    )
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.count("*").alias("hosts"),
        *(F.sum(rule).alias(rule) for rule in SOFT_RULES),
        *(F.sum(F.col(rule) * F.col(rule) / F.col("n_docs")).alias(f"{rule}_sq") for rule in SOFT_RULES),
    ).first()
    rates = []
    for rule in SOFT_RULES:
        a, b = beta_prior(total[rule] or 0, total["n"] or 0, total["hosts"], total[f"{rule}_sq"] or 0.0)
        rates.append(((F.col(rule) + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))).alias(rule))
    return hosts.select("host", "n_docs", *rates)


def beta_prior(failed: int, docs: int, hosts: int, squares: float) -> tuple[float, float]:
    """Beta parameters by moments: ``squares`` is the sum over hosts of failed² / docs."""
    if not docs:
        return 1.0, 1.0
    mean = failed / docs
    noise = mean * (1 - mean)
    between = squares / docs - mean * mean - noise * hosts / docs
    low, high = PRIOR_WEIGHT
    weight = min(max(noise / between - 1, low), high) if between > 0 else high
    return mean * weight, (1 - mean) * weight


def judged(df: DataFrame, host: Column, text: str = "text", into: str = "quality") -> DataFrame:
    """Add the struct ``into``: the measures, ``base_failed``, and ``kept``.

    Hosts with a verdict are joined back: broadcast if they were counted to
    be few, else by a shuffle.
    """
    habits = [F.col(rule) >= F.lit(HOST_RATE) for rule in SOFT_RULES]
    verdicts = (
        host_rates(df, host, text)
        .where(F.expr(" OR ".join(f"{rule} >= {HOST_RATE}" for rule in SOFT_RULES)))
        .select(F.col("host").alias(f"{into}_host"), F.struct(*(h.alias(r) for h, r in zip(habits, SOFT_RULES))).alias(f"{into}_habits"))
    )
    measured = df.withColumn(into, _measures(F.col(text))).withColumn(f"{into}_key", host)
    joined = measured.join(small_or_all(verdicts), F.expr(f"{into}_key <=> {into}_host"), "left")
    against = F.lit(False)
    for rule in SOFT_RULES:
        against = against | (F.coalesce(F.col(f"{into}_habits.{rule}"), F.lit(False)) & soft_failed(rule, into))
    return joined.withColumn(
        into,
        F.struct(f"{into}.*", base_failed(into).alias("base_failed"), (~base_failed(into) & ~against).alias("kept")),
    ).drop(f"{into}_key", f"{into}_host", f"{into}_habits")


def keep_good(df: DataFrame, host: Column, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with their own columns."""
    name = "quality_of_row"
    return judged(df, host, text, name).where(f"{name}.kept").drop(name)
