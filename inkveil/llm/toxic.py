"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words counts the subsequences of three characters that they
share, within ``SPAN`` characters, each weighted down by the characters it
spans; word ends are characters too.  So ``i.d.i.o.t`` still resembles the
plain word.  Landmarks are words; the kernel towards them, whitened by their own
kernel matrix, gives the features of a linear machine.  As the kernel is an
inner product of subsequence weights, the landmarks' coefficients add up to one
weight per subsequence, and scoring a word is a sum over its subsequences.

Labels hold for documents.  A toxic one has some sentence with a toxic word: the
first such words are those with the character sequences most bound to toxic
documents; after each training the machine picks them anew, and the clean
documents' highest-scoring words join the negatives.  Positives and some
negatives are also learned with characters inserted.  A document scores as its
highest word does, passed through a logistic curve fitted to the documents.

The machine is fitted on the driver to at most ``CLEAN_DOCS`` and ``TOXIC_DOCS``
labelled documents of at most ``FIT_CHARS`` characters, the first by a hash of
their id.  Scoring reads whole texts of any length.

Edge cases: NULL and empty texts score as a text without any toxic word; without
labels of both kinds the score is 0; labels that are NULL are skipped; repeated
rows score alike; extra columns pass through.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CLEAN_DOCS, TOXIC_DOCS, FIT_CHARS = 3000, 1500, 10_000
THRESHOLD = 0.7
SPAN, DECAY = 5, 0.7
# Longer words are read in pieces that overlap.
PIECE, STRIDE = 30, 20
TABLE_BITS = 20
LANDMARKS = 512
NEGATIVES, MINED, ROUNDS = 12_000, 3_000, 2
COST = 10.0
# Characters of texts that are scored together, new tokens valued at a time, bytes of remembered tokens, each with so much besides its letters.
TOGETHER, PORTION, REMEMBERED, OVERHEAD = 1 << 20, 10_000, 48 << 20, 200
# Clean words that are learned in any case: the most frequent ones.
FREQUENT = 3000
# A word of a toxic document is taken as its cause at this evidence, or at this value of the machine.
TELLING, SURE = 25.0, 0.3
# Of a text without words.
FLOOR = -2.0

_outside = re.compile(r"^[\W_]+|[\W_]+$").sub
_not_letters = re.compile(r"[\W_]+").sub
_spaced = re.compile(r"(?<!\S)\w(?:\s\w){3,}(?!\S)").findall
_OFFSETS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]


def units(token: str) -> list[str]:
    """What of a token is scored: its inner part, and its letters alone if other characters stand between."""
    inner = _outside("", token)
    bare = _not_letters("", inner)
    forms = [inner] if bare == inner else [inner, bare]
    return [
        f"^{form}$"[at : at + PIECE]
        for form in forms if len(form) >= 3
        for at in range(0, max(1, len(form) + 2 - PIECE + STRIDE), STRIDE)
    ]


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a whole text, and runs of single spaced letters as one token each."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    found.update("".join(run.split()) for run in _spaced(text))
    return found


def subsequences(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per piece (rows) the table places of its subsequences and their weights, of unit length in sum of squares."""
    width = max(map(len, pieces)) + SPAN
    codes = np.frombuffer("".join(p.ljust(width, "\0") for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.reshape(len(pieces), width).astype(np.uint64)
    n = width - SPAN
    first = codes[:, :n]
    places, weights = [], []
    with np.errstate(over="ignore"):
        for j, k in _OFFSETS:
            second, third = codes[:, j : j + n], codes[:, k : k + n]
            mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F)) + third * np.uint64(0x165667B19E3779F9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            places.append((mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            weights.append(np.where(third > 0, np.float32(DECAY ** (k + 1)), np.float32(0)))
    place, weight = np.concatenate(places, 1), np.concatenate(weights, 1)
    # The kernel of the piece with itself: places that come again count together.
    order = np.argsort(place, axis=1, kind="stable")
    sorted_place, sorted_weight = np.take_along_axis(place, order, 1), np.take_along_axis(weight, order, 1)
    last = np.ones(place.shape, bool)
    last[:, :-1] = sorted_place[:, 1:] != sorted_place[:, :-1]
    ends = np.where(last, np.cumsum(sorted_weight, 1, dtype=np.float64), 0.0)
    totals = ends - np.pad(np.maximum.accumulate(ends, 1), ((0, 0), (1, 0)))[:, :-1]
    norm = np.sqrt((np.where(last, totals, 0.0) ** 2).sum(1, keepdims=True))
    return place, (weight / np.maximum(norm, 1e-9)).astype(np.float32)


@dataclass
class Model:
    """One weight per subsequence, an offset, and the logistic curve of a document's best word."""

    places: np.ndarray
    values: np.ndarray
    offset: float
    slope: float
    shift: float

    @functools.cached_property
    def table(self) -> np.ndarray:
        table = np.zeros(1 << TABLE_BITS, np.float32)
        table[self.places] = self.values
        return table

    def of_pieces(self, pieces: list[str]) -> np.ndarray:
        out = np.empty(len(pieces), np.float64)
        for at in range(0, len(pieces), 1024):
            place, weight = subsequences(pieces[at : at + 1024])
            out[at : at + 1024] = (self.table[place] * weight).sum(1) + self.offset
        return out

    def of_tokens(self, words: Iterable[str]) -> dict[str, float]:
        """The machine's value of each token: the highest of its forms and pieces."""
        forms = {w: units(w) for w in words}
        # Pieces of like length together, so that little is padded.
        pieces = sorted({p for some in forms.values() for p in some}, key=lambda p: (len(p), p))
        value = dict(zip(pieces, self.of_pieces(pieces).tolist()))
        return {w: max(map(value.__getitem__, some), default=FLOOR) for w, some in forms.items()}

    def probability(self, best: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * best + self.shift))))


class Scorer:
    """Scores texts, taken together by their characters; values of tokens are remembered up to a bound in bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}
        self.held = 0

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        group, size = [], 0
        for text in texts:
            group.append(tokens(text))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._scores(group)
                group, size = [], 0
        yield from self._scores(group)

    def _scores(self, sets: list[set[str]]) -> Iterator[float]:
        new = sorted(set().union(*sets).difference(self.known), key=len)
        for at in range(0, len(new), PORTION):
            self.known.update(self.model.of_tokens(new[at : at + PORTION]))
        best = [max(map(self.known.__getitem__, words), default=FLOOR) for words in sets]
        self.held += sum(map(len, new)) + OVERHEAD * len(new)
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        yield from map(self.model.probability, best)


# Fitting.


def grams(pieces: list[str]) -> np.ndarray:
    """Per piece the hashed character sequences of length 4 and 5; -1 where there is none."""
    width = max(map(len, pieces)) + 5
    codes = np.frombuffer("".join(p.ljust(width, "\0") for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.reshape(len(pieces), width).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for size in (4, 5):
            n = width - size
            mixed = np.full((len(pieces), n), np.uint64(size))
            for k in range(size):
                mixed = (mixed ^ codes[:, k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            out.append(np.where(codes[:, size - 1 : size - 1 + n] > 0, (mixed >> np.uint64(43)).astype(np.int32), np.int32(-1)))
    return np.concatenate(out, 1)


def evidence(docs: list[np.ndarray], toxic: np.ndarray, words: list[str]) -> np.ndarray:
    """Per piece how much its most telling character sequence is bound to toxic documents (signed likelihood ratio)."""
    step = 10_000
    parts = [grams([w.ljust(PIECE, "\0") for w in words[i : i + step]]) for i in range(0, len(words), step)]
    ids = np.concatenate(parts)
    size = 1 << 21
    seen = np.zeros((2, size), np.int64)
    for doc, label in zip(docs, toxic):
        own = np.unique(ids[doc])
        seen[int(label), own[own >= 0]] += 1
    totals = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    clean, bad = seen[0] + 0.0, seen[1] + 0.0
    share = (clean + bad) / totals.sum()

    def part(n, total):
        expected = np.maximum(share * total, 1e-9)
        return np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / expected), 0.0)

    ratio = 2 * (part(bad, totals[1]) + part(clean, totals[0])) * np.sign(bad / totals[1] - clean / totals[0])
    ratio = np.append(ratio, 0.0)  # for -1
    return np.concatenate([ratio[p].max(1) for p in parts])


def inserted(word: str, rng: np.random.Generator) -> str:
    """The piece with a character between all or some of its letters, as far as a piece reaches."""
    head, word, tail = word[: word.startswith("^")], word.strip("^$"), word[len(word) - word.endswith("$") :]
    mark = ".*-_~"[int(rng.integers(5))]
    everywhere = rng.random() < 0.5
    return (head + "".join(c + (mark if everywhere or rng.random() < 0.3 else "") for c in word[:-1]) + word[-1:] + tail)[:PIECE]


def machine(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; the last weight is the offset."""
    x = np.hstack([features, np.ones((len(features), 1), np.float32)])
    inside = np.ones(len(x), bool)
    for _ in range(30):
        left, right = np.eye(x.shape[1]), np.zeros(x.shape[1])
        left[-1, -1] = 1e-3
        for at in range(0, len(x), 2000):  # in blocks, to spare memory
            rows = slice(at, at + 2000)
            own = x[rows][inside[rows]].astype(float)
            c = COST * weights[rows][inside[rows]]
            left += (own * c[:, None]).T @ own
            right += own.T @ (c * labels[rows][inside[rows]])
        w = np.linalg.solve(left, right)
        after = labels * (x @ w) < 1
        if (after == inside).all():
            break
        inside = after
    return w


def trained(pieces: list[str], labels: np.ndarray, weights: np.ndarray, landmarks: list[str]) -> Model:
    """Nyström features towards the landmarks, the machine on them, folded into one weight per subsequence."""
    place, weight = subsequences(landmarks)
    columns, at = np.unique(place, return_inverse=True)
    table = np.zeros((len(columns) + 1, len(landmarks)), np.float32)
    np.add.at(table, (at.reshape(place.shape), np.arange(len(landmarks))[:, None]), weight)

    def kernel(words: list[str]) -> np.ndarray:
        rows = []
        for i in range(0, len(words), 64):
            p, w = subsequences(words[i : i + 64])
            found = np.searchsorted(columns, p).clip(max=len(columns) - 1)
            found = np.where(columns[found] == p, found, len(columns))
            rows.append(np.einsum("nf,nfm->nm", w, table[found]))
        return np.concatenate(rows)

    values, vectors = np.linalg.eigh(kernel(landmarks).astype(float))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    w = machine(kernel(pieces) @ whiten.astype(np.float32), labels, weights)
    folded = table[:-1].astype(float) @ (whiten @ w[:-1])
    return Model(columns, folded.astype(np.float32), float(w[-1]), 1.0, 0.0)


def logistic_curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, lightly held back."""
    slope, shift = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * values + shift, -30, 30)))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(g * values).sum() + 0.05 * slope, g.sum()])
        hessian = np.array([[(h * values * values).sum() + 0.05, (h * values).sum()], [(h * values).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        slope, shift = slope - float(np.clip(step[0], -1, 1)), shift - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), shift


def fit(rows: Iterable[tuple[int, list[str]]]) -> Model | None:
    """The model of documents given as (label, distinct tokens), in any order; None if one label is missing.

    What is learned from are the pieces of the tokens (``units``), those that are scored.
    """
    rng = np.random.default_rng(7)
    number: dict[str, int] = {}
    read = []
    for label, tokens_of_row in rows:
        own = {p for w in tokens_of_row for p in units(w)}
        read.append((label, np.array([number.setdefault(p, len(number)) for p in own], np.int32)))
    # Numbers by the pieces' order, documents by their words: the same whatever the order of the rows.
    words = sorted(number)
    place = np.empty(len(words), np.int32)
    place[[number[w] for w in words]] = np.arange(len(words))
    del number
    read = sorted(((label, np.sort(place[d])) for label, d in read), key=lambda r: (r[0], r[1].tobytes()))
    toxic, docs = np.array([label for label, _ in read], int), [d for _, d in read]
    if not 0 < toxic.sum() < len(toxic):
        return None
    pieces = words
    bound = evidence(docs, toxic, words)
    bad_docs = [d for d, t in zip(docs, toxic) if t and len(d)]
    clean_words = np.unique(np.concatenate([d for d, t in zip(docs, toxic) if not t] or [np.empty(0, int)]))
    mined = hardest = np.empty(0, int)
    value, model = bound, None
    in_bad, in_clean = (np.bincount(np.concatenate([d for d, t in zip(docs, toxic) if t == label]), minlength=len(words)) for label in (1, 0))
    leaning = in_bad * (toxic == 0).sum() > 4 * in_clean * toxic.sum()  # clearly more often in toxic documents
    frequent = np.argsort(-in_clean, kind="stable")[:FREQUENT]
    chosen_clean = np.concatenate([rng.permutation(clean_words)[:NEGATIVES], frequent[in_clean[frequent] > 0]])
    for turn in range(ROUNDS + 1):
        # The words that make a document toxic: the best, and others nearly as good.
        witness: dict[int, int] = {}
        for doc in bad_docs:
            near = bound[doc] >= max(TELLING, 0.7 * bound[doc].max())
            if turn:
                near |= value[doc] >= SURE
            for i in doc[near & leaning[doc]]:
                witness[int(i)] = witness.get(int(i), 0) + 1
        counts = sorted(witness.items(), key=lambda x: (-x[1], words[x[0]]))
        if not counts:
            break
        positive = [i for i, _ in counts][: NEGATIVES // 2]
        negative = np.unique(np.concatenate([chosen_clean, mined]))
        negative = negative[~np.isin(negative, positive) | np.isin(negative, mined)]
        varied = [inserted(words[i], rng) for i in positive[:500] for _ in range(2)]
        harmless = [inserted(words[i], rng) for i in negative[:1000]]
        landmarks = [
            pieces[i] for i in (*positive[: LANDMARKS // 2], *hardest[: LANDMARKS * 3 // 8], *rng.permutation(negative)[: LANDMARKS // 8])
        ]
        every = [pieces[i] for i in positive] + varied + [pieces[i] for i in negative] + harmless
        n = len(positive) + len(varied)
        labels = np.where(np.arange(len(every)) < n, 1.0, -1.0)
        weights = np.ones(len(every))
        weights[: len(positive)] = [min(10.0, witness[i] ** 0.5) for i in positive]
        model = trained(every, labels, weights, [*dict.fromkeys(landmarks)])
        value = model.of_pieces(pieces)
        hardest = clean_words[np.argsort(-value[clean_words], kind="stable")[: MINED // ROUNDS]]
        mined = np.unique(np.concatenate([mined, hardest[value[hardest] > -0.7]]))
    if model is None:
        return None
    best = np.array([value[d].max() if len(d) else FLOOR for d in docs])
    slope, shift = logistic_curve(best, toxic.astype(float))
    return Model(model.places, model.values, model.offset, slope, shift)


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | None:
    """Fit to a bounded sample of the labelled documents for which ``usable`` holds."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    marked = marked.where(usable)
    chosen = [
        marked.where(F.col("toxic") == label).dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for label, n in ((0, CLEAN_DOCS), (1, TOXIC_DOCS))
    ]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most CLEAN_DOCS + TOXIC_DOCS rows
    short = docs.select("doc_id", "text").where(F.length("text") <= FIT_CHARS)
    lowered = F.array_distinct(F.split(F.lower("text"), r"\s+"))
    rows = short.join(sample, "doc_id").select("toxic", F.array_join(lowered, " ").alias("words"))
    return fit((r.toxic, r.words.split(" ")) for r in rows.toLocalIterator())


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(text: Column, model: Model | None) -> Column:
    """The score of a whole text, from 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.Series([*scorer.scores(batch)], dtype="float64")

    return score(text)


def keep_clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``THRESHOLD``."""
    return docs.where(scored(F.col(text), model) < THRESHOLD)
