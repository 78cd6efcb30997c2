"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

A tokenizer file (merge list, end-of-word suffix, split pattern) is compiled
once per Python worker.  A word is read symbol by symbol.  For each prefix the
last token of its encoding is kept: it is the only vocabulary token ending
there that is compatible with the last token of the prefix before it, where two
tokens are compatible if encoding their joined text gives them back.  Only the
prefixes within the longest token's length can still be continued; tokens that
all of these have in common are stable and are emitted.  How far tokens can
stay unstable is computed from the merge list (``lookahead``); long words are
read in windows of that many symbols, so that each window brings tokens that
are final.  Which ones is still decided by the live prefixes, so ids never rest
on the bound.  Decoding takes a bounded number of ids at a time.

As the state after a prefix does not depend on what follows, words are taken in
sorted order and share the states of common prefixes; results are remembered
for words met again, up to a fixed number of them.

Edge cases: NULL text encodes and decodes like the empty text, to no ids and
an empty string.  Strings of special tokens inside a text become their ids, as
the tokenizer file demands.  Extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, functions as F

REMEMBERED = 500_000
# Longer words are streamed.
SHORT = 256
# So many ids are decoded at a time.
DECODED = 1 << 14
# Texts are encoded in groups of about so many characters.
TOGETHER = 4_000_000
# Stands for the begin of a word where a token is asked for.
START = 0xFFFF
# Of a single symbol, which no merge makes.
UNMADE = (-1, "", "")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free letter from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        if max(self.ids.values(), default=0) >= START:
            raise ValueError("ids of more than 16 bits")
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        self._special = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split = regex.compile(pattern)
        self._gaps = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)
        self._odd = regex.compile(r"[\x1c-\x1f]").search
        self._letters = str.maketrans(dict(enumerate(byte_letters())))
        self._longest = max(len(s) - len(self.suffix) * s.endswith(self.suffix) for s in self.ids)
        # Rank and parts of the merge that makes a token; tokens that don't encode to themselves never appear.
        self._made = {u + v: (r, u, v) for (u, v), r in self.rank.items()}
        whole = {*self.ids} - {*self._made}
        whole.update(t for t, (r, u, v) in self._made.items() if self._neighbours(u, v, r))
        for token, (_, u, v) in self._made.items():  # parts come before what is made of them
            if not (u in whole and v in whole):
                whole.discard(token)
        self._inner = {s: self.ids[s] for s in whole if not s.endswith(self.suffix)}
        self._final = {s.removesuffix(self.suffix): self.ids[s] for s in whole if s.endswith(self.suffix)}
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _neighbours(self, left: str, right: str, limit: float) -> bool:
        """Whether no merge below the rank ``limit`` joins the end of ``left`` with the begin of ``right``.

        Undoing the merges inside both, latest first, gives every pair of
        symbols that ever met at the border, and ``limit`` is when that pair
        was parted.  Of equal merges that overlap, the left one comes first.
        """
        rank, made = self.rank.get, self._made.get
        while True:
            joined = rank((left, right))
            if joined is not None and joined < limit:
                return False
            (a, _, part_a), (b, part_b, _) = made(left, UNMADE), made(right, UNMADE)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = part_a, a
            else:
                right, limit = part_b, b + 0.5

    def _check(self, key: int) -> bool:
        known = key >> 16 == START or self._neighbours(self.pieces[key >> 16], self.pieces[key & 0xFFFF], math.inf)
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        self._pairs[key] = known
        return known

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols after which earlier tokens can no longer change, from the merge list.

        What follows a merge of (u, v) can undo it only by taking a token on
        the right edge of v in a merge of lower rank, and so on to the right:
        the longest chain of rising ranks, in symbols.
        """
        edges: dict[str, set[str]] = {}
        reach: dict[str, int] = {}
        longest = 0
        for u, v in self.rank:  # in order of rank
            right = edges.get(v, {v})
            far = len(v) + max((reach.get(a, 0) for a in right), default=0)
            reach[u] = max(reach.get(u, 0), far)
            edges.setdefault(u + v, set()).update(right, {u + v})
            longest = max(longest, far)
        return longest + self._longest

    def _extend(self, text: str, end: int, last: list[int], sizes: list[int]) -> None:
        """Find the last token of each prefix of ``text`` up to ``end``; those of shorter prefixes are known already."""
        tokens, pairs, check, longest = self._inner.get, self._pairs.get, self._check, self._longest
        for stop in range(len(last), end + 1):
            for size in range(1, min(stop, longest) + 1):
                token = tokens(text[stop - size : stop])
                if token is not None:
                    key = last[stop - size] << 16 | token
                    if (known := pairs(key)) or known is None and check(key):
                        last.append(token)
                        sizes.append(size)
                        break

    def _finish(self, text: str, last: list[int], sizes: list[int]) -> list[int]:
        """The tokens of a word all of whose prefixes are known; its last symbol carries the end of the word."""
        stop = len(text)
        for size in range(1, min(stop, self._longest) + 1):
            token = self._final.get(text[stop - size :])
            if token is not None:
                key = last[stop - size] << 16 | token
                if (known := self._pairs.get(key)) or known is None and self._check(key):
                    return [*self._path(last, sizes, stop - size), token]
        raise ValueError("the vocabulary lacks single bytes")

    def word(self, symbols: Iterable[str]) -> Iterator[int]:
        """Ids of one word of any length, emitted as soon as they are stable.  ``symbols`` are byte letters."""
        source, window = iter(symbols), self.lookahead
        text = "".join(itertools.islice(source, window))  # what tokens may still reach back to
        last, sizes = [START], [0]
        while more := "".join(itertools.islice(source, window)):
            self._extend(text, len(text), last, sizes)
            stable = self._stable(sizes, range(max(1, len(text) - self._longest), len(text) + 1))
            if stable:
                done = self._path(last, sizes, stable)
                yield from done
                text, last, sizes = text[stable:], [done[-1], *last[stable + 1 :]], [0, *sizes[stable + 1 :]]
            text += more
        if text:
            self._extend(text, len(text) - 1, last, sizes)
            yield from self._finish(text, last, sizes)

    def _short_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted ``words``: what is known of a prefix also serves the next words that begin so."""
        before, last, sizes = "", [START], [0]
        for word in words:
            same, most = 0, min(len(word), len(before)) - 1
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], sizes[same + 1 :]
            self._extend(word, len(word) - 1, last, sizes)
            yield self._finish(word, last, sizes)
            before = word

    @staticmethod
    def _path(last: list[int], sizes: list[int], end: int) -> list[int]:
        path = []
        while end > 0:
            path.append(last[end])
            end -= sizes[end]
        return path[::-1]

    @staticmethod
    def _stable(sizes: list[int], live: Iterable[int]) -> int:
        """The last place through which the tokens of every live prefix pass."""
        ends = set(live)
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - sizes[end])
        return ends.pop()

    # Texts.

    def learn(self, chunks: set[str]) -> None:
        """Encode normalized texts without white space and remember them."""
        parts = {c: [c] if c.isalpha() else self._split.findall(c) for c in chunks}
        letters = {w: w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
                   for words in parts.values() for w in words}
        short = sorted({w for w in letters.values() if len(w) <= SHORT})
        ids = {w: array("I", found).tobytes() for w, found in zip(short, self._short_words(short))}
        for chunk, words in parts.items():
            self._known[chunk] = b"".join(
                [ids[w] if (w := letters[x]) in ids else array("I", self.word(w)).tobytes() for x in words]
            )

    def _encode_chunks(self, chunks: list[str]) -> bytes:
        return b"".join(map(self._known.__getitem__, chunks))

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()  # each letter for itself, without final sigma

    def _chunks(self, text: str) -> list[str]:
        text = self.normalized(text)
        return [c for c in self._gaps.split(text) if c] if self._odd(text) else text.split()

    def _parts(self, text: str | None) -> list[list[str] | bytes]:
        """Chunks to encode, and ids of special tokens between them."""
        if not text:
            return []
        if not any(t in text for t in self.added):
            return [self._chunks(text)]
        parts: list[list[str] | bytes] = []
        at = 0
        for match in self._special.finditer(text):
            parts += [self._chunks(text[at : match.start()]), self.added[match[0]].to_bytes(4, "little")]
            at = match.end()
        return [*parts, self._chunks(text[at:])]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; texts are taken together up to some size."""
        group: list[list[list[str] | bytes]] = []
        size = 0
        for text in texts:
            group.append(self._parts(text))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[list[str] | bytes]]) -> Iterator[bytes]:
        if len(self._known) >= REMEMBERED:
            self._known, self._older = {}, self._known
        missing = set().union(*(p for parts in group for p in parts if isinstance(p, list))).difference(self._known)
        old = missing.intersection(self._older)
        self._known.update(zip(old, map(self._older.__getitem__, old)))
        self.learn(missing - old)
        for parts in group:
            yield b"".join([p if isinstance(p, bytes) else self._encode_chunks(p) for p in parts])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """The pieces of the ids with a blank between them, as a tokenizer file without a decoder has it."""
        return "".join(self.decode_steps(ids))

    def decode_steps(self, ids: bytes) -> Iterator[str]:
        """What ``decode`` gives, of ``DECODED`` ids at a time."""
        machine = PieceMachine(self.pieces)
        for at in range(0, len(ids), 4 * DECODED):
            yield machine.feed(array("I", ids[at : at + 4 * DECODED]))
        yield machine.end()


class PieceMachine:
    """Ids to text in steps: the state is whether anything was written, so calls may cut the ids anywhere."""

    def __init__(self, pieces: dict[int, str]):
        self.pieces, self.begun = pieces, False

    def feed(self, ids: Iterable[int]) -> str:
        text = " ".join(map(self.pieces.__getitem__, ids))
        if text and self.begun:
            text = " " + text
        self.begun = self.begun or bool(text)
        return text

    def end(self) -> str:
        return ""


class TextMachine:
    """Ids to readable text in steps: word ends become blanks, bytes become characters once complete.

    The state is the at most three bytes of a character begun; a byte that
    can't continue it gives U+FFFD.
    """

    def __init__(self, transducer: Transducer):
        self.suffix = transducer.suffix
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes = {
            i: bytes(byte[c] for c in s.removesuffix(self.suffix)) + b" " * s.endswith(self.suffix)
            for s, i in transducer.ids.items()
        } | {i: s.encode() for s, i in transducer.added.items()}
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.pending + b"".join(map(self.bytes.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                cut = len(data) - back if back < need else cut
                break
            if lead < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Compiled once per Python process."""
    return Transducer(path)


def encoded(text: Column, path: str) -> Column:
    """The ids of a text as binary, little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in texts:
            yield pd.Series([*machine.encode_all(batch)], dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of binary ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = transducer(path)
        for batch in batches:
            yield pd.Series([machine.decode(i or b"") for i in batch], dtype=object)

    return decode(ids)


def round_trip(text: Column, path: str) -> Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of a text: encoded, decoded again, and both digested where they arise, so
    that ids never leave the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = transducer(path)

        def row(ids: bytes) -> tuple[int, str, str]:
            back = hashlib.sha256()
            for step in machine.decode_steps(ids):
                back.update(step.encode("utf-8", "surrogatepass"))
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

        for batch in texts:
            yield pd.DataFrame([*map(row, machine.encode_all(batch))], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
