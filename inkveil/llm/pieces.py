"""Byte-pair encoding of a sentencepiece model by a table of prefixes, and decoding.

Such a model merges any two neighbours whose joined text is a piece; a piece's
rank says when, and of equal ranks the left one comes first.  For every prefix
of a text one piece is the last of the prefix's encoding: the only one that
ends there and goes with the last piece of the prefix before it.  Two pieces go
together if no merge across their border comes before the merges that make
them.  So the table of last pieces is filled from left to right: an automaton
over all pieces gives those that end at a place, the test on pairs (remembered)
picks the one, and the ids are read backwards from the end of the table.

A text is cut where no merge can cross: between characters of kinds that no
piece mixes, before a blank that follows something else, and around characters
that occur in no piece, which become bytes.  Equal chunks are encoded once; what is remembered
is bounded in bytes and dropped at the end of a task.  The table has one place
a character, of the new chunks of about a million characters of texts or of one
longer text.

Edge cases: a NULL text is read as the empty one, which has no ids and decodes
to the empty text; strings of control pieces inside a text are plain text;
repeated rows are encoded each for itself, an empty table gives an empty one,
and extra columns pass through.  A model with another normalizer, user-defined
or unused pieces, or without bytes for unknown characters is refused.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file

T = TypeVar("T")
BLANK = "▁"
# Chunks up to this length are remembered, up to so many bytes in two generations.
SHORT, REMEMBERED = 64, 64 << 20
# About what a remembered chunk takes besides its characters and ids.
OVERHEAD = 200
# Known pairs are forgotten when they are more than this.
PAIRS = 400_000
# So many ids are decoded at a time.
DECODED = 1 << 14
UNMADE = (-1.0, "", "")
# Stands for the begin of a chunk in the table of prefixes: the id of unknown text, which no piece has.
BEGIN = 0
# Between chunks that are encoded together, in groups of texts of about so many characters.
SEPARATOR, TOGETHER = "\n", 1 << 20


def _cuts(pieces: Iterable[str]) -> tuple[Callable[[str], list[str]], Callable[[str], object]]:
    """What splits a text where no merge can cross, and what tells chunks of characters that occur in no piece.

    Characters that stand side by side in a piece are of one kind; a place
    between two kinds is inside no piece.  If no piece has a blank after
    another character, blanks are of no kind and go with what follows them.
    """
    parent: dict[str, str] = {}

    def kind(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    pieces = [*pieces]
    blanks = "" if any(BLANK in s.lstrip(BLANK) for s in pieces) else BLANK
    joined = set()
    for c in {c for s in pieces for c in s}:
        kind(c)
    for c, d in {(c, d) for s in pieces for c, d in zip(s, s[1:])}:
        if blanks not in (c, d):
            parent[kind(c)] = kind(d)
            joined |= {c, d}
    kinds: dict[str, list[str]] = {}
    for c in parent:
        if c != blanks:
            kinds.setdefault(kind(c), []).append(c)

    def one_of(letters: Iterable[str]) -> str:
        return f"[{re.escape(''.join(sorted(letters)))}]"

    lead = f"{blanks}*" if blanks else ""
    several = [f"{lead}{one_of(k)}+" for k in kinds.values() if k[0] in joined]
    alone = [k[0] for k in kinds.values() if k[0] not in joined]
    single = [lead + one_of(alone)] if alone else []
    outside = f"[^{re.escape(''.join(sorted(parent)))}]"
    runs = [f"{blanks}+"] if blanks else []
    return re.compile("|".join([*several, *single, *runs, f"{outside}+"])).findall, re.compile(outside).match


class PieceTable:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        model = model_file.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = model_file.ModelProto.SentencePiece
        rules, trained = model.normalizer_spec, model.trainer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the model normalizes its texts")
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("no byte-pair model with bytes for unknown characters")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.rank = {s: -model.pieces[i].score for s, i in normal.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.texts = {
            i: "" if i in silent else trained.unk_surface if i in unknown else p.piece
            for i, p in enumerate(model.pieces) if p.type != kinds.BYTE
        }
        shown = {i: s.replace(BLANK, " ") for i, s in self.texts.items()}
        self.marked = {i: s or ENDS for i, s in shown.items()} | {i: chr(b if b < 128 else 0xDC00 + b) for b, i in self.bytes.items()}
        letters = {c for s in normal for c in s}
        # Characters that occur in pieces without being one get numbers after all ids.
        self.letters = dict(enumerate(sorted(letters - normal.keys()), len(model.pieces)))
        self.names = [p.piece for p in model.pieces] + list(self.letters.values())
        self._derive(letters)
        self.automaton = ahocorasick.Automaton()
        ids = normal | {c: i for i, c in self.letters.items()}
        self.base = len(self.names)
        if self.names[BEGIN] in ids or SEPARATOR in letters:
            raise ValueError("the first id or the line end is a piece")
        for s in [*self._made, *letters]:
            self.automaton.add_word(s, (ids[s], len(s) - 1, ids[s] * self.base))
        self.automaton.make_automaton()
        self.sizes = [*map(len, self.names)]
        self.numbers = [*map(str, range(len(self.names)))]
        self._chunks, self._foreign = _cuts(normal)
        self._pairs: dict[int, bool] = {}
        self.forget()

    def _derive(self, letters: set[str]) -> None:
        """Rank and parts of the merge that makes each piece; pieces that their own text doesn't give are left out."""
        self._made: dict[str, tuple[float, str, str]] = {}
        whole = set(letters)
        for s in sorted(self.rank, key=lambda s: (self.rank[s], len(s))):
            for at in range(1, len(s)):
                u, v = s[:at], s[at:]
                if u in whole and v in whole and self._together(u, v, self.rank[s]):
                    self._made[s] = (self.rank[s], u, v)
                    whole.add(s)
                    break

    def _together(self, left: str, right: str, limit: float) -> bool:
        """Whether no merge ranked below ``limit`` joins the end of ``left`` with the begin of ``right``.

        The merges inside both are undone, latest first: of equal ranks those
        on the right.  This shows every two neighbours that ever met at the
        border, and ``limit`` is when they were parted.
        """
        rank, made = self.rank.get, self._made.get
        while True:
            if rank(left + right, math.inf) < limit:
                return False
            (a, _, end), (b, begin, _) = made(left, UNMADE), made(right, UNMADE)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = end, a
            else:
                right, limit = begin, b + 0.5

    def _check(self, key: int) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        before, piece = divmod(key, self.base)
        known = self._pairs[key] = before == BEGIN or self._together(self.names[before], self.names[piece], math.inf)
        return known

    def _last_pieces(self, text: str) -> list[int]:
        """The last piece of each prefix, times ``base``, of the chunks in ``text``.

        The chunks, which hold only characters that occur in pieces, stand
        between line ends, which occur in none: no match reaches across.
        """
        last = [BEGIN * self.base] * (len(text) + 1)
        pairs, check, done = self._pairs.get, self._check, 0
        for place, (piece, more, scaled) in self.automaton.iter(text):
            if place >= done:  # else settled by a longer piece
                key = last[place - more] + piece
                known = pairs(key)
                if known or known is None and check(key):
                    done = place + 1
                    last[done] = scaled
        return last

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks and remember them."""
        known, base, sizes, held = self._known, self.base, self.sizes, 0
        near = [c for c in chunks if not self._foreign(c)]
        last, end = self._last_pieces(SEPARATOR.join(near)), -1
        for chunk in near:
            begin = end + 1
            end = at = begin + len(chunk)
            found = []
            while at > begin:
                piece = last[at] // base
                found.append(piece)
                at -= sizes[piece]
            found.reverse()
            if self.letters and not self.letters.keys().isdisjoint(found):
                parts = ([self.bytes[b] for b in self.letters[i].encode()] if i in self.letters else [i] for i in found)
                found = [i for part in parts for i in part]
            known[chunk] = ids = array("I", found).tobytes()
            held += OVERHEAD + 4 * len(chunk) + len(ids)
        for chunk in chunks:
            if self._foreign(chunk):
                known[chunk] = ids = array("I", [self.bytes[b] for b in chunk.encode("utf-8", "surrogatepass")]).tobytes()
                held += OVERHEAD + 4 * len(chunk) + len(ids)
        self._held += held

    def forget(self) -> None:
        """Drop what is remembered of chunks."""
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; texts are taken together up to some size."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self._chunks(self.prefix + text.replace(" ", BLANK)) if text else [])
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> list[bytes]:
        if self._held > REMEMBERED:
            self._known, self._older, self._held = {}, self._known, 0
        missing = set().union(*group).difference(self._known)
        old = missing.intersection(self._older)
        for chunk in old:
            ids = self._known[chunk] = self._older[chunk]
            self._held += OVERHEAD + 4 * len(chunk) + len(ids)
        self._learn([*(missing - old)])
        done = [b"".join(map(self._known.__getitem__, chunks)) for chunks in group]
        for chunk in missing:
            if len(chunk) > SHORT:
                self._held -= OVERHEAD + 4 * len(chunk) + len(self._known.pop(chunk))
        return done

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode_steps(self, ids: bytes) -> Iterator[str]:
        """The text of ids, of ``DECODED`` at a time."""
        machine = PieceText(self)
        for at in range(0, len(ids), 4 * DECODED):
            yield machine.feed(array("I", ids[at : at + 4 * DECODED]))
        yield machine.end()

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_steps(ids))


class PieceText:
    """Ids to text in steps: calls may cut the ids anywhere.

    The state is whether the first piece has come, which loses the blank put
    before the text, and the at most three bytes of a character begun.  A byte
    that belongs to no character gives U+FFFD; a piece without text ends a
    character begun.
    """

    def __init__(self, table: PieceTable):
        self.table, self.begun, self.pending = table, False, ""

    def feed(self, ids: array) -> str:
        table = self.table
        first = None if self.begun else next((i for i in ids if table.texts.get(i) != ""), None)
        text = "".join(map(table.marked.__getitem__, ids))
        if first is not None:
            self.begun = True
            if table.prefix and table.texts.get(first, "").startswith(BLANK):
                text = text.replace(" ", "", 1)  # only pieces without text stand before it
        if self.pending:
            text, self.pending = self.pending + text, ""
        if HIGH.search(text):
            if tail := UNENDED.search(text):
                text, self.pending = text[: tail.start()], tail[0]
            text = HIGH.sub(_characters, text)
        return text.replace(ENDS, "")

    def end(self) -> str:
        rest, self.pending = self.pending, ""
        return HIGH.sub(_characters, rest)


# Stands for a piece without text until the characters are made.
ENDS = "\udc00"
# Bytes over 127 stand as lone surrogates until their characters are whole.
HIGH = re.compile("[\udc80-\udcff]+")
UNENDED = re.compile(
    "(?:[\udcc2-\udcdf]|[\udce0-\udcef][\udc80-\udcbf]?|[\udcf0-\udcf4][\udc80-\udcbf]{0,2})\\Z"
)


def _characters(run: re.Match[str]) -> str:
    data, text = run[0].encode("utf-8", "surrogateescape"), ""
    while True:
        try:
            return text + data.decode()
        except UnicodeDecodeError as wrong:
            text += data[: wrong.start].decode() + "\ufffd"
            data = data[wrong.start + 1 :]


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """Compiled once per Python process."""
    return PieceTable(path)


def _over_texts(path: str, made: Callable[[PieceTable, Iterator[bytes]], T]) -> Callable[[Iterator[pd.Series]], Iterator[T]]:
    """A batch function that gives what is ``made`` of the ids of the texts, and forgets chunks at the end of the task."""

    def run(texts: Iterator[pd.Series]) -> Iterator[T]:
        table = piece_table(path)
        try:
            for batch in texts:
                yield made(table, table.encode_all(batch))
        finally:
            table.forget()

    return run


def encoded(text: Column, path: str) -> Column:
    """The ids of a text as binary, little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _over_texts(path, lambda _, ids: pd.Series([*ids], dtype=object))(texts)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of binary ids."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = piece_table(path)
        for batch in batches:
            yield pd.Series([table.decode(i or b"") for i in batch], dtype=object)

    return decode(ids)


def _digests(table: PieceTable, ids: bytes) -> tuple[int, str, str]:
    numbers, back = hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(ids), 4 * DECODED):
        step = ",".join(map(table.numbers.__getitem__, array("I", ids[at : at + 4 * DECODED])))
        numbers.update(("," + step if at else step).encode())
    for step in table.decode_steps(ids):
        back.update(step.encode())
    return len(ids) // 4, numbers.hexdigest(), back.hexdigest()


def round_trip(text: Column, path: str) -> Column:
    """``n_tokens, ids_sha256, decoded_sha256`` of a text: encoded, decoded again, and both digested where they arise."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _over_texts(path, lambda t, all_ids: pd.DataFrame([_digests(t, i) for i in all_ids], columns=names))(texts)

    return digests(text)
