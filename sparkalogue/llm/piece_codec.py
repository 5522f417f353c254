"""Encoding and decoding with a merge-type (BPE) sentencepiece model.

Each stretch of text that no merge can cross is encoded by an agenda: all adjacent pairs of
symbols that form a piece wait in a queue ordered by the piece's score (ties: leftmost), the
best is merged, and its new neighbours join the queue. Workers remember the ids of stretches,
and what a batch adds to that memory is checked against the library before the batch is
answered; so are the decoded texts.
"""

from __future__ import annotations

import codecs
import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, slices, texts_of

SPACE = "▁"
#: Stretches that a worker remembers: so many new ones, and as many that it met before those.
REMEMBER = 500_000
#: Up to so many symbols the agenda is a list, beyond it a heap.
SHORT = 40
#: Bytes of text that Python takes at a time.
SLICE_BYTES = 8_000_000
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    made = array("i", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class _Memory(dict):
    """Bytes by text, made where unknown; when full, what isn't asked for again goes with the next turn."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        self[text] = found
        return found

    def turn(self) -> None:
        if len(self) > REMEMBER:
            self.older = dict(self)
            self.clear()


class Codec:
    """One model file: ids of texts, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.library.serialized_model_proto()
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), np.frombuffer(piece.get(2, bytes(4)), "<f4")[0].item(), piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != BPE or any(kind == UNUSED for _, _, kind in pieces):
            raise ValueError("the agenda needs a merge-type model without unused pieces")
        self.end = self.library.eos_id()
        self.fixed = [p for p, _, kind in pieces if kind == USER_DEFINED]
        self.known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
        #: What the agenda is ordered by: the highest score comes first
        self.order = {p: -score for p, score, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.prefix = bool(normalizer.get(3, 1))
        #: The text itself but for spaces and the prefix; else the library normalises
        self.plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and self.prefix and not trainer.get(24, 0)
        longer = [p for p in self.known if len(p) > 1]
        #: No merge leads from another character to a space mark: there texts can be cut
        self.cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})") if not self.fixed and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer) else None
        #: Neighbouring characters within pieces; no merge crosses any other two
        self.inner = {p[i : i + 2] for p in longer for i in range(len(p) - 1)} if self.cut else None
        self.symbols = re.compile("|".join(map(re.escape, sorted(self.fixed, key=len, reverse=True))) + "|.", re.DOTALL) if self.fixed else None
        spelled = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelling = [spelled.get(i, {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}.get(kind, p.replace(SPACE, " ").encode())) for i, (p, _, kind) in enumerate(pieces)]
        #: Words with a space mark before them, and any other stretch
        self.words = _Memory(lambda word: self._cut_up(SPACE + word))
        self.parts = _Memory(self._whole)
        self.fresh: list[str] = []

    def agenda(self, text: str) -> list[int]:
        """Ids of a normalised stretch: the waiting pair of the highest score is merged, leftmost first."""
        if self.symbols is None:
            symbols = self._merged_short(list(text)) if len(text) <= SHORT else self._merged(list(text))
        else:
            symbols = self._merged(self.symbols.findall(text))
        ids: list[int] = []
        for s in symbols:
            if s in self.known:
                ids.append(self.known[s])
            elif self.bytes:
                ids += [self.bytes[b] for b in s.encode()]
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)  # neighbours that no piece spells are one unknown
        return ids

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """A few pairs wait in a list by place; its least entry is the next, and neighbours are replaced in it."""
        order, never = self.order.get, float("inf")
        waiting = [order(a + b, never) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while waiting and (best := min(waiting)) < never:
            i = waiting.index(best)
            pair = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del waiting[i]
            if i < len(waiting):
                waiting[i] = order(pair + symbols[i + 1], never)
            if i:
                waiting[i - 1] = order(symbols[i - 1] + pair, never)
        return symbols

    def _merged(self, symbols: list[str | None]) -> list[str]:
        """Many pairs wait in a heap; symbols are a linked list, and pairs that have changed since are passed over."""
        order, frozen = self.order, set(self.fixed)
        n = len(symbols)
        before, after, waiting = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def wait(i: int, j: int) -> None:
            pair = symbols[i] + symbols[j]
            if pair in order and not (frozen and (symbols[i] in frozen or symbols[j] in frozen)):
                heapq.heappush(waiting, (order[pair], i, j, pair))

        for i in range(n - 1):
            wait(i, i + 1)
        while waiting:
            _, i, j, pair = heapq.heappop(waiting)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                wait(i, after[i])
            if before[i] >= 0:
                wait(before[i], i)
        return [s for s in symbols if s is not None]

    def _cut_up(self, text: str) -> bytes:
        """Ids of a stretch; no merge crosses characters that stand beside each other in no piece."""
        pairs, inner = list(map(add, text, text[1:])), self.inner
        if inner.issuperset(pairs):
            return self._whole(text)
        cuts = [i for i, pair in enumerate(pairs, 1) if pair not in inner]
        first, rest = text[: cuts[0]], [self.parts[text[i:j]] for i, j in zip(cuts, [*cuts[1:], None])]  # noqa: B905
        return b"".join([self.words[first[1:]] if first[0] == SPACE and first.count(SPACE) == 1 < len(first) else self.parts[first], *rest])

    def _whole(self, text: str) -> bytes:
        ids = _packed(self.agenda(text))
        self.fresh.append((text, ids))
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.plain:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            if self.cut and "  " not in text and text[0] != " " and text[-1] != " ":
                return b"".join(map(self.words.__getitem__, text.split(" ")))
            text = SPACE + text.replace(" ", SPACE)
        else:
            text = self.library.normalize(text)
            if not text:
                return b""
        if self.cut is None or (not self.bytes and not self.plain):
            return _packed(self.agenda(text))
        return b"".join([self._cut_up(w) for w in self.cut.split(text)])

    def verify(self) -> None:
        """Raise unless the library encodes what was added to the memory in the same way, each stretch after a space mark."""
        if self.plain and self.fresh:
            marked = [t if t[0] == SPACE else SPACE + t for t, _ in self.fresh]
            for (t, own), w, ids in zip(self.fresh, marked, self.library.encode([w[1:].replace(SPACE, " ") for w in marked], num_threads=1), strict=True):
                if t is not w:
                    own = _packed(self.agenda(SPACE)) + own if SPACE + t[0] not in self.inner else _packed(self.agenda(w))
                if w != SPACE and own != np.array(ids, "<i4").tobytes():
                    raise RuntimeError(f"the library encodes {t!r} in another way")
        self.fresh.clear()
        self.words.turn()
        self.parts.turn()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "one-by-one")
        return text[1:] if self.prefix and text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _added(docs: DataFrame, name: str, kind: str, make) -> DataFrame:
    """docs with one more column (replacing one of that name), made batch by batch in Python."""
    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != name)
    return docs.mapInArrow(make(kept, name), f"{fields}, `{name}` {kind}")


def encode(docs: DataFrame, path: str | None = None, end: bool = True) -> DataFrame:
    """docs with `ids` (array of int): the whole text as the sentencepiece library encodes it.

    Null and empty texts have the end id only (or none). Texts of any length are taken whole, rows
    are judged one by one, so repeated rows and null ids stay as they are; other columns are
    kept, but a column named ids is replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def make(kept: list[str], name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(path)
            tail = np.array([own.end] if end else [], "<i4").tobytes()
            for batch in slices(batches, "text", SLICE_BYTES):
                found = [own.encode(t) + tail for t in texts_of(batch)]
                own.verify()
                offsets = np.cumsum([0, *[len(f) // 4 for f in found]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4").astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], names=[*kept, name])

        return run

    return _added(docs, "ids", "array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with `decoded`: the text of each row's `ids`, as the library's decode gives it (null ids: empty)."""
    small_batches(encoded.sparkSession)
    path = path or default_path()

    def make(kept: list[str], name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(path)
            for batch in batches:
                ids = [i or [] for i in batch.column("ids").to_pylist()]
                texts = [own.decode(i) for i in ids]
                if texts != own.library.decode(ids, num_threads=1):
                    raise RuntimeError("the library decodes in another way")
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, name])

        return run

    return _added(encoded, "decoded", "string", make)
