"""SentencePiece encoding and decoding with offsets into the original bytes.

The model file is read directly: its normaliser's compiled character map (a double-array trie and its replacement
strings) is walked by longest prefix, each replaced prefix recording the original bytes that it stands for. The
normalised text is cut into units that no merge of the vocabulary can cross (before a space sign, around characters
that are in no longer piece), and each unit is merged by score, best first and leftmost first. Units repeat, so their
pieces are remembered, in bounded number; new ones are merged many at once. Every piece is projected to a span of
original bytes through the recorded alignment, or through that of the space signs where the map leaves a text alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format (fixed values)
REMEMBERED = 600_000
#: Characters of units that are merged many at once, in tables of these widths; longer ones take a heap each.
WIDTHS = (8, 16, 32, 64)
#: Numbers from here on stand for characters that are no pieces, by their code point.
ALIEN = 1 << 21
NONE = 1 << 40


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """A compiled character map: trie units of 32 bits, then replacement strings that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]
        self.first = bytes(b for b in range(256) if self.longest_begins(b))

    def longest_begins(self, byte: int) -> bool:
        """Whether a mapped prefix begins with a byte."""
        if not self.units:
            return False
        place = self._offset(self.units[0]) ^ byte
        return place < len(self.units) and self.units[place] & 0x800000FF == byte

    def untouched(self, data: bytes) -> bool:
        """Whether no mapped prefix can begin anywhere in a text."""
        return not self.first or len(data.translate(None, self.first)) == len(data)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix at a place; None if none is mapped."""
        if not self.units:
            return None
        units, found = self.units, None
        place = self._offset(units[0])
        for k in range(at, len(text)):
            place ^= text[k]
            if place >= len(units) or units[place] & 0x800000FF != text[k]:
                break
            unit = units[place]
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[place] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(0, found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class PieceModel:
    """Encodes and decodes as the library does for a BPE model, with spans."""

    def __init__(self, path: str):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.pieces: list[tuple[str, int]] = []
        blob, flags, self.unk, trainer = b"", {3: 1, 4: 1, 5: 1}, 0, {}
        for number, value in fields(open(path, "rb").read()):
            if number == 1:
                part = dict(fields(value))
                piece, kind = part[1].decode(), part.get(3, NORMAL)
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    self.scores[piece] = struct.unpack("<f", part.get(2, bytes(4)))[0]
                self.ids[piece] = len(self.pieces)
                self.unk = len(self.pieces) if kind == UNKNOWN else self.unk
                self.pieces.append((piece, kind))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
                blob, flags = spec.get(2, b""), flags | {k: spec[k] for k in flags if k in spec}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or any(kind in (USER_DEFINED, UNUSED) for _, kind in self.pieces):
            raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
        self.dummy, self.squeeze, self.escape = bool(flags[3]), bool(flags[4]), bool(flags[5])
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.map = CharacterMap(blob)
        self.bytes = {int(p[1:-1], 16): i for i, (p, kind) in enumerate(self.pieces) if kind == BYTE}
        long = [p for p in self.scores if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("pieces with an inner space sign are not supported")
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in long))
        stops = "".join(c for c in ",.;:!?" if not any(re.search(rf"[^\W\d_]\{c}", p) for p in long))
        word = f"{SPACE}*[^\\W\\d_]+(?=[{stops}])|" if stops else ""  # the same word, before a stop or not, is one unit
        self.unit = re.compile(f"{word}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self._units: dict[str, bytes] = {}
        # by id: text, decimal, size in the normalised text, and whether it decodes by its text alone
        byte = {i: b for b, i in self.bytes.items()}
        self._texts = np.array([chr(byte[i]) if byte.get(i, 128) < 128 else p.replace(SPACE, " ") for i, (p, _) in enumerate(self.pieces)], object)
        self._decimals = np.array([str(i) for i in range(len(self.pieces))], object)
        # the first byte piece of a character has the character's size, the others none, so that they share its span
        self._sizes = np.array([1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0) if b < 128 or b >= 0xC0 else 0 for b in (byte.get(i, 0) for i in range(len(self.pieces)))])
        self._sizes[[i for i in range(len(self.pieces)) if i not in byte]] = [len(p.encode()) for i, (p, _) in enumerate(self.pieces) if i not in byte]
        self._alone = np.array([kind == NORMAL or byte.get(i, 128) < 128 for i, (_, kind) in enumerate(self.pieces)])
        self._letters = np.arange(ALIEN, ALIEN + 0x110000)
        for piece in self.scores:
            if len(piece) == 1:
                self._letters[ord(piece)] = self.ids[piece]
        self._merges()

    def _merges(self) -> None:
        """The pairs of pieces that make a piece, sorted, with the piece and the rank of its score (0 is the best)."""
        ranks = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = []
        for piece, score in self.scores.items():
            for cut in range(1, len(piece)):
                one, two = piece[:cut], piece[cut:]
                if one in self.scores and two in self.scores:
                    found.append((self._pair(self.ids[one], self.ids[two]), self.ids[piece], ranks[score]))
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self._pairs, self._made, self._ranks = (np.ascontiguousarray(x) for x in table.T)

    @staticmethod
    def _pair(one, two):
        return (one << 22) + two

    def _looked(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that two neighbours make; a rank of NONE if they make none."""
        key = self._pair(one, two)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._ranks[at], NONE), self._made[at]

    def normalised(self, text: str, align: bool = False) -> tuple[str, list[int] | None]:
        """The normalised text and, if asked for, the original byte offset of each of its bytes (and of the end)."""
        if not align and not self.squeeze and self.map.untouched(text.encode()):
            body = text.replace(" ", SPACE) if self.escape else text
            return (SPACE if self.escape else " ") + body if self.dummy and text else body, None
        data, out, places = text.encode(), bytearray(), []
        space, blank = (SPACE.encode() if self.escape else b" "), b" "
        parts: list[tuple[int, int, bytes]] = []  # original start and end, replacement
        at = 0
        while at < len(data):
            if found := self.map.longest(data, at):
                size, new = found
            else:
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + size]
            parts.append((at, at + size, new))
            at += size
        end = len(data)
        if self.squeeze:
            while parts and parts[0][2] == blank:
                parts.pop(0)
        if parts and self.dummy:
            out += space
            places += [parts[0][0]] * len(space)
        was = self.squeeze
        for lo, _, new in parts:
            if self.squeeze and was:
                new = new.lstrip(blank)
            for k in range(len(new)):
                add = space if new[k : k + 1] == blank else new[k : k + 1]
                out += add
                places += [lo] * len(add)
            if new:
                was = new.endswith(blank)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = places[len(out)]
                del places[len(out) :]
        return out.decode(), [*places, end]

    def _merged(self, units: list[str]) -> list[bytes]:
        """The ids of units: of each unit's neighbours the pair with the best score merges, the leftmost of equal ones,
        until no pair makes a piece. One merge of every unit is made at a time."""
        out: list[bytes] = [b""] * len(units)
        lengths = np.array([len(u) for u in units])
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            if not len(mine):
                continue
            codes = np.frombuffer("".join([units[i] for i in mine.tolist()]).encode("utf-32-le"), "<u4")
            size = lengths[mine]
            there = np.arange(width) < size[:, None]
            parts = np.full((len(mine), width), ALIEN)
            parts[there] = self._letters[codes]
            rank, made = np.full((2, len(mine), width), NONE)  # of a place and its right neighbour
            both = there[:, 1:]
            rank[:, :-1][both], made[:, :-1][both] = self._looked(parts[:, :-1][both], parts[:, 1:][both])
            open_ = np.arange(len(mine))
            while len(open_):
                best = rank[open_].argmin(1)
                go = rank[open_, best] < NONE
                open_, best = open_[go], best[go]
                new = made[open_, best]
                # the right neighbour goes: all behind it move up
                step = np.minimum(np.arange(width) + (np.arange(width) > best[:, None]), width - 1)
                for table in (parts, rank, made):
                    table[open_] = np.take_along_axis(table[open_], step, 1)
                size[open_] -= 1
                parts[open_, best] = new
                for at in (best - 1, best):
                    inside = at >= 0
                    r, i = open_[inside], at[inside]
                    ranked, makes = self._looked(parts[r, i], parts[r, np.minimum(i + 1, width - 1)])
                    rank[r, i], made[r, i] = np.where(i + 1 < size[r], ranked, NONE), makes
                rank[open_, np.minimum(size[open_] - 1, width - 1)] = NONE
            there = np.arange(width) < size[:, None]
            ids, ends = parts[there].astype("<u4"), np.cumsum(size)
            alien = ((parts >= ALIEN) & there).any(1)
            raw = ids.tobytes()
            for i, a, b, odd in zip(mine.tolist(), (ends - size).tolist(), ends.tolist(), alien.tolist(), strict=True):
                out[i] = self._bytes(ids[a:b].tolist()) if odd else raw[4 * a : 4 * b]
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[i] = self._bytes(self._merged_long(units[i]))
        return out

    def _bytes(self, parts: list[int]) -> bytes:
        """Ids, with the characters that are no pieces as byte pieces."""
        ids: list[int] = []
        for part in parts:
            ids += [part] if part < ALIEN else [self.bytes[b] for b in chr(part - ALIEN).encode()]
        return np.array(ids, "<u4").tobytes()

    def _merged_long(self, unit: str) -> list[int]:
        """The same for one unit of any length, with a heap of neighbours."""
        parts, scores = list(unit), self.scores
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-scores[x], i, x) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in scores]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (x := parts[a] + parts[b]) in scores:
                    heappush(heap, (-scores[x], a, x))
        return [self.ids[x] if x in self.scores else ALIEN + ord(x) for x in parts if x]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The library's text for ids; ``first`` says that they begin a text, whose leading space sign falls away."""
        if all(self.pieces[i][1] == NORMAL for i in ids):
            text = "".join([self.pieces[i][0] for i in ids]).replace(SPACE, " ")
            return text.removeprefix(" ") if first and (self.dummy or self.squeeze) else text
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            piece, kind = self.pieces[i] if i >= 0 else ("", CONTROL)
            if kind == BYTE:
                raw.append(int(piece[1:-1], 16))
                continue
            if raw:
                out.append(self._lenient(bytes(raw)))
                raw.clear()
            if kind == UNKNOWN:
                out.append(self.unk_surface)
            elif kind != CONTROL:
                out.append(piece.replace(SPACE, " "))
        text = "".join(out)
        return text[1:] if first and (self.dummy or self.squeeze) and text.startswith(" ") and self.pieces[ids[0]][1] not in (BYTE, UNKNOWN) else text

    @staticmethod
    def _lenient(raw: bytes) -> str:
        """UTF-8 with one replacement character for each byte that is in no valid sequence."""
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decoded(self, ids: np.ndarray) -> str:
        """``decode`` of many ids at once."""
        if not len(ids) or not self._alone[ids].all():
            return self.decode(ids.tolist()) if len(ids) else ""
        text = "".join(self._texts[ids].tolist())
        return text.removeprefix(" ") if (self.dummy or self.squeeze) and self.pieces[ids[0]][1] == NORMAL else text

    def decimals(self, ids: np.ndarray) -> str:
        """Ids as decimals between commas."""
        return ",".join(self._decimals[ids].tolist())

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: its ids, and the starts and ends of their spans of the original bytes."""
        datas = [t.encode() for t in texts]
        plain = [not self.squeeze and self.escape and self.map.untouched(d) for d in datas]
        normal = [self.normalised(t, align=not p) for t, p in zip(texts, plain, strict=True)]
        cut = [self.unit.findall(n) for n, _ in normal]
        new = set().union(*cut)
        if len(self._units) + len(new) > REMEMBERED:
            self._units.clear()
        unknown = list(new.difference(self._units))
        self._units.update(zip(unknown, self._merged(unknown), strict=True))
        out = []
        for units, data, (text, places) in zip(cut, datas, normal, strict=True):
            ids = np.frombuffer(b"".join(map(self._units.__getitem__, units)), "<u4")
            sizes = self._sizes[ids]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if len(ids) and not sizes.all():  # further bytes of a character
                starts = starts[np.maximum.accumulate(np.where(sizes > 0, np.arange(len(sizes)), 0))]
            places = self._places(len(text) > 0, data) if places is None else np.asarray(places)
            out.append((ids, places[starts], places[ends]))
        return out

    def _places(self, some: bool, data: bytes) -> np.ndarray:
        """The original offset of each byte of a text in which spaces alone became signs, and of the end; no bytes
        stand behind the sign at the front."""
        raw = np.frombuffer(data, np.uint8)
        lead = len(SPACE.encode()) if self.dummy and some else 0
        places = np.arange(len(raw)) if b" " not in data else np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        return np.concatenate([np.zeros(lead, np.int64), places, [len(raw)]])

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) per piece: spans of the original text's bytes. Byte pieces of one character share its span."""
        ((ids, starts, ends),) = self.encoded([text])
        return list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))


def portions(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about so many characters."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>, ends array<int>): pieces with the original byte spans they cover.

    Defined cases: a null or empty text has no pieces; repeated rows stay repeated; a null id stays null; an empty
    table gives an empty table; other columns play no part.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(rows, 200):
            found = [x for texts in portions(batch["text"]) for x in model(path).encoded(texts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), **{n: [x[k] for x in found] for k, n in enumerate(("ids", "starts", "ends"))}})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) per row: encoded, then decoded from the ids.

    ``spans_sha256`` is of the starts and then the ends of all pieces, as little-endian 64-bit numbers. Cases as in ``encoded``.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(rows):
            out = []
            for texts in portions(batch["text"]):
                mine = model(path)
                for ids, starts, ends in mine.encoded(texts):
                    spans = hashlib.sha256(starts.astype("<i8", copy=False).tobytes() + ends.astype("<i8", copy=False).tobytes())
                    out.append((len(ids), hashlib.sha256(mine.decimals(ids).encode()).hexdigest(), hashlib.sha256(mine.decoded(ids).encode()).hexdigest(), spans.hexdigest()))
            found = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
            found.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield found.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
