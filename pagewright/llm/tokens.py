"""Token ids of whole texts by the tokenizers library as it stands (strings of its special tokens in a text are those
tokens), with a bounded memory of pieces.

Both tokenizers in use cut a text before they merge, and no merge crosses the places where `cuts` cuts. So a text's ids
are the ids of its pieces, one after the other, and a piece that has been encoded before need not be encoded again.
Places are found in UTF-8, for a group of texts at once; Arrow numbers the group's distinct pieces, and only those are
looked up or go to the library, in lines of many; texts that hold a special token's string go to it whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold

_LINE = 100
#: Bytes of UTF-8 that are cut at once: little is held besides the ids.
_GROUP = 4 << 20


def _classes() -> np.ndarray:
    """Class of each byte: 0 may be white space or begin it, 1 letter, 2 digit, 3 other ASCII that prints, 4 apostrophe,
    5 blank, 6 tab or line break, 7 begins or is another character, 8 goes on in one."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = 3
    out[ord("0") : ord("9") + 1] = 2
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = 1
    out[ord("'")], out[ord(" ")], out[[9, 10, 13]] = 4, 5, 6
    out[:9] = out[0x0E:0x1C] = out[0x7F] = 7
    out[0x80:0xC0], out[0xC0:] = 8, 7
    out[[0xC2, 0xE1, 0xE2, 0xE3]] = 0
    return out


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """For 16 * class + class of the next byte: whether to cut between the two, and whether to cut before the first."""
    between, before = np.zeros((16, 16), bool), np.zeros((16, 16), bool)
    between[1:5, 5:7] = True  # what prints, white space
    between[1:3, 3:5] = between[1, 2] = between[2, 1] = True  # letters, digits, others, but an apostrophe may begin 's
    between[3, 1:3] = between[4, 2] = True
    between[6, [1, 2, 3, 4, 7]] = True  # white space of one character; a blank goes to what follows it
    before[5:7, [1, 2, 3, 4, 7]] = True  # the last of a run of white space
    return between.ravel(), before.ravel()


_CLASS = _classes()
_BETWEEN, _BEFORE = _pairs()
_NONE = np.zeros(0, np.int64)


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes, ascending, at which pieces begin, as no token goes on there: where texts begin, before white
    space that follows what prints, before the last of a run of white space and, if that is no blank, after it, between
    kinds of ASCII, and after a letter.

    ends: where the first text begins and each ends; none is cut by what follows in another.
    """
    kind = _CLASS[data]
    pair = (kind[:-1] << 4) | kind[1:]
    here, before = np.zeros(len(data), bool), _BEFORE[pair]
    inner = ends[(ends > 0) & (ends < len(data))] - 1
    before[inner] = False
    here[1:] = _BETWEEN[pair]
    here[:-1] |= before
    # White space before a character that might be white space itself: this looks at the whole character.
    some = np.flatnonzero((kind[:-1] >= 5) & (kind[:-1] <= 6) & (data[1:] >= 0xC2) & (kind[1:] == 0))
    if len(some):
        some = np.setdiff1d(some, inner, assume_unique=True)
        lead, second, third = (data[np.minimum(some + k, len(data) - 1)] for k in (1, 2, 3))
        plain = (lead == 0xC2) & (second != 0x85) & (second != 0xA0)
        plain |= (lead == 0xE1) & (second != 0x9A) & (second != 0xA0)
        plain |= (lead == 0xE2) & ((second > 0x81) | ((second == 0x80) & (third >= 0x90) & (third <= 0xA7)))
        plain |= (lead == 0xE3) & ((second != 0x80) | (third != 0x80))
        some = some[plain]
        here[some] = True
        here[some[kind[some] == 6] + 1] = True
    # ASCII digits and others after letters of two or three bytes (without U+0130, which isn't lower-cased to one letter).
    some = np.flatnonzero((kind[:-1] == 8) & (kind[1:] >= 2) & (kind[1:] <= 4)) + 1
    if len(some):
        last, second, third = data[some - 1], data[some - 2], data[some - 3]
        letter = (second == 0xC3) & (last != 0x97) & (last != 0xB7)
        letter |= ((second == 0xC4) & (last != 0xB0)) | ((second >= 0xC5) & (second <= 0xC8)) | (second == 0xD0)
        wide = second < 0xC0
        letter |= wide & (((third >= 0xE5) & (third <= 0xE8)) | ((third == 0xE4) & (second >= 0xB8)) | ((third == 0xE9) & (second < 0xBE)))
        here[some[letter]] = True
    here[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(here)


def _ragged(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[f : f + k] for each f of first and k of n, one after the other."""
    ends = np.cumsum(n)
    return values[np.repeat(first - ends + n, n) + np.arange(ends[-1])] if len(n) else values[:0]


class PieceEncoder:
    """ids(texts) -> for each text its ids as little-endian unsigned 32-bit integers, in bytes.

    path: a tokenizer file. separator: text of one id that marks where one piece of a line ends; pieces that
    hold it are encoded one by one. memory: pieces kept at most, besides those of one group of texts; of more, the half
    that was used last stays.
    """

    def __init__(self, path: str, separator: str, memory: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator, self.memory = separator, memory
        self.mark = self._ids(separator)
        #: Number of each piece known; its ids are values[first : first + n].
        self.known: dict[str, int] = {}
        self.values, self.first, self.n, self.used = np.zeros(0, "<u4"), _NONE, _NONE, _NONE
        self.groups = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _alone(self, pieces: list[str]) -> list[int]:
        """Places of pieces that can't go into lines: with white space that isn't one blank at their start, with the
        separator, or that don't print (blanks aside, no white space does)."""
        bare = self.separator.strip()
        bare = bare if bare.isprintable() else ""
        out: list[int] = []
        for at in range(0, len(pieces), _LINE):
            line = pieces[at : at + _LINE]
            whole = "|".join(line)
            if not whole.isprintable() or "  " in whole or " |" in whole or whole[-1] == " " or (bare and bare in whole):
                out += [i for i, p in enumerate(line, at) if not p.isprintable() or p.rfind(" ") > 0 or p == " " or (bare and bare in p)]
        return out

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        alone = self._alone(pieces) if len(self.mark) == 1 else list(range(len(pieces)))
        plain = np.ones(len(pieces), bool)
        plain[alone] = False
        which = np.flatnonzero(plain).tolist()
        lines = [which[i : i + _LINE] for i in range(0, len(which), _LINE)]
        whole = [self.separator.join([pieces[i] for i in line]) for line in lines]
        flat: list[int] = []
        for line, enc in zip(lines, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            ids = enc.ids
            if ids.count(int(self.mark[0])) == len(line) - 1:
                flat += ids
                flat.append(int(self.mark[0]))
            else:  # a piece has the mark's id itself
                alone += line
                plain[line] = False
        values = np.array(flat, dtype="<u4")
        marks = np.isin(values, self.mark)
        n, first = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        n[plain] = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        values = values[~marks]
        first[plain] = np.cumsum(n[plain]) - n[plain]
        if not alone:
            return values, n
        others = [self._ids(pieces[i]) for i in alone]
        n[alone] = [len(x) for x in others]
        first[alone] = len(values) + np.cumsum(n[alone]) - n[alone]
        return _ragged(np.concatenate([values, *others]), first, n), n

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces, learnt where they are new."""
        self.groups += 1
        found = list(map(self.known.get, pieces))
        missing = [p for p, k in zip(pieces, found, strict=True) if k is None]
        if missing:
            if len(self.known) + len(missing) > self.memory:
                self.used[[k for k in found if k is not None]] = self.groups
                self._drop()
            ids, n = self._encode(missing)
            self.known.update(zip(missing, range(len(self.n), len(self.n) + len(n)), strict=True))
            self.first = np.concatenate([self.first, len(self.values) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.values = np.concatenate([self.values, ids])
            self.used = np.concatenate([self.used, np.zeros(len(n), np.int64)])
            found = list(map(self.known.__getitem__, pieces))
        out = np.array(found, np.int64)
        self.used[out] = self.groups
        return out

    def _drop(self) -> None:
        """Keeps pieces of this group and, of the others, those used last: half of the memory in all."""
        order = np.argsort(-self.used, kind="stable")
        stay = max(self.memory // 2, int((self.used == self.groups).sum()))
        keep = np.sort(order[:stay])
        new = np.full(len(self.used), -1)
        new[keep] = np.arange(len(keep))
        self.known = {p: k for p, k in zip(self.known, new[np.fromiter(self.known.values(), np.int64, len(self.known))].tolist(), strict=True) if k >= 0}
        self.values = _ragged(self.values, self.first[keep], self.n[keep])
        self.n, self.used = self.n[keep], self.used[keep]
        self.first = np.cumsum(self.n) - self.n

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Of null texts, too: no ids."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if texts.type != pa.string():
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        out: list[bytes] = []
        for group in _groups(texts):
            out += self._some(group)
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        data, ends = _bytes(texts)
        if any(data.tobytes().find(s.encode()) >= 0 for s in self.special):
            whole = np.zeros(len(texts), bool)
            for s in self.special:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            if whole.any():
                rest = iter(self._plain(texts.filter(pa.array(~whole))))
                return [self._ids(t.as_py()).tobytes() if w else next(rest) for t, w in zip(texts, whole.tolist(), strict=True)]
        return self._plain(texts)

    def _plain(self, texts: pa.Array) -> list[bytes]:
        data, ends = _bytes(texts)
        if not len(data):
            return [b""] * len(texts)
        starts = cuts(data, ends)
        places = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = numbers[pieces.indices.to_numpy()]
        n = self.n[numbers]
        raw = _ragged(self.values, self.first[numbers], n).tobytes()
        at = (4 * np.append(0, np.cumsum(n))[np.searchsorted(starts, ends)]).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts (without nulls), and where the first begins and each ends."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _groups(texts: pa.Array, size: int = _GROUP) -> Iterator[pa.Array]:
    """Runs of texts of about `size` bytes, so that little is held besides the ids."""
    _, ends = _bytes(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + size)))
        yield texts.slice(at, stop - at)
        at = min(stop, len(texts))


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, separator: str) -> PieceEncoder:
    """One for each worker process."""
    hold("tokens", _ENCODERS.clear)
    if (path, separator) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, separator] = PieceEncoder(path, separator)
    return _ENCODERS[path, separator]
