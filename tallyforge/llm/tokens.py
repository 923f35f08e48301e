"""Token ids of whole texts from public vocabularies, with a bounded memory of stretches already seen.

A text is cut where no tokenizer of either kind joins characters: a stretch is a run of bytes between ASCII white space and, for
byte-level vocabularies, the space before it; white space that belongs to no word is stretches of its own. Stretches are
hashed with NumPy, found in a table by hash, and their ids gathered; only unseen ones go to the tokenizer. Equal 64-bit
hashes are taken for equal stretches.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from tallyforge.llm.shingles import BASE, BYTES, SPACE, _power_table, buffers, chunks, span_hashes, stream

#: Bytes of text worked on at once. A longer text is cut before white space.
PART = 1 << 18
#: Places for stretches in a worker's table, and ids it keeps for them; a stretch can push out another one.
PLACES, KEPT_IDS = 1 << 20, 1 << 22
PUNCTUATION = ".,:;!?|$%&*#-"
#: Letters below are composed already and have lower cases of one letter, but for U+0130.
PLAIN_LETTERS = "ƀ"
#: UTF-8 of the white space beyond ASCII, and its first bytes.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_FIRST = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Places where any text can be cut.
BETWEEN = re.compile(r"[!-~](?=[ \n])")
EXACT_BYTES = stream(3, 256)
IS_MARK = np.isin(np.arange(256), list(PUNCTUATION.encode()))
IS_PLAIN = np.isin(np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Second bytes of the letters from U+00C0 to U+00FF, all but the signs for times and divided.
IS_SECOND = (np.arange(256) >> 6 == 2) & ~np.isin(np.arange(256), [0x97, 0xB7])


class _ByteLetters(dict):
    """The letters that a byte-level vocabulary writes for the UTF-8 bytes of a character."""

    def __missing__(self, code: int) -> str:
        self[code] = found = "".join(map(_byte_letter, chr(code).encode()))
        return found


def _byte_letter(byte: int) -> str:
    """Printable bytes stand for themselves, all others, in turn, for the letters from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in printable else chr(256 + sum(b not in printable for b in range(byte)))


BYTE_LETTERS = _ByteLetters()

_encoders: dict[str, "Encoder"] = {}


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _merged(*spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of several lists in one order."""
    begin, stop = (np.concatenate(x) for x in zip(*spans))
    order = np.argsort(begin, kind="stable")
    return begin[order], stop[order]


class Encoder:
    """Ids of texts, as the tokenizer gives for the whole text without special tokens. Their strings are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        #: Words lower their letters and drop white space; otherwise a space belongs to the word behind it.
        self.lowers = json.loads(self.tokenizer.to_str())["normalizer"] is not None
        self.table = BYTES if self.lowers else EXACT_BYTES
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(PLACES, np.uint64)
        self.at = np.zeros(PLACES, np.int32)
        self.size = np.zeros(PLACES, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _keep(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.empty(self.used + len(ids), np.uint16)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _word(self, word: str) -> bytes:
        """Ids of letters that lower case and composition leave one to one, straight from the merge model."""
        word = word.lower() if self.lowers else word
        return array("H", [t.id for t in self.tokenizer.model.tokenize(word.translate(BYTE_LETTERS))]).tobytes()

    def _learn(self, stretches: list[str]) -> list[bytes]:
        """Ids of distinct stretches. Trailing punctuation is encoded apart from a word of letters, as the tokenizer does."""
        known: dict[str, bytes] = {}
        hard, joined = set(), []
        for s in stretches:
            core = s.rstrip(PUNCTUATION)
            letters = core[1:] if core[:1] == " " else core
            if not letters.isalpha() or max(letters) >= PLAIN_LETTERS or "İ" in letters:
                hard.add(s)
                continue
            if core not in known:
                known[core] = self._word(core)
            if core != s:
                rest = s[len(core):]
                if rest not in known:
                    hard.add(rest)
                joined.append((s, core, rest))
        order = [s for s in hard if s not in known]
        for s, found in zip(order, self.tokenizer.encode_batch_fast(order, add_special_tokens=False)):
            known[s] = array("H", found.ids).tobytes()
        for s, core, rest in joined:
            known[s] = known[core] + known[rest]
        return [known[s] for s in stretches]

    def _spans(self, octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretches of all texts begin and end, in order. A mark behind a letter or digit at the end is one of its own."""
        space = SPACE[octets]
        starts, stops = ~space, ~space
        edge = offsets[(offsets > 0) & (offsets < len(octets))]
        inside = starts.copy()
        starts[1:] &= space[:-1]
        stops[:-1] &= space[1:]
        starts[edge] = inside[edge]
        stops[edge - 1] = inside[edge - 1]
        begin, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        last = octets[stop - 1]
        back, further = octets[np.maximum(stop - 2, 0)], octets[np.maximum(stop - 3, 0)]
        size = stop - begin
        marked = IS_MARK[last] & (((size > 1) & IS_PLAIN[back]) | ((size > 2) & IS_SECOND[back] & (further == 0xC3)))
        mark = stop[marked] - 1
        if self.lowers:
            return _merged((begin, stop - marked), (mark, mark + 1))
        first = np.searchsorted(begin, offsets)
        held = np.flatnonzero(np.diff(first))
        before = np.empty(len(begin), np.int64)
        before[1:] = stop[:-1]
        before[first[held]] = offsets[held]
        gap = begin > before
        lead = gap & (octets[begin - 1] == 32)
        alone, more = np.flatnonzero(gap & ~lead), np.flatnonzero(begin > before + 1)
        tail = offsets[:-1].copy()
        tail[held] = stop[first[held + 1] - 1]
        rest = np.flatnonzero(offsets[1:] > tail)
        return _merged((begin - lead, stop - marked), (mark, mark + 1), (begin[alone] - 1, begin[alone]),
                       (before[more], begin[more] - 1), (tail[rest], offsets[1:][rest]))

    def _encode(self, octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, stop = self._spans(octets, offsets)
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(self.table[octets] * _power_table(BASE, len(octets) + 1)[:len(octets)], out=sums[1:])
        hashes = span_hashes(begin, stop, sums)
        place = (hashes & np.uint64(PLACES - 1)).astype(np.int64)
        at, size = self.at[place].astype(np.int64), self.size[place].astype(np.int64)
        missing = np.flatnonzero(self.keys[place] != hashes)
        if len(missing):
            fresh, shown, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            shown = missing[shown]
            raw = octets.tobytes()
            found = self._learn([raw[a:b].decode(errors="replace") for a, b in zip(begin[shown].tolist(), stop[shown].tolist())])
            sizes = np.array([len(x) // 2 for x in found], np.int64)
            ends = self.used + np.cumsum(sizes)
            self._keep(np.frombuffer(b"".join(found), np.uint16))
            at[missing], size[missing] = (ends - sizes)[which], sizes[which]
            put = (fresh & np.uint64(PLACES - 1)).astype(np.int64)
            self.keys[put], self.at[put], self.size[put] = fresh, ends - sizes, sizes
        ids = self.ids[_ragged(at, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        if self.used > KEPT_IDS:
            self._forget()
        return ids, ends[np.searchsorted(begin, offsets)]

    def _whole(self, text: bytes) -> np.ndarray:
        """Ids of a text with white space that stretches do not know, from the tokenizer itself."""
        text, at, parts = text.decode(errors="replace"), 0, []
        while at < len(text):
            cut = BETWEEN.search(text, at + PART)
            stop = cut.end() if cut else len(text)
            parts.append(array("H", self.tokenizer.encode(text[at:stop], add_special_tokens=False).ids))
            at = stop
        return np.concatenate([np.frombuffer(p, np.uint16) for p in parts])

    def encode(self, octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a buffer as 16-bit integers, and where each text's begin (one more entry than texts)."""
        parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for at, stop in chunks(offsets, PART):
            octet, edges = octets[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
            if not self.lowers and WIDE_FIRST[octet].any():
                wide = {int(np.searchsorted(edges, m.start(), side="right")) - 1 for m in WIDE_SPACE.finditer(octet.tobytes())}
            else:
                wide = set()
            if wide:
                for j in range(stop - at):
                    text = octet[edges[j]:edges[j + 1]]
                    parts.append(self._whole(text.tobytes()) if j in wide else self._encode(text, np.array([0, len(text)]))[0])
                    sizes[at + j] = len(parts[-1])
            elif stop == at + 1 and len(octet) > 2 * PART:
                place = 0
                while place < len(octet):
                    cut = _next_gap(octet, place + PART)
                    parts.append(self._encode(octet[place:cut], np.array([0, cut - place]))[0])
                    sizes[at] += len(parts[-1])
                    place = cut
            else:
                ids, ends = self._encode(octet, edges)
                parts.append(ids)
                sizes[at:stop] = np.diff(ends)
        return np.concatenate([np.zeros(0, np.uint16), *parts]), np.concatenate([[0], np.cumsum(sizes)])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column; a null is empty."""
        return self.encode(*buffers(column))


def _next_gap(octets: np.ndarray, at: int) -> int:
    """The first place from ``at`` where white space follows something else, or the end."""
    while at < len(octets):
        part = SPACE[octets[at - 1:at + 4096]]
        found = np.flatnonzero(part[1:] & ~part[:-1])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(octets)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, ends: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one more behind every text."""
    ends = ends + np.arange(len(ends))
    out = np.full(len(ids) + len(ends) - 1, last, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[ends[1:] - 1] = False
    out[inner] = ids
    return out, ends


def as_binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each range of ids."""
    offsets = pa.py_buffer((ends * ids.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(ids)])
