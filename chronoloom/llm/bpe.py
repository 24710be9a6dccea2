"""Byte-level BPE encoding of whole Arrow columns with the tokenizers library.

A byte-level BPE cuts a text before every run of white space that follows other characters,
and encodes the units between the cuts independently.  Natural text repeats its units, so
each distinct unit of a slice is encoded once and its ids are laid out again by numpy.  A
worker remembers the ids of units it has met, up to ``REMEMBERED`` of them.  Units are told
apart by 128 bits of hashes.  Texts with characters for which such cuts aren't plain (white
space beyond ASCII, control characters, special token strings) are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa

from .words import PLAIN, chunks, span_hash, text_buffers

GROUP_BYTES = 1 << 15
REMEMBERED = 1 << 19
_LAY_UNITS = 1 << 18
_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")


class Units:
    """The texts of a column as numbers of distinct units.

    data: the bytes; start, end: those of each distinct unit; hash, check: two hashes of it, the
    first ones ascending; unit: the units of all texts one after the other, each text's closed
    by the empty unit; per_text: how many they are; odd: the texts that can't be cut, by position.
    """

    __slots__ = ("data", "start", "end", "hash", "check", "unit", "per_text", "odd")

    def __init__(self, column: pa.Array, special: list[str] = ()):
        hashes, checks, starts, ends, per_text, self.odd = [], [], [], [], [], {}
        raw, text_at = text_buffers(column)
        base = text_at[0] if len(text_at) else 0
        wide = np.uint32 if text_at[-1] - base < 1 << 32 else np.int64
        for c in chunks(column):
            at = c.text_at
            before = np.concatenate(([0], c.end[:-1]))[: len(c.start)]
            heads = c.word_at[:-1][c.counts() > 0]
            before[heads] = at[:-1][c.counts() > 0]
            last = np.where(c.counts() > 0, c.end[np.maximum(c.word_at[1:] - 1, 0)] if len(c.end) else 0, at[:-1])
            # white space after the last word, then an empty unit for the end id
            tail = np.flatnonzero(last < at[1:])
            s = np.insert(before, c.word_at[1:][tail], last[tail])
            e = np.insert(c.end, c.word_at[1:][tail], at[1:][tail])
            n_units = c.counts() + (last < at[1:])
            closing = np.cumsum(n_units)
            s, e = np.insert(s, closing, at[1:]), np.insert(e, closing, at[1:])
            codes = c.data
            hashes.append(span_hash(codes, s, e))
            checks.append(span_hash(codes, s, e, 2))
            shift = text_at[c.first] - base
            starts.append((s + shift).astype(wide))
            ends.append((e + shift).astype(wide))
            per_text.append(n_units + 1)
            if _is_odd(c.data.tobytes().decode(), special):
                for i in range(len(c)):
                    text = c.data[at[i] : at[i + 1]].tobytes().decode()
                    if _is_odd(text, special):
                        self.odd[c.first + i] = text
        none = [np.zeros(0, np.int64)]
        self.per_text = np.concatenate(per_text or none)
        self.hash, first, unit = np.unique(np.concatenate(hashes or none).view(np.uint64), return_index=True, return_inverse=True)
        self.unit, check = unit.astype(np.uint32), np.concatenate(checks or none).view(np.uint64)
        self.check = check[first]
        unlike = np.flatnonzero(check != self.check[unit])
        for i in np.unique(np.searchsorted(np.cumsum(self.per_text), unlike, side="right")).tolist():
            self.odd[i] = column[i].as_py()
        self.start, self.end = (np.concatenate(x or none)[first].astype(np.int64) for x in (starts, ends))
        self.data = raw[base : text_at[-1]]


def _is_odd(text: str, special: list[str]) -> bool:
    return bool(_ODD.search(text)) or any(s in text for s in special)


class Encoder:
    """A byte-level BPE: ``definition`` is the JSON text of a tokenizer."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.length = np.zeros(self.size, dtype=np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units data[start:end]: one array, and where each unit's ids start and how many they are."""
        size = end - start
        plain = np.flatnonzero((size > 0) & ~PLAIN[data[np.minimum(start, len(data) - 1)]] & PLAIN[data[end - 1]])
        raw, order, parts, counts = data.tobytes(), [], [], []
        rest = np.setdiff1d(np.flatnonzero(size > 0), plain)
        groups = np.split(plain, np.flatnonzero(np.diff(np.cumsum(size[plain]) // GROUP_BYTES)) + 1) if len(plain) else []
        lines = [data[np.repeat(start[g] - (np.cumsum(size[g]) - size[g]), size[g]) + np.arange(size[g].sum())].tobytes().decode() for g in groups]
        for g, ids in zip(groups, self._whole(lines), strict=True):
            ends, wanted = np.cumsum(self.length[ids]), np.cumsum(size[g])
            cut = np.searchsorted(ends, wanted) + 1
            if ends[-1] == wanted[-1] and np.array_equal(ends[cut - 1], wanted):
                order.append(g)
                parts.append(ids)
                counts.append(np.diff(cut, prepend=0))
            else:
                rest = np.append(rest, g)
        alone = self._whole([raw[start[u] : end[u]].decode() for u in rest])
        order = np.concatenate([*order, rest]).astype(np.int64)
        length = np.zeros(len(start), dtype=np.int64)
        length[order] = np.concatenate([*counts, [len(x) for x in alone]])
        at = np.zeros(len(start), dtype=np.int64)
        at[order] = np.cumsum(length[order]) - length[order]
        return np.concatenate([*parts, *alone, np.zeros(0, np.int64)]), at, length

    def _forget(self) -> None:
        #: hashes (ascending) and checks of known units, where their ids start and how many they are
        self.known, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size_of, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _of_units(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each distinct unit where its ids start and how many they are; remembers them while there is room."""
        n = len(units.start)
        if not len(units.data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.minimum(np.searchsorted(self.known, units.hash), max(0, len(self.known) - 1))
        old = (self.known[place] == units.hash) & (self.checks[place] == units.check) if len(self.known) else np.zeros(n, bool)
        new = np.flatnonzero(~old)
        ids, at, size = self._units(units.data, units.start[new], units.end[new])
        ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        at += len(self.ids)
        all_at, all_size = np.empty(n, np.int64), np.empty(n, np.int64)
        all_at[new], all_size[new] = at, size
        all_at[old], all_size[old] = self.at[place[old]], self.size_of[place[old]]
        # units that come once are not worth it, and units that share a hash with a known one stay unknown
        fresh = new[np.bincount(units.unit, minlength=n)[new] > 1]
        fresh = fresh[self.known[place[fresh]] != units.hash[fresh]] if len(self.known) else fresh
        kept = fresh[: max(0, REMEMBERED - len(self.known))]
        if len(kept):
            order = np.argsort(np.concatenate((self.known, units.hash[kept])), kind="stable")
            lists = ((self.known, units.hash), (self.checks, units.check), (self.at, all_at), (self.size_of, all_size))
            self.known, self.checks, at, sizes = (np.concatenate((a, b[kept].astype(a.dtype)))[order] for a, b in lists)
            # what was not kept leaves
            stop = np.cumsum(sizes, dtype=np.int64)
            self.ids = ids[np.repeat(at.astype(np.int64) - (stop - sizes), sizes) + np.arange(stop[-1])]
            self.at, self.size_of = (stop - sizes).astype(np.uint32), sizes
        return ids, all_at, all_size

    def count(self, units: Units) -> np.ndarray:
        """How many ids each text has, without an end id."""
        _, _, size = self._of_units(units)
        total = np.concatenate(([0], np.cumsum(size[units.unit])))
        counts = np.diff(total[np.concatenate(([0], np.cumsum(units.per_text)))])
        for i, ids in zip(units.odd, self._whole(list(units.odd.values())), strict=True):
            counts[i] = len(ids)
        return counts

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id after it, and the offset of each text's ids."""
        units = Units(column, self.special)
        start, end, unit, per_doc, odd = units.start, units.end, units.unit, units.per_text, units.odd
        if not len(per_doc):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids, at, size = self._of_units(units)
        del units
        closing = np.flatnonzero(start == end)  # one distinct unit: the empty one
        ids = np.append(ids, end_id)
        at[closing], size[closing] = len(ids) - 1, 1
        out_at = np.zeros(len(unit) + 1, dtype=np.int64)
        np.cumsum(size[unit], out=out_at[1:])
        out, ids = np.empty(out_at[-1], dtype=np.uint32), ids.astype(np.uint32)
        for lo in range(0, len(unit), _LAY_UNITS):
            part = unit[lo : lo + _LAY_UNITS]
            to = out_at[lo : lo + len(part) + 1]
            out[to[0] : to[-1]] = ids[np.repeat(at[part] - to[:-1], size[part]) + np.arange(to[0], to[-1])]
        doc_at = out_at[np.concatenate(([0], np.cumsum(per_doc)))]
        if odd:
            parts = [out[doc_at[i] : doc_at[i + 1]] for i in range(len(per_doc))]
            for i, ids in zip(odd, self._whole(list(odd.values())), strict=True):
                parts[i] = np.append(ids, end_id)
            out = np.concatenate(parts)
            doc_at = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return out, doc_at


class RankEncoder(Encoder):
    """A byte-level BPE of the tiktoken library: ``definition`` is the text of a file of ranks, ``pattern`` how it cuts texts."""

    def __init__(self, definition: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in definition.splitlines() if line)}
        self.tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.length = np.zeros(self.size, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.special = []
        self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode_ordinary(t), dtype=np.int64) for t in texts]


_encoders: dict[int, Encoder] = {}


def encoder(definition: str, pattern: str | None = None) -> Encoder:
    """One encoder of each kind a worker process; with a pattern, definition is a file of ranks."""
    key = hash((definition, pattern))
    if key not in _encoders:
        if len(_encoders) > 3:
            _encoders.clear()
        _encoders[key] = Encoder(definition) if pattern is None else RankEncoder(definition, pattern)
    return _encoders[key]
