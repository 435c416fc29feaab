"""Whole batches of texts as one byte array: word bounds, 64-bit hashes and token ids without a Python loop over words.

A batch is bounded by Arrow's batch size, so is the memory. Words are runs of bytes outside ``\\x20`` and
``\\x09-\\x0D``; multi-byte characters never hold such bytes, so UTF-8 bytes can be cut there.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

# Odd 64-bit constants: multipliers of the positional hash and of the mixer (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MARKS = np.zeros(256, bool)
MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True

LETTERS = np.zeros(256, bool)
LETTERS[[b for b in range(128) if chr(b).isalpha()]] = True

# Distinct words whose ids a worker keeps; beyond it the memory is emptied, so it never grows with the input.
KEPT_WORDS = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values: near values end far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0..n-1, kept for the next batch."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _POWERS[i] = np.ones(size, np.uint64)
            np.multiply.accumulate(np.full(size - 1, base, np.uint64), out=_POWERS[i][1:])
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts, size: int = 1_000_000):
    """Slices (first row, texts) of about ``size`` characters, at least one text each."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t is not None else 0
        if total >= size:
            yield first, texts[first:i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


class Texts:
    """The bytes of many texts end to end, a newline after each, and where each begins and ends."""

    def __init__(self, texts, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        self.n = len(raw)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if self.n else np.zeros(0, np.int64)
        self.ends = self.starts + sizes
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.data = LOWER[data] if lower else data

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word, in order."""
        inside = ~SPACES[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        return edge[::2], edge[1::2]

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Row of the text each position lies in."""
        return np.searchsorted(self.starts, starts, "right") - 1

    def sums(self) -> np.ndarray:
        """Prefix sums of byte codes times powers, with a zero in front."""
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum(BYTE_CODE[self.data] * powers(len(self.data))[0], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range: equal bytes, equal hash, wherever they stand."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        if not hasattr(self, "prefix"):
            self.prefix = self.sums()
        total = (self.prefix[ends] - self.prefix[starts]) * powers(len(self.data))[1][starts]
        return mix(total + (ends - starts).astype(np.uint64) * MIX_B)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges (start, size), one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


class Encoder:
    """Token ids of whole batches by a public tokenizer file; each distinct piece is encoded once a worker.

    ``spaced`` tells where a text may be cut without changing its ids. True: before a space that no white
    space precedes or that a visible character follows, as for byte-level vocabularies whose pieces take the
    space before them. False: around every run of white space, for vocabularies that drop it.

    The strings of special tokens in a text have the special ids, as the library gives them by default; a text that holds one is
    encoded whole. ``plain`` makes them ordinary text.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [] if plain else [t.content for t in added if t.special]
        self.spaced = spaced
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # How the vocabulary spells Latin letters and the space: the model can then be asked directly.
        self.spelling = {c: split(chr(c))[0][0] for c in range(256) if chr(c).isalpha()} | {32: split(" x")[0][0][0]}
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces and merge them into the sorted table of known ones."""
        if len(self.known) + len(keys) > KEPT_WORDS:
            self.forget()
        found: list = [None] * len(pieces)
        tokenize, spelling, other = self.tokenizer.model.tokenize, self.spelling, []
        for i, piece in enumerate(pieces):
            word = piece[1:] if self.spaced and piece[0] == " " else piece
            if word.isalpha() and (word.isascii() or max(word) < "\u0100"):
                found[i] = [t.id for t in tokenize((piece if self.spaced else piece.lower()).translate(spelling))]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)):
            found[i] = e.ids
        size = np.fromiter((len(f) for f in found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(known := np.concatenate((self.known, keys)), kind="stable")
        self.known = known[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, ids))

    def pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        d = texts.data
        before, before2 = np.roll(d, 1), np.roll(d, 2)
        # Between a Latin letter and ASCII punctuation other than the apostrophe both vocabularies cut.
        letter = LETTERS[before] | ((before2 == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        mark = letter & MARKS[d]
        if not self.spaced:
            inside = ~SPACES[d]
            inside_before = np.concatenate(([False], inside[:-1]))
            starts = np.flatnonzero(inside & (~inside_before | mark))
            stops = np.flatnonzero(~inside)
            ends = np.minimum(np.append(starts[1:], len(d)), stops[np.searchsorted(stops, starts)]) if len(starts) else starts
            return starts, ends
        after = np.roll(d, -1)
        # A visible character: ASCII outside white space, or a two-byte one other than those led by C2.
        ends_visible = (~SPACES[before] & (before < 0x80)) | ((before >= 0x80) & (before2 > 0xC2) & (before2 < 0xE0))
        starts_visible = ~SPACES[after] & ((after < 0x80) | ((after > 0xC2) & (after < 0xE0)))
        cut = mark | ((d == 0x20) & (ends_visible | starts_visible))
        full = texts.ends > texts.starts
        cut[texts.starts[full]] = True
        cut[texts.ends] = False
        starts = np.flatnonzero(cut)
        limit = texts.ends[texts.owner(starts)]
        ends = np.minimum(np.concatenate((starts[1:], [len(d)]))[: len(starts)], limit)
        return starts, ends

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        parts = [self.encode_chunk(part) for _, part in chunks(texts)]
        if len(parts) == 1:
            return parts[0]
        return (np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)]),
                np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]))

    def whole(self, texts, batch: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces, but each text that holds the string of a special token as one piece."""
        held = np.array([t is not None and any(s in t for s in self.specials) for t in texts], bool)
        if not held.any():
            return starts, ends
        cut = ~held[batch.owner(starts)]
        starts, ends = np.concatenate((starts[cut], batch.starts[held])), np.concatenate((ends[cut], batch.ends[held]))
        order = np.argsort(starts)
        return starts[order], ends[order]

    def encode_chunk(self, texts) -> tuple[np.ndarray, np.ndarray]:
        batch = Texts(texts)
        starts, ends = self.whole(texts, batch, *self.pieces(batch))
        keys = batch.hashes(starts, ends)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, unique)
        missing = np.ones(len(unique), bool)
        inside = spot < len(self.known)
        missing[inside] = self.known[spot[inside]] != unique[inside]
        if missing.any():
            if len(self.known) + int(missing.sum()) > KEPT_WORDS:
                missing[:] = True
            raw = batch.data.tobytes()
            new = first[missing]
            self.learn(unique[missing], [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[new], ends[new])])
            spot = np.searchsorted(self.known, unique)
        size = self.size[spot][which]
        ids = self.ids[spread(self.at[spot][which], size)]
        counts = np.bincount(batch.owner(starts), weights=size, minlength=batch.n).astype(np.int64)
        return ids, counts


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker process and file."""
    return Encoder(path, spaced)


def token_slices(batches, path: str, spaced: bool, end_id: int, rows: int = 1000):
    """(doc_ids, ids, counts) of a few documents at a time from Arrow batches (doc_id, text); null text is empty.

    Every document's ids end with ``end_id``; ``counts`` includes it.
    """
    encode = encoder(path, spaced).encode
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            ids, counts = encode(part.column(1).to_pylist())
            counts = counts + 1
            last = np.cumsum(counts) - 1
            whole = np.full(len(ids) + len(counts), end_id, np.uint32)
            inner = np.ones(len(whole), bool)
            inner[last] = False
            whole[inner] = ids
            yield part.column(0).to_pylist(), whole, counts
