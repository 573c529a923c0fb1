"""Vectorised word splitting and hashing over whole Arrow batches of text.

Texts are read as UTF-8 bytes.  Both word patterns of this package are unions
of byte classes (every byte of a non-ASCII character is a word byte in both),
so splitting bytes gives exactly the words that the patterns give on code
points.  A word's 64-bit hash is a polynomial over random byte codes, finished
with a mixing step; equal words have equal hashes on every worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that the 8-byte columns beside it stay small.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words of `[^\x20\x09-\x0D]+`.
SPACED = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = _byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


@dataclass
class Words:
    """Words of some texts, in order: byte spans, hashes, and where each text's begin."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64 of each word
    offsets: np.ndarray  # text t has words offsets[t] to offsets[t + 1]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)


def marked(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether each byte is of the byte class; kind[data], without making each byte an index."""
    return np.frombuffer(data.tobytes().translate(kind.tobytes()), bool)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    # a null's place may hold bytes, though Spark's doesn't; only then are the others copied
    if texts.null_count and np.diff(off)[texts.is_null().to_numpy(zero_copy_only=False)].any():
        return text_bytes(texts.fill_null(""))
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, (off - off[0]) if len(off) else np.zeros(1, np.int64)


def split_words(data: np.ndarray, text_offsets: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    """Split the texts' bytes into words of the byte class `kind` and hash them.

    Bytes are worked on in pieces of about CHUNK_BYTES that end between words,
    so that a very long text costs no more beside its words than a piece does.
    """
    if lower:
        data = _LOWER[data]
    found, at = [], 0
    while at < len(data):
        end = _end_between_words(data, at + CHUNK_BYTES, kind)
        first, last = np.searchsorted(text_offsets, (at, end))
        start, after, hashed = _split(data[at:end], text_offsets[first:last] - at, kind)
        found.append((start + at, after + at, hashed))
        at = end
    start, after, hashed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
    return Words(data, start, after, hashed, np.searchsorted(start, text_offsets).astype(np.int64))


def _end_between_words(data: np.ndarray, least: int, kind: np.ndarray) -> int:
    """The first place from `least` on that no word runs over, or the end."""
    while least < len(data):
        gap = np.flatnonzero(~kind[data[least : least + 4096]])
        if len(gap):
            return least + int(gap[0])
        least += 4096
    return len(data)


def word_spans(data: np.ndarray, cuts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each word; words don't run over cuts, where texts begin."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = marked(data, kind)
    first = inside.copy()
    cut = np.zeros(n + 1, dtype=bool)
    cut[cuts] = True
    first[1:] &= ~inside[:-1] | cut[1:]
    return np.flatnonzero(first[:n]), np.flatnonzero(inside[:n] & (~inside[1:] | cut[1:])) + 1


def pieces(data: np.ndarray, text_offsets: np.ndarray, kind: np.ndarray, lower: bool, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about `size` bytes that end between words, of texts short and long: bytes, each word's first byte and the byte after it, and the text it is in."""
    any_case = kind[_LOWER] if lower else kind
    at = 0
    while at < len(data):
        end = _end_between_words(data, at + size, any_case)
        here = _LOWER[data[at:end]] if lower else data[at:end]
        first, last = np.searchsorted(text_offsets, (at, end))
        start, after = word_spans(here, text_offsets[first:last] - at, kind)
        yield here, start, after, np.searchsorted(text_offsets, start + at, side="right") - 1
        at = end


def _split(data: np.ndarray, cuts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and hash of each word; words don't run over cuts, where texts begin."""
    n = len(data)
    start, end = word_spans(data, cuts, kind)
    power = np.empty(n + 1, dtype=_U)
    power[0] = 1
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_CODES[data] * power[:n], out=total[1:])
    # (a * B^start) / B^start, so that a word hashes alike wherever it stands
    inverse = np.empty(n + 1, dtype=_U)
    inverse[0] = 1
    inverse[1:] = _BASE_INVERSE
    np.multiply.accumulate(inverse, out=inverse)
    return start, end, mix64((total[end] - total[start]) * inverse[start])


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first text, text after the last, bytes, offsets."""
    data, off = text_bytes(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def ngram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside a text, with the text it is in (see `shingles` for shorter texts)."""
    h, m = words.hash, len(words.hash)
    if m < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    out = np.zeros(m - n + 1, dtype=_U)
    for k in range(n):
        out = out * _U(0xFF51AFD7ED558CCD) + h[k : m - n + 1 + k]
    text = words.text_of()
    whole = text[: m - n + 1] == text[n - 1 :]
    return mix64(out[whole]), text[: m - n + 1][whole]


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as (hash, text), ordered by text and hash.

    A text of fewer than n words has its whole word sequence as one shingle; a
    text without words has none.
    """
    h, text = ngram_hashes(words, n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        extra = np.empty(len(short), dtype=_U)
        for k, t in enumerate(short):
            value = _U(0)
            with np.errstate(over="ignore"):
                for x in words.hash[words.offsets[t] : words.offsets[t + 1]]:
                    value = value * _U(0xFF51AFD7ED558CCD) + x
            extra[k] = value
        h = np.concatenate([h, mix64(extra ^ _U(0xA5A5A5A5A5A5A5A5))])
        text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
    return h, text
