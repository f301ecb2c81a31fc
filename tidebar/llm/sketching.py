"""Word shingles and fast similarity sketches of batches of documents, in numpy.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017). There
are t bins. In each of t rounds every element of a set is thrown into one bin, with a random
value; a bin keeps the least (round, value) it gets. A set whose bins are all full stops. Each of
t further rounds offers every element to one given bin, so that in the end every bin of every
set that isn't empty is full. Bins of two sets agree with a probability equal to their Jaccard
similarity, and the share that agrees is concentrated as for independent draws, at about
|set| + t log t steps a set in place of |set| * t.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the words of a shingle, by place.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A fixed random value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD6E8FEB86659FD93
#: Powers that a worker keeps; longer tables, for single texts above a slice, are made for the occasion.
_KEPT_POWERS = 2_000_000
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to n."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n + n // 4 + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if len(made[0]) <= _KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. All words of the
    batch are hashed at once: a word's polynomial hash is a difference of two prefix sums.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    power, inverse = _power_tables(len(data))
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    h = mix((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    return h, np.diff(np.searchsorted(start, np.cumsum(size)), prepend=0)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text: (hash, text number), sorted by text, then hash.

    A text of fewer than five words, but not none, has its whole sequence as its one shingle.
    """
    h, n = word_hashes(texts)
    begin = np.cumsum(n) - n
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(int(count.sum())) + np.repeat(begin - (ends - count), count)
    value = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(WORDS, np.uint64))
    for k in range(WORDS):
        value += padded[at + k] * _FACTORS[k]
    for i in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
        value[ends[i] - 1] = (h[begin[i] : begin[i] + n[i]] * _FACTORS[: n[i]]).sum(keepdims=True)[0] ^ _FACTORS[n[i]]
    value = mix(value)
    for a, b in zip((ends - count).tolist(), ends.tolist()):
        value[a:b].sort()
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh], doc[fresh]


def sketches(value: np.ndarray, doc: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """The (n_docs, t) fast similarity sketches of sets; rows of empty sets are all ones."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * t, empty)
    live = np.zeros(n_docs, bool)
    live[doc] = True
    for i in range(2 * t):
        if not len(doc):
            break
        draw = mix(value + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = doc * t + ((draw >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else doc * t + (i - t)
        # the round decides first: a bin filled in an earlier round stays as it is
        np.minimum.at(out, bin_, (np.uint64(i) << np.uint64(40)) | (mix(draw) >> np.uint64(24)))
        live &= (out.reshape(n_docs, t) == empty).any(axis=1)
        going = live[doc]
        value, doc = value[going], doc[going]
    return out.reshape(n_docs, t)
