"""Word shingles of whole Arrow batches as 64-bit hashes.

Words are runs of characters other than white space, in lower case. A batch is split and lowered by Arrow; every
distinct word is hashed once, and the hashes of neighbouring words are folded into one hash per shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = lists.flatten()
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    coded = pc.dictionary_encode(words)
    known = [w.encode() for w in coded.dictionary.to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    index = coded.indices.to_numpy(zero_copy_only=False)
    full = np.array([bool(w) for w in known])[index]  # the split leaves empty words at the ends of a text
    begins = np.concatenate([[0], np.cumsum(full)])[offsets]
    return hashes[index][full], begins.astype(np.int64)


def shingle_hashes(
    words: np.ndarray, begins: np.ndarray, width: int = WIDTH, short: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and the row of the text of each.

    A text of fewer than `width` words has one shingle of all its words if `short`, else none.
    """
    sizes = np.diff(begins)
    folded = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        folded = mix((folded + _GOLDEN) ^ words[j:j + len(folded)])
    rows = np.repeat(np.arange(len(sizes)), np.maximum(sizes - width + 1, 0))
    # the i-th shingle of a text begins at its i-th word
    counts = np.maximum(sizes - width + 1, 0)
    first = np.repeat(begins[:-1] - (np.cumsum(counts) - counts), counts)
    out = folded[first + np.arange(len(rows))] if len(rows) else np.empty(0, np.uint64)
    if short:
        few = np.flatnonzero((sizes > 0) & (sizes < width))
        extra = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = sizes[few] > j
            extra[has] = mix((extra[has] + _GOLDEN) ^ words[begins[few[has]] + j])
        order = np.argsort(np.concatenate([rows, few]), kind="stable")
        out, rows = np.concatenate([out, mix(extra + np.uint64(1))])[order], np.concatenate([rows, few])[order]
    return out, rows
