"""Encoding of a corpus with a byte-level BPE vocabulary.

Method: batched numpy merge rounds.  The distinct words of a batch lie in one
flat symbol array; each round looks up all neighbouring pairs by binary search
in the sorted pair keys, finds the lowest rank of every word by a segmented
minimum and merges there.  All occurrences merge in one round, except for the
few tokens whose merge may enable a lower-ranked one, which merge leftmost first.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyframe.util import widened

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the word pattern of the public vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 200_000
SHIFT = 20
_NONE = np.iinfo(np.int64).max


class ByteBpe:
    """A byte-level BPE vocabulary given as ranks, with vectorised encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN):
        import regex

        self.words = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << SHIFT) | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        early = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for part in (self.keys >> SHIFT, self.keys & ((1 << SHIFT) - 1)):
            early[part[self.made < part]] = True
        self.leftmost_only = early
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str = WORD_PATTERN) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(t): int(r) for t, r in pairs}, pattern)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (no pattern applied)."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            first = np.append(True, owner[1:] != owner[:-1])
            key = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & ~first[1:], self.made[at], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(first)
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                bounds = np.append(starts, len(symbols))
                for w in np.flatnonzero(done):
                    out[owner[starts[w]]] = symbols[bounds[w] : bounds[w + 1]]
                live = ~np.repeat(done, np.diff(bounds))
                symbols, owner, rank, first = symbols[live], owner[live], rank[live], first[live]
                low = low[~done]
                if not len(symbols):
                    break
            segment = np.cumsum(first) - 1
            hit = rank == low[segment]
            where = np.flatnonzero(hit)
            one = self.leftmost_only[low[segment[where]]]
            if one.any():
                repeat = np.append(False, segment[where][1:] == segment[where][:-1])
                where = where[~(one & repeat)]
            # overlapping hits (a a a): take every second one of a run, from its left end
            run = np.append(True, np.diff(where) != 1)
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[nth % 2 == 0]
            symbols[where] = rank[where]
            keep = np.ones(len(symbols), dtype=bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts; null and empty texts have no ids."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        place: dict[str, int] = {}
        split = [self.words(t) if t else [] for t in texts]
        codes = np.fromiter((place.setdefault(w, len(place)) for s in split for w in s), np.int64)
        unseen = [w for w in place if w not in self.cache]
        self.cache.update(zip(unseen, self.merge([w.encode() for w in unseen]), strict=True))
        ids = [self.cache[w] for w in place]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        begins = np.cumsum(sizes) - sizes
        body = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        take = sizes[codes]
        skip = np.cumsum(take) - take
        flat = body[np.repeat(begins[codes] - skip, take) + np.arange(take.sum())]
        ends = np.append(0, np.cumsum([len(s) for s in split])).astype(np.int64)
        offsets = np.append(0, np.cumsum(take))[ends]
        return offsets, flat


_LOADED: dict[str, ByteBpe] = {}


def encode_corpus(
    documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token ids of every document, without special tokens: (key, ids array<int>).

    The strings of special tokens in a text are ordinary text.  Null and empty
    texts give an empty list; a blank text gives the ids of its blanks.  Texts
    are encoded whole, whatever their length.  Rows with a null or repeated key
    are encoded like others; other columns are ignored.  ``folder`` must hold
    ``<vocabulary>.tiktoken`` on every executor.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _LOADED.get(path) or _LOADED.setdefault(path, ByteBpe.from_file(path))
        for batch in batches:
            offsets, flat = bpe.encode_batch(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    slim = widened(documents.select(key, text))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, ids array<int>")
