"""Segmentation lattices of many distinct words at once, over a trie of their prefixes.

Words are sorted, so equal prefixes are neighbours and a node of the trie is the first word that has its
prefix. Level by level, every node meets the vocabulary pieces that end there; what is summed or maximised
over them is worked out once a node, however many words share it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernel as K

U64 = np.uint64
LONG = 64  # longer words go through the scalar form
GROUP = 40_000
MARK = "▁"
_B = 0xC2B2AE3D27D4EB4F | 1
_UP = np.concatenate((np.ones(1, U64), np.cumprod(np.full(LONG + 1, _B, U64), dtype=U64)))
_DOWN = np.concatenate((np.ones(1, U64), np.cumprod(np.full(LONG + 1, pow(_B, -1, 1 << 64), U64), dtype=U64)))


def codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class Vocabulary:
    """Pieces in rank order; only what ``pieces`` lists can be part of a segmentation."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.longest = max((len(p) for p in pieces), default=1)
        h = self._hash(pieces)
        order = np.argsort(h, kind="stable")
        self.hash, self.order = h[order], order.astype(np.int32)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(h >> U64(20)).astype(np.int64) & (1 << 20) - 1] = True

    @staticmethod
    def _hash(pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), U64)
        size = np.array([len(p) for p in pieces])
        c = K.mix(codes(pieces).astype(U64) + U64(1))
        at = np.cumsum(size) - size
        for k in range(int(size.max()) if len(size) else 0):
            ok = size > k
            out[ok] += c[at[ok] + k] * _UP[min(k, LONG)]
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of hits, piece ids)."""
        maybe = np.flatnonzero(self.filter[(h >> U64(20)).astype(np.int64) & (1 << 20) - 1])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        ok = self.hash[at] == h[maybe]
        return maybe[ok], self.order[at[ok]]


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece vocabulary file, in rank order; no control or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Levels:
    """The trie of a group of distinct words of at most LONG characters, each with the word mark in front."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.order = sorted(range(len(words)), key=words.__getitem__)
        sorted_words = [words[i] for i in self.order]
        self.size = np.array([len(w) for w in sorted_words])
        n, m = len(words), int(self.size.max())
        self.char = np.zeros((n, m), np.uint32)
        self.char[np.arange(m) < self.size[:, None]] = codes(sorted_words)
        same = np.zeros(n, np.int64)
        if n > 1:
            same[1:] = np.logical_and.accumulate(self.char[1:] == self.char[:-1], axis=1).sum(axis=1)
        self.same = np.minimum(same, np.minimum(self.size, np.concatenate(([0], self.size[:-1]))))
        self.sum = np.zeros((n, m + 1), U64)
        np.cumsum(K.mix(self.char.astype(U64) + U64(1)) * _UP[:m], axis=1, out=self.sum[:, 1:])

    def __iter__(self):
        """For each depth: depth, its nodes (rows), and (rows, ancestors' rows, depths back, piece ids) of the pieces."""
        n = len(self.size)
        first = {0: np.zeros(n, np.int64)}
        for d in range(1, self.char.shape[1] + 1):
            node = (self.same < d) & (self.size >= d)
            if d > 1 or n:
                first[d] = np.maximum.accumulate(np.where(node, np.arange(n), 0))
            rows = np.flatnonzero(node)
            hits = []
            for back in range(1, min(d, self.vocabulary.longest) + 1):
                h = (self.sum[rows, d] - self.sum[rows, d - back]) * _DOWN[d - back]
                at, piece = self.vocabulary.find(h)
                hits.append((rows[at], first[d - back][rows[at]], back, piece))
            yield d, rows, hits, first
            first.pop(d - self.vocabulary.longest, None)

    def restore(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out


def distinct_words(col: pa.Array, lower: bool):
    """For a column of texts: list of distinct words (with the word mark) and, by word and row, how often."""
    data, off = K.buffers(col)
    names, where, hs, rows = {}, [], [], []
    for i, j in K.chunks(off):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, row = K.spans(part, own)
        h = K.hashes(part, s, e, lower=False)
        u, at = np.unique(h, return_index=True)
        raw = part.tobytes()
        for k, a, b in zip(u.tolist(), s[at].tolist(), e[at].tolist()):
            if k not in names:
                names[k] = len(where)
                where.append(raw[a:b].decode("utf-8", "replace"))
        hs.append(np.array([names[k] for k in u.tolist()], np.int64)[np.searchsorted(u, h)])
        rows.append(row + i)
    word, row = (np.concatenate(hs), np.concatenate(rows)) if hs else (np.zeros(0, np.int64),) * 2
    return [MARK + (w.lower() if lower else w) for w in where], word, row


def fresh_words(col: pa.Array, known: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For a column of texts: hashes (sorted) and words (with the word mark) that are not among the sorted ``known``, and
    hash and row of every word."""
    data, off = K.buffers(col)
    new: dict[int, str] = {}
    hs, rows = [], []
    for i, j in K.chunks(off):
        part, own = data[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, row = K.spans(part, own)
        h = K.hashes(part, s, e, lower=False)
        u, at = np.unique(h, return_index=True)
        if len(known):
            other = known[np.minimum(np.searchsorted(known, u), len(known) - 1)] != u
            u, at = u[other], at[other]
        raw = part.tobytes()
        for k, a, b in zip(u.tolist(), s[at].tolist(), e[at].tolist()):
            if k not in new:
                new[k] = MARK + raw[a:b].decode("utf-8", "replace")
        hs.append(h)
        rows.append(row + i)
    hashed = np.array(sorted(new), U64)
    h, row = (np.concatenate(hs), np.concatenate(rows)) if hs else (np.zeros(0, U64), np.zeros(0, np.int64))
    return hashed, [new[k] for k in hashed.tolist()], h, row
