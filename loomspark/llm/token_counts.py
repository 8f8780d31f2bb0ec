"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens (words, with the word mark) are put in a trie. A unigram model over the pieces of a fixed public vocabulary
gives every node two numbers, worked out once for all pre-tokens that share the prefix: the forward score, the logarithm
of the summed probability of all its segmentations, and the best segmentation's score with its count of tokens. A
pre-token takes the numbers of its last node. A character without a piece counts one token a UTF-8 byte.

The model's probabilities are how often the vocabulary's own encoder uses each piece in all texts, smoothed. A task keeps
the numbers of the distinct pre-tokens it has met, so that a word is scored once, however often it comes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .lattice import GROUP, LONG, MARK, Levels, Vocabulary, fresh_words, read_pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE = -20.0
SMOOTH = 0.1
KNOWN = 500_000  # distinct pre-tokens whose numbers a task keeps: 32 bytes each
BATCH = 2000


def _bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)


def scored(words: list[str], vocabulary: Vocabulary, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward score, best score and the best segmentation's tokens of each word; of equal best scores, the fewest
    tokens. ``score``: log probability of each piece."""
    total, value, count = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for g in range(0, len(short), GROUP):
        mine = short[g : g + GROUP]
        levels = Levels([words[i] for i in mine], vocabulary)
        n = len(mine)
        forward, v, c = {0: np.zeros(n)}, {0: np.zeros(n)}, {0: np.zeros(n, np.int64)}
        ends = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        for d, rows, hits, first in levels:
            b = np.zeros(n, np.int64)
            b[rows] = _bytes(levels.char[rows, d - 1])
            up = first[d - 1][rows]
            summed, now, number = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
            single = np.zeros(n, bool)
            single[hits[0][0]] = True
            lone = ~single[rows]
            r, u = rows[lone], up[lone]
            summed[r] = forward[d - 1][u] + BYTE * b[r]
            now[r] = v[d - 1][u] + BYTE * b[r]
            number[r] = c[d - 1][u] + b[r]
            for r, a, back, piece in hits:  # at most one piece of a length ends at a node
                summed[r] = np.logaddexp(summed[r], forward[d - back][a] + score[piece])
                s, k = v[d - back][a] + score[piece], c[d - back][a] + 1
                better = (s > now[r] + 1e-9) | ((s > now[r] - 1e-9) & (k < number[r]))
                now[r[better]], number[r[better]] = s[better], k[better]
            for kept, new in ((forward, summed), (v, now), (c, number)):
                kept[d] = new
                kept.pop(d - vocabulary.longest, None)
            done = levels.size == d
            for end, x in zip(ends, (summed, now, number)):
                end[done] = x[first[d][done]]
        total[mine], value[mine], count[mine] = map(levels.restore, ends)
    for i, w in enumerate(words):
        if len(w) > LONG:
            total[i], value[i], count[i] = scored_alone(w, vocabulary, score)
    return total, value, count


def scored_alone(w: str, vocabulary: Vocabulary, score: np.ndarray) -> tuple[float, float, int]:
    """The same for one word, character by character."""
    f, v, c = [0.0], [0.0], [0]
    for d in range(1, len(w) + 1):
        summed, now, number = [], -np.inf, 0
        if w[d - 1] not in vocabulary.ids:
            b = len(w[d - 1].encode("utf-8", "surrogatepass"))
            summed, now, number = [f[d - 1] + BYTE * b], v[d - 1] + BYTE * b, c[d - 1] + b
        for back in range(1, min(d, vocabulary.longest) + 1):
            piece = vocabulary.ids.get(w[d - back : d])
            if piece is not None:
                summed.append(f[d - back] + score[piece])
                s, k = v[d - back] + score[piece], c[d - back] + 1
                if s > now + 1e-9 or (s > now - 1e-9 and k < number):
                    now, number = s, k
        top = max(summed)
        f.append(top + float(np.log(sum(np.exp(x - top) for x in summed))))
        v.append(now)
        c.append(number)
    return f[-1], v[-1], c[-1]


def _uses(path: str):
    """How often each piece is used: the distinct pre-tokens of a task are encoded once for each time it is full."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        place = {sp.piece_to_id(p): i for i, p in enumerate(read_pieces(path))}
        at = np.full(sp.get_piece_size(), -1)
        at[list(place)] = list(place.values())
        uses = np.zeros(len(place), np.int64)
        known, texts, times = np.zeros(0, np.uint64), [], np.zeros(0, np.int64)

        def count():
            for i in range(0, len(texts), GROUP):
                ids = sp.encode([t[1:] for t in texts[i : i + GROUP]], num_threads=1)
                piece = at[np.fromiter((x for y in ids for x in y), np.int64)]
                often = np.repeat(times[i : i + GROUP], [len(y) for y in ids])
                np.add.at(uses, piece[piece >= 0], often[piece >= 0])

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                hashed, words, h, _ = fresh_words(batch.column(0).slice(start, BATCH), known)
                put = np.searchsorted(known, hashed)
                known, times = np.insert(known, put, hashed), np.insert(times, put, 0)
                merged = [*texts, *words]
                order = np.insert(np.arange(len(texts)), put, np.arange(len(texts), len(merged)))
                texts = [merged[i] for i in order.tolist()] if len(words) else texts
                np.add.at(times, np.searchsorted(known, h), 1)
                if len(known) > KNOWN // 4:
                    count()
                    known, texts, times = np.zeros(0, np.uint64), [], np.zeros(0, np.int64)
        count()
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], names=["piece", "n"])
        K.release()

    return run


def learn(docs: DataFrame, path: str = VOCABULARY) -> np.ndarray:
    """Log probability of each piece from all texts of ``docs(text)``; a row for each piece comes to the driver."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_uses(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(read_pieces(path)))
    for r in found:
        n[r.piece] = r.n
    return np.log((n + SMOOTH) / (n.sum() + SMOOTH * len(n)))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_pretokens, n_tokens, score, forward``, one row per row.

    ``n_tokens`` and ``score`` sum the tokens and log scores of the pre-tokens' best segmentations (of equal scores the
    one of fewest tokens), ``forward`` their forward scores. A null or empty text has no token and scores of 0; very
    long texts and words are read whole; null and repeated ids get a row each, which count in the model like any other;
    other columns are ignored; an empty table gives an empty result. ``path`` must be readable on every executor.
    Nothing of the texts is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(read_pieces(path)), learn(docs, path)))  # as large as the vocabulary

    def run(batches):
        vocabulary, score = shared.value
        known, numbers = np.zeros(0, np.uint64), np.zeros((0, 3))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                n = part.num_rows
                if len(known) > KNOWN:
                    known, numbers = np.zeros(0, np.uint64), np.zeros((0, 3))
                hashed, words, h, row = fresh_words(part.column(1), known)
                if words:
                    put = np.searchsorted(known, hashed)
                    known, numbers = np.insert(known, put, hashed), np.insert(numbers, put, np.stack(scored(words, vocabulary, score), 1), axis=0)
                mine = numbers[np.searchsorted(known, h)]
                f, v, c = (np.bincount(row, weights=mine[:, i], minlength=n) for i in range(3))
                columns = [part.column(0), pa.array(np.bincount(row, minlength=n)), pa.array(c.astype(np.int64)), pa.array(v.astype(np.float64)), pa.array(f.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens", "score", "forward"])
        K.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double, forward double")


__all__ = ["MARK", "learn", "scored", "scored_alone", "token_counts"]
