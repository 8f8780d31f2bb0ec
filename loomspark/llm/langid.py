"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations, found by the forward algorithm over a trie of the distinct words; a text's score
is the product over its words, and its language the likeliest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .lattice import GROUP, Levels, Vocabulary, distinct_words, read_pieces

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 2000  # texts of each language that probabilities are learned from, about
SMOOTH = 0.05
UNKNOWN = 1e-8  # of a character that no piece has
SHORT = 24  # characters of a word whose probability stays in the range of doubles, as no piece has less than 1e-12


def forward(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """log probability of each word in each language, shape (words, languages); p: (pieces, languages).

    Words of up to SHORT characters share a trie; longer ones are rescaled at every character. Both give the same."""
    out = np.zeros((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    for g in range(0, len(short), GROUP):
        mine = short[g : g + GROUP]
        levels = Levels([words[i] for i in mine], vocabulary)
        n = len(mine)
        alpha = {0: np.ones((n, p.shape[1]))}
        total = np.zeros((n, p.shape[1]))
        for d, rows, hits, first in levels:
            now = np.zeros((n, p.shape[1]))
            single = np.ones(n, bool)
            for r, up, back, piece in hits:
                now[r] += alpha[d - back][up] * p[piece]
                if back == 1:
                    single[r] = False
            r = rows[single[rows]]
            now[r] += alpha[d - 1][first[d - 1][r]] * UNKNOWN
            alpha[d] = now
            alpha.pop(d - vocabulary.longest, None)
            done = levels.size == d
            total[done] = now[first[d][done]]
        out[mine] = levels.restore(np.log(np.maximum(total, 1e-300)))
    for i, w in enumerate(words):
        if len(w) > SHORT:
            out[i] = _forward_long(w, vocabulary, p)
    return out


def _forward_long(w: str, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """The same for one long word, rescaled at every step."""
    kept, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for d in range(1, len(w) + 1):
        now = np.zeros(p.shape[1])
        for back in range(1, min(d, vocabulary.longest, len(kept)) + 1):
            piece = vocabulary.ids.get(w[d - back : d])
            q = p[piece] if piece is not None else UNKNOWN if back == 1 else None
            if q is not None:
                now = now + kept[-back] * q
        now = np.maximum(now, 1e-300)
        scale += np.log(now)
        kept = [x / now for x in kept[-vocabulary.longest :]] + [np.ones(p.shape[1])]
    return scale


def _piece_counts(path: str):
    def run(frames):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = {p: i for i, p in enumerate(read_pieces(path))}
        for f in frames:
            got: dict[tuple[str, int], int] = {}
            for lang, text in zip(f["lang"], f["text"]):
                for piece in sp.encode(text.lower(), out_type=str, num_threads=1):
                    if (i := vocabulary.get(piece)) is not None:
                        got[lang, i] = got.get((lang, i), 0) + 1
            K.release()
            yield pd.DataFrame([(a, b, c) for (a, b), c in got.items()], columns=["lang", "piece", "n"]).astype({"piece": "int64", "n": "int64"})

    return run


def learn(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from ``docs(doc_id, text, lang)``, about ``sample`` texts of each
    language drawn by a hash of the id; what reaches the driver is bounded by languages times vocabulary."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = docs.groupBy("lang").agg(F.count("*").alias("rows"))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.join(F.broadcast(size), "lang").where(u * F.col("rows") < sample).select("lang", "text")  # size: a row a language
    counts = drawn.mapInPandas(_piece_counts(path), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    n = len(read_pieces(path))
    c = np.zeros((n, len(langs)))
    c[counts["piece"], counts["lang"].map({x: i for i, x in enumerate(langs)})] = counts["n"]
    if langs:
        every = (c.sum(axis=1) + 0.1) / (c.sum() + 0.1 * n)
        c = (c + SMOOTH * c.sum(axis=0) * every[:, None]) / ((1 + SMOOTH) * c.sum(axis=0))
    return langs, c


def identify(docs: DataFrame, held_out: Column, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> ``doc_id, held_out, lang_pred, score``, one row per row.

    Learns from rows where ``held_out`` is false and neither text nor lang is null; ``score`` is the posterior
    of the predicted language (equal priors). A text that is null or has no letter is ``und`` with score 0, as is
    every text if nothing could be learned; ties go to the first language by name. A null ``held_out`` (as of a null id)
    is shown as it is, and such a row is not learned from; repeated rows give a row each. Other columns are ignored; an
    empty table gives an empty result. ``path`` must be readable on every executor.
    """
    langs, p = learn(docs.where(~held_out), path, sample)
    table = docs.sparkSession.sparkContext.broadcast((langs, p.astype(np.float64)))  # languages x vocabulary
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        langs, p = table.value
        vocabulary = Vocabulary(read_pieces(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                text = part.column(2)
                n = part.num_rows
                best, score = np.full(n, -1), np.zeros(n)
                if langs:
                    words, word, row = distinct_words(text, lower=True)
                    # by text: a word counts as often as it occurs
                    total = np.zeros((n, len(langs)))
                    if words:
                        said = forward(words, vocabulary, p)
                        for k in range(len(langs)):
                            total[:, k] = np.bincount(row, weights=said[word, k], minlength=n)
                    letter = np.zeros(n, bool)
                    has = np.array([any(map(str.isalpha, w)) for w in words], bool)
                    letter[row[has[word]] if len(words) else row] = True
                    best = np.where(letter, total.argmax(axis=1), -1)
                    total = np.exp(total - total.max(axis=1, keepdims=True))
                    score = np.where(letter, total.max(axis=1) / total.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([langs[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
        K.release()

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
