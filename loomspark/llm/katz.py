"""Katz backoff scoring with Good-Turing discounts and exactly normalised backoff weights.

p(w|h) = d(c(h,w)) c(h,w)/c(h) if the pair was seen, else a(h) p(w); p(w) = d(c(w)) c(w)/N if the word was
seen, else the mass left over, as one class for all unknown words. a(h) = left(h) / (1 - sum of p(w) over the
words seen after h), so each p(.|h) sums to one. Counts above KMAX keep 1 - KEEP of their mass: a context
that repeats one successor only still has something to back off with.

Nothing is looked up row by row. Every text's pairs go to the part of the table that owns their word (pairs of
very frequent words are spread by the whole pair). There the pair counts and word counts meet all uses of
them, and the score splits into sums per text: log counts, how many pairs have each discounted count, log
p(w) of unseen pairs. Only contexts travel once more, to form the backoff weights.

Frequent keys are known before anything is dealt out. Words and pairs that make up a HEAVYth part of all tokens
are at most HEAVY each: such a pair is scored where the text is read, and the weight of such a context is summed
apart and sent to all, so that its unseen pairs may lie anywhere. The number of buckets follows the bytes of text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .store import written

U64 = np.uint64
END, START = U64(0x13198A2E03707344), U64(0x243F6A8885A308D3)
ALL = U64(0xA4093822299F31D0)  # where the counts of counts stand among the sums of contexts
KMAX = 5
KEEP = 1e-4
HEAVY = 1000
FLUSH, FLUSH_WORDS = 800_000, 2_000_000  # tokens a task holds before it packs their pairs, or counts them
BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 72  # of text, about, whose pairs meet in one bucket; so many of these at least
SUB = 12  # a bucket is worked through in so many parts, which bounds the memory of its task
PAIRS, TEXTS, CONTEXTS, UNSEEN, WEIGHED, SUMS, ROWS = range(7)  # kinds of packed rows


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with a small header, compressed; rising whole numbers as their steps, wide items with their first bytes
    together, then their second, and so on: hashes in order and sums of like size share their high bytes."""
    head, body = [], []
    for a in arrays:
        first = ""
        if a.dtype == np.int64 and len(a) and int(a[-1]) - int(a[0]) < 1 << 63 and (a[1:] >= a[:-1]).all():
            first, a = str(a[0]), small(np.diff(a))
        head.append(f"{a.dtype.str},{len(a)},{first}")
        body.append((a if a.itemsize < 8 else np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes())
    said = ";".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(said).to_bytes(4, "little") + said + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4 : 4 + n].decode().split(";"):
        kind, size, first = part.split(",")
        kind, size = np.dtype(kind), int(size)
        if kind.itemsize < 8:
            a = np.frombuffer(raw, kind, size, at)
        else:
            a = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T.copy().reshape(-1).view(kind)
        at += a.nbytes
        out.append(np.cumsum(np.append(np.int64(first), a.astype(np.int64))) if first else a)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def found(x: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of x is among the sorted names, and its place there."""
    at = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
    return (names[at] == x if len(names) else np.zeros(len(x), bool)), at


def pair_key(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return K.mix(w ^ K.mix(h))


def _batch(rows):
    """Packed rows (kind, bucket, blob) as a record batch."""
    kinds, parts, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


PACKED = "kind int, bucket int, blob binary"
SENT = 2 << 20  # bytes of packed rows that go out at once


def _sent(rows):
    """Record batches of packed rows as they are made; no more than SENT bytes, or one row, wait."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= SENT:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def by_bucket(df: DataFrame, run, schema: str, through: tuple[int, ...] = ()) -> DataFrame:
    """``run(bucket, kinds, blobs)`` for the packed rows of each bucket; it gives record batches. Rows come in short batches
    and go in short batches, so that only the task that works on a bucket holds it whole, and holds it once. Rows of the
    kinds ``through`` go on as they come."""

    def go(batches):
        now, kinds, blobs = None, [], []
        for batch in batches:
            if through:
                passing = np.isin(batch.column(0).to_numpy(), through)
                if passing.any():
                    yield batch.filter(pa.array(passing))
                    batch = batch.filter(pa.array(~passing))
            for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if blobs:
                        yield from run(now, kinds, blobs)
                    now, kinds, blobs = bucket, [], []
                    K.release()
                kinds.append(kind)
                blobs.append(blob)
        if blobs:
            yield from run(now, kinds, blobs)
        K.release()

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(go, schema)


def _of(kind: int, kinds: list[int], blobs: list[bytes]) -> list[list[np.ndarray]]:
    return [unpack(b) for k, b in zip(kinds, blobs) if k == kind]


def _spread(parts: int, kind: int, key: np.ndarray, *columns):
    """Columns packed by the bucket of their key."""
    b = (K.mix(key) % U64(parts)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], np.arange(parts + 1))
    for p in np.flatnonzero(at[1:] > at[:-1]):
        x = order[at[p] : at[p + 1]]
        yield kind, int(p), pack(*(c[x] for c in columns))


def _words(parts: int):
    """Words of all texts, and of the training texts among them, counted per task and packed by bucket."""

    def run(batches):
        held, flags, n, ends = [], [], 0, [0, 0]

        def flush():
            w = np.concatenate([*held, np.full(sum(ends), END)])
            t = np.concatenate([*flags, np.arange(sum(ends)) < ends[1]])
            names, inv = np.unique(w, return_inverse=True)
            every, train = np.bincount(inv, minlength=len(names)), np.bincount(inv[t], minlength=len(names))
            return _batch(list(_spread(parts, 0, names, names, small(train), small(every))))

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, rows, h, row in K.words(batch.column(0)):
                mine = train[first : first + rows]
                held.append(h)
                flags.append(mine[row])
                n, ends = n + len(h), [ends[0] + int((~mine).sum()), ends[1] + int(mine.sum())]
                if n > FLUSH_WORDS:
                    yield from K.sliced(flush())
                    held, flags, n, ends = [], [], 0, [0, 0]
                    K.release()
        if sum(ends):
            yield from K.sliced(flush())
        K.release()

    return run


STATS = "n long, total long, v long, r array<long>, word long, c long, c_all long"


def _word_stats(frame: pd.DataFrame) -> pd.DataFrame:
    """One row of sums of a bucket, and a row for each of its frequent words."""
    w, c, every = (np.concatenate(x) for x in zip(*map(unpack, frame["blob"])))
    order = np.argsort(w, kind="stable")
    w, c, every = w[order], c[order].astype(np.int64), every[order].astype(np.int64)
    at = runs(w)
    c, every, w = np.add.reduceat(c, at), np.add.reduceat(every, at), w[at]
    big = np.flatnonzero(every * HEAVY >= every.sum())
    r = np.bincount(np.minimum(c, KMAX + 2), minlength=KMAX + 3)[1 : KMAX + 2]
    none = [0] * len(big)
    return pd.DataFrame({
        "n": [int(c.sum()), *none], "total": [int(every.sum()), *none], "v": [int((c > 0).sum()), *none], "r": [r.tolist()] + [[0] * (KMAX + 1)] * len(big),
        "word": [0, *w[big].view(np.int64).tolist()], "c": [0, *c[big].tolist()], "c_all": [0, *every[big].tolist()],
    })


def discounts(r: list[int]) -> np.ndarray:
    """d[1..KMAX], and d[KMAX+1] for larger counts. Good-Turing ratios in Katz's form; a ratio outside (0, 1)
    (too few counts of counts) gives half a count of discount instead."""
    d = np.full(KMAX + 2, 1 - KEEP)
    n = np.array([0, *r], float)
    over = (KMAX + 1) * n[KMAX + 1] / n[1] if n[1] else 1.0
    for k in range(1, KMAX + 1):
        x = ((k + 1) * n[k + 1] / (k * n[k]) - over) / (1 - over) if n[k] and over < 1 else -1.0
        d[k] = x if 0 < x < 1 else (k - 0.5) / k
    return d


def neighbours(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, the token before it, and row: the words of each row and one end."""
    size = np.bincount(row, minlength=rows)
    last = np.cumsum(size)
    token = np.insert(h, last, END)  # the end of each text follows its last word
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate(([0], (last + np.arange(1, rows + 1))[:-1]))] = START
    return token, before, np.insert(row, last, np.arange(rows))


def _frequent_pairs(shared):
    """Pairs of frequent words, counted per task: at most HEAVY * (HEAVY + 1) of them."""

    def run(batches):
        words = shared.value
        n = len(words)
        keys, count = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for first, rows, h, row in K.words(batch.column(0)):
                w, b, own = neighbours(h, row, rows)
                ok, at = found(w, words)
                ok_b, at_b = found(b, words)
                start = b == START
                ok &= ok_b | start
                key = at[ok] * (n + 1) + np.where(start[ok], n, at_b[ok])
                got, inv = np.unique(np.concatenate((keys, key)), return_inverse=True)
                t = train[first : first + rows][own[ok]]
                new = np.stack((np.bincount(inv[len(keys) :][t], minlength=len(got)), np.bincount(inv[len(keys) :], minlength=len(got))), 1)
                new[inv[: len(keys)]] += count
                keys, count = got, new
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count[:, 0]), pa.array(count[:, 1])], names=["pair", "c", "c_all"])
        K.release()

    return run


class Hot(NamedTuple):
    """Frequent words (sorted), and the frequent pairs: key (sorted), what a use adds to the base and the score, how
    often it was seen in training (at most KMAX + 1), whether its word is known, its context."""

    words: np.ndarray
    pairs: np.ndarray
    base: np.ndarray
    score: np.ndarray
    level: np.ndarray
    known: np.ndarray
    context: np.ndarray


def _unseen(parts: int, heavy: np.ndarray, h: np.ndarray, who: np.ndarray, c: np.ndarray):
    """Uses of unseen pairs, packed by context; those of a frequent context by text as well."""
    key = np.where(found(h, heavy)[0] | (h == START), pair_key(h, who.view(U64)), h)
    return _spread(parts, UNSEEN, key, h, who, small(c))


def _sums(d: np.ndarray, k: int, base, score, times, known, level):
    """What TEXTS holds of each text: base, score, known tokens, and pairs by how often they were seen."""
    out = [np.bincount(d, weights=x * times, minlength=k).astype(float) for x in (base, score)]
    for x in (known * times, *(times * (level == r) for r in range(1, KMAX + 2))):
        out.append(small(np.bincount(d, weights=x, minlength=k).astype(np.int64)))
    return out


def _pairs(parts: int, shared):
    """Pairs of every text, packed by the bucket that owns their word; frequent pairs are scored at once.

    A row is named by its partition and its number there; names, ids and sizes of the rows are packed too (ROWS).
    """

    def flush(base, ids, train, w, h, d):
        hot: Hot = shared.value
        w, h, d = (np.concatenate(x) for x in (w, h, d))
        names = base + np.arange(len(ids))
        null = np.array([x is None for x in ids], bool)
        train = np.array(train, bool)
        yield from _spread(parts, ROWS, names.view(U64), names, np.array([x or 0 for x in ids], np.int64), null, train, small(np.bincount(d, minlength=len(ids))))
        ok, at = found(pair_key(w, h), hot.pairs)
        if ok.any():
            at, who = at[ok], d[ok]
            texts, inv = np.unique(who, return_inverse=True)
            own = names[texts]
            yield from _spread(parts, TEXTS, own.view(U64), own, *_sums(inv, len(texts), hot.base[at], hot.score[at], np.ones(len(at)), hot.known[at], hot.level[at]))
            never = hot.level[at] == 0
            if never.any():
                yield from _unseen(parts, hot.words, hot.context[at[never]], names[who[never]], np.ones(int(never.sum()), np.int64))
            w, h, d = w[~ok], h[~ok], d[~ok]
        del ok, at
        b = (K.mix(w) % U64(parts * SUB)).astype(np.int32)
        spread = found(w, hot.words)[0]
        b[spread] = pair_key(w[spread], h[spread]) % U64(parts * SUB)
        order = np.argsort(b, kind="stable").astype(np.int32)
        cut = np.searchsorted(b[order], np.arange(0, (parts + 1) * SUB, SUB))
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            x = order[cut[p] : cut[p + 1]]
            x = x[np.lexsort((d[x], h[x], w[x], b[x]))]
            ws, hs, ds, bs = w[x], h[x], d[x], b[x]
            at = runs(bs, ws, hs, ds)
            count = np.diff(np.append(at, len(ws)))
            ws, hs, ds, bs = ws[at], hs[at], ds[at], bs[at]
            word = runs(bs, ws)
            ctx, hi = np.unique(hs, return_inverse=True)
            who, di = np.unique(ds, return_inverse=True)
            sub = np.searchsorted(bs, np.arange(p * SUB, (p + 1) * SUB + 1))
            yield PAIRS, p, pack(sub, ws[word], np.append(word, len(ws)), ctx, small(hi), np.array([base]), small(who), train[who], small(di), small(count))

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        ids, train, w, h, d, n = [], [], [], [], [], 0
        for batch in batches:
            own, flag = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, rows, word, row in K.words(batch.column(0)):
                token, before, at = neighbours(word, row, rows)
                w.append(token)
                h.append(before)
                d.append((at + len(ids)).astype(np.int32))
                ids += own[first : first + rows]
                train += flag[first : first + rows]
                n += len(token)
                if n > FLUSH:
                    yield from _sent(flush(base, ids, train, w, h, d))
                    base += len(ids)
                    ids, train, w, h, d, n = [], [], [], [], [], 0
                    K.release()
        if n:
            yield from _sent(flush(base, ids, train, w, h, d))
        K.release()

    return run


def _context_sums(key, p1, count):
    """By context: probability of the words seen after it, pairs seen 1 to KMAX times, uses of those seen more often."""
    ctx, inv = np.unique(key, return_inverse=True)
    k = len(ctx)
    cols = [np.bincount(inv[count == r], minlength=k) for r in range(1, KMAX + 1)]
    return ctx, [np.bincount(inv, weights=p1, minlength=k).astype(float), *cols, np.bincount(inv, weights=np.where(count > KMAX, count, 0), minlength=k).astype(np.int64)]


def _table(parts: int, n: int, v: int, unigram: np.ndarray, left: float, heavy: np.ndarray, heavy_count: np.ndarray):
    """One bucket of the pair table: counts, then what each text, context and unseen pair takes from it."""

    def part(opened, sub):
        """Sums by text, sums by context, unseen pairs and counts of counts of one part of the bucket."""
        w, h, d, c, names, train, base = [], [], [], [], [], [], 0
        for cut, word, begin, ctx, hi, first, who, flag, di, count in opened:
            if cut[sub + 1] > cut[sub]:
                x = slice(cut[sub], cut[sub + 1])
                have, mine = np.unique(di[x], return_inverse=True)
                a, b = np.searchsorted(begin, cut[sub : sub + 2])  # no word lies in two parts
                w.append(np.repeat(word[a:b], np.diff(begin[a : b + 1])))
                h.append(ctx[hi[x]])
                d.append((mine + base).astype(np.int32))
                c.append(count[x].astype(np.int32))
                names.append(first[0] + who[have].astype(np.int64))
                train.append(flag[have])
                base += len(have)
        if not w:
            return None
        names, train = np.concatenate(names), np.concatenate(train)
        w, h, d, c = (np.concatenate(x) for x in (w, h, d, c))
        order = np.lexsort((h, w))
        w, h, d, c = w[order], h[order], d[order], c[order]
        learn = np.where(train[d], c, 0)
        texts, inv = np.unique(names, return_inverse=True)
        d = inv[d].astype(np.int32)
        pair = runs(w, h)
        each = np.diff(np.append(pair, len(w)))
        seen = np.add.reduceat(learn, pair).astype(np.int64)  # c(h, w)
        word = runs(w[pair])
        total = np.add.reduceat(seen, word)  # c(w)
        ok, at = found(w[pair][word], heavy)
        total[ok] = heavy_count[at[ok]]
        p1 = np.where(total > 0, unigram[np.minimum(total, KMAX + 1)] * total / max(n, 1), left)
        owner = np.repeat(np.arange(len(word)), np.diff(np.append(word, len(pair))))
        known, end = total[owner] > 0, w[pair] == END
        context = np.where(known & ~end, -np.log10(np.maximum(total[owner], 1)), 0.0)  # of the token that follows
        score = np.where(seen > 0, np.log10(np.maximum(seen, 1)), np.log10(p1[owner])) + context
        level = np.minimum(seen, KMAX + 1)
        use = np.repeat(np.arange(len(pair)), each)
        sums = _sums(d, len(texts), np.log10((total[owner] + 1) / (n + v + 1))[use], score[use], c, known[use], level[use])
        new = np.flatnonzero(level[use] == 0)
        kept = np.flatnonzero(seen > 0)
        of = _context_sums(h[pair[kept]], p1[owner[kept]], seen[kept])
        return (texts, sums), of, (h[new], texts[d[new]], c[new]), np.bincount(np.minimum(seen[kept], KMAX + 2), minlength=KMAX + 3)[1 : KMAX + 2]

    def joined(got):
        """Sums of the parts by key."""
        key, inv = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        out = []
        for c in zip(*(c for _, c in got)):
            c = np.concatenate(c)
            x = np.bincount(inv, weights=c, minlength=len(key))
            out.append(x if c.dtype.kind == "f" else small(x.astype(np.int64)))
        return key, out

    def results(got):
        """Packed rows of the parts' results; what is no longer needed is given up on the way."""
        texts, sums = joined([x[0] for x in got])
        yield from _spread(parts, TEXTS, texts.view(U64), texts, *sums)
        del texts, sums
        ctx, of = joined([x[1] for x in got])
        often = found(ctx, heavy)[0] | (ctx == START)
        yield from _spread(parts, CONTEXTS, ctx[~often], ctx[~often], *(x[~often] for x in of))
        r = sum(x[3] for x in got)
        yield SUMS, 0, pack(np.append(ctx[often], ALL), np.append(of[0][often], 0.0), *(np.append(x[often].astype(np.int64), y) for x, y in zip(of[1:], r)))
        del ctx, of
        h, who, c = (np.concatenate([x[2][i] for x in got]) for i in range(3))
        got.clear()
        if len(h):
            order = np.lexsort((who, h))
            h, who, c = h[order], who[order], c[order]
            at = runs(h, who)
            yield from _unseen(parts, heavy, h[at], who[at], np.add.reduceat(c, at))

    def run(_, kinds, blobs):
        opened = _of(PAIRS, kinds, blobs)
        blobs.clear()
        got = [x for x in (part(opened, s) for s in range(SUB)) if x]
        opened.clear()
        if got:
            yield from _sent(results(got))

    return run


def _open_sums(frames):
    for f in frames:
        for blob in f["blob"]:
            ctx, *cols = unpack(blob)
            yield pd.DataFrame({"ctx": ctx.view(np.int64), **{f"s{i}": c for i, c in enumerate(cols)}})


def weights(d: np.ndarray, mass: np.ndarray, by: list[np.ndarray]) -> np.ndarray:
    """log10 of a(h) c(h); 0 for a context that was not seen."""
    held = sum(by[r - 1].astype(float) * r for r in range(1, KMAX + 1)) + by[KMAX]
    keep = sum(by[r - 1].astype(float) * r * d[r] for r in range(1, KMAX + 1)) + by[KMAX] * d[KMAX + 1]
    out = np.zeros(len(mass))
    ok = held > 0
    out[ok] = np.log10((held - keep)[ok] / np.maximum(1 - mass[ok], 1e-300))
    return out


def _backoff(parts: int, d: np.ndarray, heavy: dict[int, float]):
    """What unseen pairs take from the weights of the contexts of one bucket, by text."""

    def run(_, kinds, blobs):
        ask = _of(UNSEEN, kinds, blobs)
        if not ask:
            return
        h, who, c = (np.concatenate([x[i] for x in ask]) for i in range(3))
        wanted = np.unique(h)
        mass, by = np.zeros(len(wanted)), [np.zeros(len(wanted)) for _ in range(KMAX + 1)]
        for kind, b in zip(kinds, blobs):
            if kind != CONTEXTS:
                continue
            ctx, m, *cols = unpack(b)
            ok, at = found(ctx, wanted)
            np.add.at(mass, at[ok], m[ok])
            for x, y in zip(by, cols):
                np.add.at(x, at[ok], y[ok])
        weight = weights(d, mass, by)
        for i in np.flatnonzero(np.isin(wanted, np.array([*heavy], U64))):
            weight[i] = heavy[int(wanted[i])]
        texts, inv = np.unique(who, return_inverse=True)
        score = np.bincount(inv, weights=c * weight[np.searchsorted(wanted, h)])
        yield from K.sliced(_batch(list(_spread(parts, WEIGHED, texts.view(U64), texts, score))))

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(d: np.ndarray, start: float):
    """Sums of the texts of one bucket."""

    def run(_, kinds, blobs):
        name, ids, null, train, tokens = (np.concatenate(x) for x in zip(*_of(ROWS, kinds, blobs)))
        order = np.argsort(name)
        name, ids, null, train, tokens = (x[order] for x in (name, ids, null, train, tokens))
        sums = np.zeros((3 + KMAX + 1, len(name)))
        for key, *cols in _of(TEXTS, kinds, blobs):
            at = np.searchsorted(name, key)
            for x, y in zip(sums, cols):
                np.add.at(x, at, y)
        for key, more in _of(WEIGHED, kinds, blobs):
            np.add.at(sums[1], np.searchsorted(name, key), more)
        score = sums[1] + np.log10(d[1 : KMAX + 2]) @ sums[3:] + start
        columns = {"doc_id": pa.array(ids, mask=null), "held_out": pa.array(~train), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(sums[2].astype(np.int64)), "base_score": pa.array(sums[0]), "score": pa.array(score)}
        yield pa.RecordBatch.from_pydict(columns)

    return run


def katz_scores(docs: DataFrame, held_out) -> DataFrame:
    """Scores every text of ``docs(doc_id, text, ...)``; learns from rows where the Column ``held_out`` is false.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row; tokens
    are lower-cased (A-Z) words and one end for each text. A null text counts as empty: one token, its end. Null
    ids and repeated ids keep a row each; a null ``held_out`` counts as true. Other columns are ignored. Without a
    training row every token is unknown and has probability 1. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(True))).alias("train"))
    texts = docs.select("text", "train")
    size, starts = docs.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    parts = max(LEAST_BUCKETS, -(-(size or 0) // BUCKET_BYTES))
    counted = written(texts.mapInArrow(_words(parts), PACKED).groupBy("bucket").applyInPandas(_word_stats, STATS))
    n, every, v, *r = (x or 0 for x in counted.agg(F.sum("n"), F.sum("total"), F.sum("v"), *[F.sum(F.col("r")[i]) for i in range(KMAX + 1)]).first())
    rows = counted.where(F.col("c_all") * HEAVY >= max(every, 1)).select("word", "c").collect()  # at most HEAVY rows
    heavy = np.array([x[0] for x in rows], np.int64).view(U64)
    heavy_count = np.array([x[1] for x in rows], np.int64)[np.argsort(heavy)]
    heavy = np.sort(heavy)
    d1 = discounts(r)
    low = sum(r[k - 1] * k for k in range(1, KMAX + 1))
    left = 1 - (sum(r[k - 1] * k * d1[k] for k in range(1, KMAX + 1)) + (n - low) * d1[KMAX + 1]) / n if n else 1.0

    shared = spark.sparkContext.broadcast(heavy)  # at most HEAVY words
    often = texts.mapInArrow(_frequent_pairs(shared), "pair long, c long, c_all long").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))
    got = np.array(often.where(F.col("c_all") * HEAVY >= max(every, 1)).select("pair", "c").collect(), np.int64).reshape(-1, 2)  # at most HEAVY rows
    word, seen = got[:, 0] // (len(heavy) + 1), got[:, 1]
    h = np.append(heavy, START)[got[:, 0] % (len(heavy) + 1)]
    c, w = (heavy_count[word], heavy[word]) if len(heavy) else (seen, h)
    p1 = np.where(c > 0, d1[np.minimum(c, KMAX + 1)] * c / max(n, 1), left)
    score = np.where(seen > 0, np.log10(np.maximum(seen, 1)), np.log10(p1)) + np.where((c > 0) & (w != END), -np.log10(np.maximum(c, 1)), 0.0)
    keys = pair_key(w, h)
    columns = keys, np.log10((c + 1) / (n + v + 1)), score, np.minimum(seen, KMAX + 1), c > 0, h
    hot = spark.sparkContext.broadcast(Hot(heavy, *(x[np.argsort(keys)] for x in columns)))  # at most HEAVY words and pairs

    table = written(by_bucket(docs.mapInArrow(_pairs(parts, hot), PACKED), _table(parts, n, v, d1, left, heavy, heavy_count), PACKED, through=(TEXTS, UNSEEN, ROWS)))
    names = ["m", *(f"s{i}" for i in range(KMAX + 1))]
    opened = table.where(F.col("kind") == SUMS).mapInPandas(_open_sums, "ctx long, s0 double, " + ", ".join(f"s{i} long" for i in range(1, KMAX + 2))).toDF("ctx", *names)
    sums = opened.groupBy("ctx").agg(*[F.sum(x).alias(x) for x in names]).collect()  # at most HEAVY + 2 rows
    ctx = np.array([x[0] for x in sums], np.int64).view(U64)
    sums = np.array([list(x)[1:] for x in sums], float).reshape(-1, len(names))
    own, of = _context_sums(h[seen > 0], p1[seen > 0], seen[seen > 0])
    ctx, inv = np.unique(np.concatenate((ctx, own, [ALL])), return_inverse=True)
    both = np.zeros((len(ctx), len(names)))
    np.add.at(both, inv[: len(sums)], sums)
    np.add.at(both, inv[len(sums) : -1], np.stack(of, 1))
    at = int(np.searchsorted(ctx, ALL))
    d2 = discounts((both[at, 1:] + np.bincount(np.minimum(seen[seen > 0], KMAX + 2), minlength=KMAX + 3)[1 : KMAX + 2]).tolist())
    weight = dict(zip(ctx.tolist(), weights(d2, both[:, 0], list(both[:, 1:].T)).tolist()))

    more = by_bucket(table.where(F.col("kind").isin(CONTEXTS, UNSEEN)), _backoff(parts, d2, weight), PACKED)
    scores = by_bucket(table.where(F.col("kind").isin(TEXTS, ROWS)).union(more), _scores(d2, -float(np.log10(starts)) if starts else 0.0), SCORES)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
