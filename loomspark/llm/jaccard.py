"""N-gram Jaccard join by universe partition and pigeonhole.

Sets X, Y of sizes s <= t with Jaccard >= p/100 differ in at most ``H = (s+t)(100-p)/(100+p)`` shingles.
Sizes are cut into bands; all sets that can meet in a band (its own and those of the band below) hash their
shingles into the same ``m`` segments. A set of size s uses the first ``q(s)`` segments; a matching segment
is worth one unit, a segment that is also indexed by its one-deletion neighbourhood two. When the units
exceed H, one used segment of X is equal to (or one shingle away from) that of Y, whatever Y is. How many
segments a band gets and how many of them carry the deletion neighbourhood is allocated by cost.

Signatures that more than ``crowd`` sets share are not expanded into pairs. Each set counts the units it
lost so; a pair can be missed only if both of its sets lost more than they had to spare. Those sets meet
again by their crowded signatures, but only across components that are still apart, and by an exact bound
from parity sketches (the number of differing parities never exceeds the number of differing shingles).
Every candidate is verified on the texts.

Signatures without content (empty segments) are crowded almost always: a set counts their units as lost where it is
read, and only sets that cannot spare so many send them. A set that can spare them shares another signature with each
of its partners; of two sets that cannot, both send them.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .components import components
from .store import buckets, join_small, written

U64 = np.uint64
PER_SEGMENT = 3.0
SLACK = 1.12
OWN, NEXT = 0, 1
BLOCK = 2048
BUCKET_BYTES = 12 << 20  # of text, about, whose signatures meet in one bucket: each bucket names its sets again
BLOCK_SHINGLES = 1 << 16  # whose signatures are made at once, about
HASH = U64((1 << 47) - 1)  # bits of a signature; its role goes above them
PAIRS = 1 << 15  # of a crowded signature whose sketches are compared at once, about


class Bands:
    """Size bands and their allocation; a pure function of the threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1, 2]
        self._used: dict[int, list[int]] = {}

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size * 2 + 4:
            lo, p = self.lows[-1], self.percent
            self.lows.append(max(lo + 1, lo * 100 // p * 100 // p, -(-lo * 100 // p)))

    def band(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def far(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def high(self, band: int) -> int:
        self._grow(self.lows[band] if band < len(self.lows) else self.lows[-1] * 2)
        while band + 1 >= len(self.lows):
            self._grow(self.lows[-1])
        return self.lows[band + 1] - 1

    def need(self, band: int, size: int) -> int:
        """Units that let a set of this size find every partner of at least its size in the band."""
        return self.far(size, min(self.high(band), size * 100 // self.percent)) + 1

    @lru_cache(maxsize=None)
    def segments(self, band: int) -> tuple[int, int]:
        """(segments, how many of them carry deletions): as few signatures as give the units at about
        PER_SEGMENT shingles each; smaller segments are cheaper but crowded, deletions make up the rest."""
        high = self.high(band)
        m = max(1, int(high / PER_SEGMENT))
        short = self.need(band, high) * SLACK - m * (1 - exp(-high / m))
        return m, min(m, max(0, int(np.ceil(short / (1 - exp(-high / m))))))

    def used(self, band: int, size: int) -> int:
        """q(size): never falls as the size grows, so a larger set indexes all that a smaller one asks."""
        m, d = self.segments(band)
        low = self.lows[band - 1] if band else 1
        known = self._used.setdefault(band, [1])
        for x in range(low + len(known) - 1, size + 1):
            full = 1 - exp(-x / m)
            units = self.need(band, x) * SLACK / full
            q = units - d if units > 2 * d else units / 2
            known.append(min(m, max(known[-1], int(np.ceil(q)))))
        return known[size - low + 1]

    @lru_cache(maxsize=None)
    def plan(self, band: int, size: int) -> tuple[int, int, int, int]:
        """m, deletion segments, used segments, units to spare (negative: partners may be missed)."""
        m, d = self.segments(band)
        q = self.used(band, size)
        return m, d, q, q + min(d, q) - self.need(band, size)


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def roles(b: Bands, size: int):
    """Where a set takes part: with its own band, and with the next one if a partner may be there."""
    own = b.band(size)
    yield OWN, own
    if size * 100 // b.percent > b.high(own):
        yield NEXT, own + 1


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    if not sets:
        return np.zeros(0, U64), np.zeros(0, U64)
    x, size = np.concatenate(sets), np.array([len(s) for s in sets])
    at = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[at]
    out = np.zeros((2, len(sets)), U64)
    if len(at):
        out[0, at] = np.add.reduceat(K.mix(x), begin)
        out[1, at] = np.add.reduceat(K.mix(x ^ U64(0x5851F42D4C957F2D)), begin)
    return out[0], out[1]


def blocks(rows, most: int = BLOCK_SHINGLES):
    """Lists of sets of about so many shingles in all."""
    held, n = [], 0
    for _, x in rows:
        held.append(x)
        n += len(x)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def sketch(x: np.ndarray) -> bytes:
    """Parities of at least two buckets a shingle."""
    n = 64
    while n < 2 * len(x):
        n *= 2
    return np.packbits(np.bincount((x >> U64(17)) & U64(n - 1), minlength=n) & 1, bitorder="little").tobytes()


def _fold(s: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(s, np.uint8)
    while len(x) > n:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(s: bytes, t: bytes) -> int:
    """A lower bound of the symmetric difference."""
    n = min(len(s), len(t))
    return int(np.bitwise_count(_fold(s, n) ^ _fold(t, n)).sum())


SETS = "doc_id long, n long, key long, key2 long, sketch binary"


def _sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            n, key, key2, sk = [], [], [], []
            for sets in blocks(K.sets(batch.column(1), k)):
                one, two = _keys(sets)
                n += [len(x) for x in sets]
                key += one.view(np.int64).tolist()
                key2 += two.view(np.int64).tolist()
                sk += [sketch(x) if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(key2, pa.int64()), pa.array(sk, pa.binary())], names=["doc_id", "n", "key", "key2", "sketch"])
        K.release()

    return run


def signatures(sets: list[np.ndarray], band: np.ndarray, plan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set of each, units of each set's signatures without content); band and plan of each set.

    A signature has 45 bits and two low ones: the content is empty, the segment is worth two units. Those without
    content are given only for sets that cannot spare their units."""
    x, size = np.concatenate(sets), np.array([len(s) for s in sets])
    m, d, q, spare = plan.T
    begin = np.cumsum(q) - q
    seg = (K.mix(x ^ np.repeat((band * 0x2545F491 + 7).astype(U64), size)) % np.repeat(m.astype(U64), size)).astype(np.int64)
    used = seg < np.repeat(q, size)
    place, value = (seg + np.repeat(begin, size))[used], K.mix(x[used] + U64(0x632BE59BD9B4E019))
    who = np.repeat(np.arange(len(q)), q)
    number = np.arange(len(who)) - begin[who]
    full = np.zeros(len(who), U64)
    np.add.at(full, place, value)
    name, deep = K.mix(number.astype(U64) << U64(12) ^ band[who].astype(U64)), number < d[who]
    at = np.flatnonzero(deep[place])
    cut = place[at]
    rest = full[cut] - value[at]
    empty = full == 0
    out = np.concatenate((K.mix(full * U64(3) + name) << U64(2) | empty.astype(U64) << U64(1) | deep.astype(U64), K.mix(rest * U64(3) + name[cut]) << U64(2) | (rest == 0).astype(U64) << U64(1) | U64(1)))
    own = np.concatenate((who, who[cut]))
    empty[cut[rest == 0]] = True
    blank = np.bincount(who, weights=empty * (1 + deep), minlength=len(q)).astype(np.int64)
    keep = ((out & U64(2)) == 0) | (blank > spare)[own]
    return out[keep] & HASH, own[keep], blank


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the low bytes of all first: the high ones are mostly zeros, which Spark's codec packs."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(blob: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _index(k: int, percent: int, parts: int):
    """Packed signatures by bucket: names, sizes and counts of signatures of the sets, then 6 bytes a signature; one
    bucket also gets (name, role and units without content) of all sets that have such."""

    def flush(keys, sizes, sigs, who, blank_of, blanks):
        if not sigs:
            return None
        sig, own = np.concatenate(sigs), np.concatenate(who)
        key, size = np.concatenate(keys), np.concatenate(sizes)
        bucket = (K.mix(sig) % U64(parts)).astype(np.int64)
        order = np.argsort(bucket * len(key) + (own >> 1))
        sig, own, bucket = sig[order] | (own[order] & 1).astype(U64) << U64(47), own[order] >> 1, bucket[order]
        low = sig.view(np.uint8).reshape(-1, 8)[:, :6]
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1]))))
        count = np.diff(np.append(first, len(own)))
        at, of = np.searchsorted(bucket, np.arange(parts + 1)), np.searchsorted(bucket[first], np.arange(parts + 1))
        name, units = np.concatenate(blank_of), np.concatenate(blanks)
        rows, blobs = [], []
        for p in np.flatnonzero(np.diff(at)).tolist():
            mine = own[first[of[p] : of[p + 1]]]
            rows.append(p)
            blobs.append(np.array([len(mine), at[p + 1] - at[p], len(name)], np.int64).tobytes() + key[mine].tobytes() + _planes(size[mine]) + _planes(count[of[p] : of[p + 1]]) + low[at[p] : at[p + 1]].tobytes() + key[name >> 1].tobytes() + _planes(units << 1 | (name & 1)))
            name, units = name[:0], units[:0]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches):
        b = bands(percent)
        keys, sizes, sigs, who, blank_of, blanks, seen, held = [], [], [], [], [], [], set(), 0
        for batch in batches:
            for sets in blocks(K.sets(batch.column(0), k)):
                one, two = _keys(sets)
                new = []
                for i, key in enumerate(zip(one.tolist(), two.tolist())):
                    if len(sets[i]) and key not in seen:
                        seen.add(key)
                        new.append(i)
                base = sum(map(len, keys))
                keys.append(one[new])
                sizes.append(np.array([len(sets[i]) for i in new], np.int64))
                parts_of: dict[int, list] = {OWN: [], NEXT: []}
                for j, i in enumerate(new):
                    for role, band in roles(b, len(sets[i])):
                        if b.need(band, len(sets[i])) > 1:  # else only equal sets are linked; they share a class already
                            parts_of[role].append((j, i, band, b.plan(band, len(sets[i]))))
                for role, mine in parts_of.items():
                    if not mine:
                        continue
                    s, own, blank = signatures([sets[i] for _, i, _, _ in mine], np.array([x[2] for x in mine]), np.array([x[3] for x in mine]))
                    name = base + np.array([x[0] for x in mine]) << 1 | role
                    sigs.append(s)
                    who.append(name[own])
                    blank_of.append(name[blank > 0])
                    blanks.append(blank[blank > 0])
                    held += len(s)
                if held > 1_000_000 or len(seen) >= 30_000:
                    if (out := flush(keys, sizes, sigs, who, blank_of, blanks)) is not None:
                        yield from K.sliced(out)
                    keys, sizes, sigs, who, blank_of, blanks, seen, held = [], [], [], [], [], [], set(), 0
                    K.release()
        if (out := flush(keys, sizes, sigs, who, blank_of, blanks)) is not None:
            yield from K.sliced(out)
        K.release()

    return run


LOWEST = 16  # signatures of a set that are compared to find where a pair comes first
#: kind 0: candidate pair (a, b); 1: set a in role b>>40 lost units (low 40 bits of b) by crowded signatures with
#: content; 2: sets (blob) that share crowded signature a in band role b; 3: as 1, by all signatures without content
FOUND = "kind int, a long, b long, blob binary"


def _probe(percent: int, crowd: int):
    """Candidates of one bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, own, sig, bare, base = [], [], [], [], [], 0
        for blob in frame["blob"]:
            nk, ns, nb = (int(v) for v in np.frombuffer(blob, np.int64, 3))
            at = 24
            keys.append(np.frombuffer(blob, np.uint64, nk, at))
            at += 8 * nk
            sizes.append(_unplaned(blob, nk, at))
            at += 4 * nk
            own.append(np.repeat(np.arange(base, base + nk, dtype=np.int32), _unplaned(blob, nk, at)))
            at += 4 * nk
            wide = np.zeros((ns, 8), np.uint8)
            wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * ns, at).reshape(-1, 6)
            sig.append(wide.view(np.uint64).ravel())
            at += 6 * ns
            if nb:
                units = _unplaned(blob, nb, at + 8 * nb)
                bare.append((np.frombuffer(blob, np.int64, nb, at), (units & 1) << 40 | units >> 1))
            base += nk
        keys, sizes, own, sig = np.concatenate(keys), np.concatenate(sizes), np.concatenate(own), np.concatenate(sig)
        del frame
        names, first, same = np.unique(keys, return_index=True, return_inverse=True)
        sizes = sizes[first]
        name = same[own] << 1 | (sig >> U64(47)).astype(np.int64)
        sig &= HASH
        order = np.lexsort((name, sig))
        sig, name = sig[order], name[order]
        who, role = name >> 1, name & 1
        del own, order
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who, role = sig[keep], who[keep], role[keep]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(start, len(sig)))
        found = []
        for g in range(2, crowd + 1):
            at = start[count == g]
            if not len(at):
                continue
            i, j = np.triu_indices(g, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = role[a] + role[b] < 2
            found.append(np.stack((who[a[ok]], who[b[ok]]), 1))
        big, kinds, va, vb, blobs = np.flatnonzero(count > crowd), [], [], [], []
        if len(big):
            inside = np.repeat(big, count[big])
            at = np.concatenate([np.arange(start[g], start[g] + count[g]) for g in big])
            empty = (sig[at] & U64(2)) > 0
            found.append(np.stack((who[start[inside]], who[at]), 1)[~empty])
            units = np.bincount(name[keep][at], weights=~empty * (1 + (sig[at] & U64(1)).astype(np.int64)), minlength=2 * len(names)).astype(np.int64)
            lost = np.flatnonzero(units)
            kinds.append(np.ones(len(lost), np.int32))
            va.append(names[lost >> 1].view(np.int64))
            vb.append((lost & 1) << 40 | units[lost])
            blobs += [None] * len(lost)
            for g in big:
                for i in range(start[g], start[g] + count[g], 4096):
                    part = slice(i, min(i + 4096, start[g] + count[g]))
                    for r in (OWN, NEXT):
                        mine = names[who[part][role[part] == r]]
                        if len(mine):
                            kinds.append(np.full(1, 2, np.int32))
                            va.append(np.array([sig[i]]).view(np.int64))
                            vb.append(np.array([r]))
                            blobs.append(mine.tobytes())
        for a, b in bare:
            kinds.append(np.full(len(a), 3, np.int32))
            va.append(a)
            vb.append(b)
            blobs += [None] * len(a)
        if found:
            pair = np.concatenate(found)
            s, t = sizes[pair[:, 0]], sizes[pair[:, 1]]
            pair = pair[(pair[:, 0] != pair[:, 1]) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))]
            pair.sort(axis=1)
            pair = np.unique(pair[:, 0] * len(names) + pair[:, 1])
            kinds.insert(0, np.zeros(len(pair), np.int32))
            va.insert(0, names[pair // len(names)].view(np.int64))
            vb.insert(0, names[pair % len(names)].view(np.int64))
            blobs = [None] * len(pair) + blobs
        K.release()
        if not kinds:
            return pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "blob": []})
        return pd.DataFrame({"kind": np.concatenate(kinds), "a": np.concatenate(va), "b": np.concatenate(vb), "blob": blobs})

    return run


def _near(percent: int):
    """Of candidates with both sketches, those that the bound cannot exclude."""

    def run(batches):
        for batch in batches:
            n, m, s, t = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [apart(x, y) * (100 + percent) <= (a + b) * (100 - percent) for a, b, x, y in zip(n, m, s, t)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def _verify(k: int, percent: int):
    """Exact counts on whole texts: links only."""

    def run(batches):
        last = (None, None)
        for batch in batches:
            left, right = [], []
            a, b, ta, tb = (batch.column(i) for i in range(4))
            sb = K.sets(tb, k)
            ids, texts = a.to_pylist(), None
            for i, (_, y) in enumerate(sb):
                if last[0] != ids[i]:
                    last = (ids[i], next(K.sets(ta.slice(i, 1), k))[1])
                x = last[1]
                both = np.concatenate((x, y))
                both.sort()
                o = int((both[1:] == both[:-1]).sum())
                if 100 * o >= percent * (len(both) - o):
                    left.append(ids[i])
                    right.append(b[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        K.release()

    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (class ids) among candidate pairs of set keys: sketch bound, then the texts."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    c = join_small(classes.select("key", "doc_id", "n", "sketch"), keys, "key", "left_semi", most=500_000)
    two = pairs.join(c.toDF("a", "a_id", "a_n", "a_sketch"), "a").join(c.toDF("b", "b_id", "b_n", "b_sketch"), "b")
    two = two.where((F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent))
    near = written(two.select("a_id", "b_id", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(_near(percent), "a long, b long"))
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    t = join_small(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", most=500_000)
    full = near.join(t.toDF("b", "b_text"), "b").join(t.toDF("a", "a_text"), "a").select("a", "b", "a_text", "b_text")
    return written(full.mapInArrow(_verify(k, percent), "a long, b long"))


def _open(blobs):
    for frame in blobs:
        out = [(s, r, v) for s, r, x in zip(frame["a"], frame["b"], frame["blob"]) for v in np.frombuffer(x, np.int64).tolist()]
        yield pd.DataFrame(out, columns=["sig", "role", "key"]).astype("int64")


def _across(percent: int, nearest: bool):
    """Pairs of one block pair of a crowded signature, in different components, within the sketch bound; with
    ``nearest`` only each set's nearest such partner (which settles most, so that few pairs are left).

    Otherwise a pair that the lowest signatures of both sets show together elsewhere, at a lower place, is left to that
    place: a pair comes once, however many signatures it shares (unless none of them is among the lowest of both)."""

    def run(frame):
        """``frame``: an Arrow table, or one of pandas; the result is of the same kind."""
        key, comp, block, role, n, p, q, sketches = (frame[c].to_numpy() for c in ("key", "comp", "block", "role", "n", "p", "q", "sketch"))
        _, once = np.unique(key, return_index=True)
        once = once[np.argsort(n[once], kind="stable")]
        key, comp, block, role, n, sketches = (x[once] for x in (key, comp, block, role, n, sketches))
        first, second = int(p[0]), int(q[0])
        width = np.array([len(s) for s in sketches])
        folded: dict[int, np.ndarray] = {}
        if not nearest:
            here = frame["at"].to_numpy()[0]
            low = np.full((len(key), LOWEST), np.iinfo(np.int64).max)
            for i, x in enumerate(frame["low"].to_numpy()[once]):
                low[i, : len(x)] = x

        def bound(i, j, w):
            """The pairs whose sketches, folded to w bytes, do not exclude them, and these distances."""
            if w not in folded:
                folded[w] = np.stack([_fold(s, w) if len(s) >= w else np.zeros(w, np.uint8) for s in sketches]).view(U64)
            d = np.bitwise_count(folded[w][j] ^ folded[w][i]).sum(axis=1, dtype=np.int64)
            ok = d * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
            return i[ok], j[ok], d[ok]

        # sizes rise, so a partner's sketch is at least as wide
        begin = np.arange(1, len(key) + 1)
        count = np.maximum(np.searchsorted(n, n * 100 // percent, "right") - begin, 0)
        got = []
        for w in np.unique(width).tolist():
            mine = np.flatnonzero((width == w) & (count > 0))
            most = max(1, PAIRS * 16 // w)
            part = np.cumsum(count[mine]) // most
            for g in np.unique(part):
                i = mine[part == g]
                j = np.arange(count[i].sum()) + np.repeat(begin[i] - (np.cumsum(count[i]) - count[i]), count[i])
                i = np.repeat(i, count[i])
                ok = (comp[i] != comp[j]) & (role[i] + role[j] < 2)
                if first != second:
                    ok &= block[i] != block[j]
                i, j = i[ok], j[ok]
                if len(i) and w >= 16:  # a narrow fold excludes most
                    i, j, _ = bound(i, j, w // 2)
                if len(i):
                    i, j, d = bound(i, j, w)
                    if not nearest:
                        for a in range(0, len(i), PAIRS):
                            x, y = i[a : a + PAIRS], j[a : a + PAIRS]
                            ok = ~((low[y][:, :, None] == low[x][:, None, :]).any(axis=2) & (low[y] < here)).any(axis=1)
                            got.append((x[ok], y[ok], d[a : a + PAIRS][ok]))
                    else:
                        got.append((i, j, d))
        i, j, d = (np.concatenate(x) for x in zip(*got)) if got else [np.zeros(0, np.int64)] * 3
        if nearest and len(i):
            i, j, d = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((d, d))
            order = np.lexsort((j, d, i))
            _, at = np.unique(i[order], return_index=True)
            i, j = i[order][at], j[order][at]
        pairs = np.unique(np.sort(np.stack((key[i], key[j]), 1), axis=1), axis=0)
        out = {"a": pairs[:, 0], "b": pairs[:, 1]}
        return pd.DataFrame(out) if isinstance(frame, pd.DataFrame) else pa.table(out)

    return run


def _spare(percent: int):
    def run(frame: pd.Series) -> pd.DataFrame:
        b = bands(percent)
        out = []
        for n in frame:
            got = {r: b.plan(band, n)[3] for r, band in roles(b, int(n))} if n else {}
            out.append((got.get(OWN, 0), got.get(NEXT, 0)))
        return pd.DataFrame(out, columns=["own", "next"])

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, crowd: int = 16) -> DataFrame:
    """Documents linked when the Jaccard similarity of their k-word shingle sets is at least percent/100.

    ``docs(doc_id, text, ...)``; other columns are ignored. Returns one row per document: ``doc_id``,
    ``n_shingles`` (size of its set), ``component_id`` (smallest doc_id reachable by links). Texts that are
    null, empty or without a word have an empty set and stand alone. Equal sets form one class, so copies
    are never expanded into pairs; repeated rows with one doc_id give one result row each, and each of their texts
    links. A row without an id gets the component of the rows with its set, null if none has an id; texts that only
    such rows hold link nothing. An empty table gives an empty result. ``crowd`` only shifts work between the two exact ways; it drops nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(docs.mapInArrow(_sets(k), SETS))
    classes = written(every.where("n > 0").groupBy("n", "key", "key2").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")))
    parts = max(buckets(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    packed = docs.select("text").mapInArrow(_index(k, percent, parts), "bucket int, blob binary")
    found = written(packed.groupBy("bucket").applyInPandas(_probe(percent, crowd), FOUND))

    links = _links(written(found.where("kind = 0").select("a", "b").distinct()), classes, docs, k, percent)
    label = written(components(links))

    # sets that lost more units than they had to spare, and the crowded signatures they share
    spare = F.pandas_udf(_spare(percent), "own int, next int")
    lost = found.where("kind IN (1, 3)").select("kind", F.col("a").alias("key"), F.shiftright("b", 40).alias("role"), F.col("b").bitwiseAND((1 << 40) - 1).alias("units")).groupBy("key", "role").agg(F.sum(F.when(F.col("kind") == 1, F.col("units")).otherwise(0)).alias("units"), F.max(F.when(F.col("kind") == 3, F.col("units")).otherwise(0)).alias("blank"))
    sizes = classes.groupBy("n").count().select("n", spare("n").alias("spare"))
    named = classes.join(sizes, "n").select("key", "doc_id", "n", "sketch", "spare")
    own = F.when(F.col("role") == OWN, F.col("spare.own")).otherwise(F.col("spare.next"))
    short = written(lost.join(named, "key").where(F.col("units") + F.col("blank") > own).select("key", "role", "doc_id", "n", "sketch", (F.col("blank") > own).alias("blanks")))
    shared = found.where("kind = 2").select("a", "b", "blob").mapInPandas(_open, "sig long, role long, key long")
    # empty segments matter only to sets whose other segments cannot give the units; for all others a match is elsewhere
    meet = written(shared.join(short.select("key", "role", "blanks"), ["key", "role"]).where(F.col("blanks") | (F.col("sig").bitwiseAND(2) == 0)).select("sig", "role", "key"))
    for nearest in (True, False):
        now = short.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "role", "n", "sketch", F.coalesce("component", "doc_id").alias("comp"))
        part = meet.where("shiftright(sig, 2) % 4 = 0") if nearest else meet  # the second turn sees all that is still apart
        # a signature whose sets are in one component can tell nothing new
        held = part.join(now.select("key", "role", "comp"), ["key", "role"])
        apart_still = held.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).where("c0 != c1").select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        rows = part.join(apart_still, "sig").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("sig", "role", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).join(now, ["key", "role"])
        if not nearest:  # as many signatures as a set has segments, of which the lowest are kept
            low = meet.groupBy("key", "role").agg(F.slice(F.array_sort(F.collect_list(F.xxhash64("sig"))), 1, LOWEST).alias("low"))
            rows = rows.join(low, ["key", "role"]).withColumn("at", F.xxhash64("sig"))
        more = written(rows.groupBy("sig", "p", "q").applyInArrow(_across(percent, nearest), "a long, b long").distinct())
        if not more.isEmpty():
            links = written(links.union(_links(more, classes, docs, k, percent)))
            label = written(components(links))

    group = every.where("n > 0").join(classes.select("n", "key", "key2", F.col("doc_id").alias("class_id")), ["n", "key", "key2"]).join(label.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"))
    return group.union(every.where("n = 0").select("doc_id", "n", "doc_id"))
