"""SimHash near-duplicates: fingerprints, and all links within a Hamming distance by the generalised pigeonhole principle.

Fingerprints are computed per document. Links are sought between distinct fingerprints only: equal ones are one class. The
bits are dealt into partitions, correlated bits together; partition i gets a threshold t_i with sum(t_i + 1) >= tau + 1, so
that any two fingerprints within tau bits are within t_i bits in some partition i. The thresholds come from dynamic
programming over the candidate counts that the partitions' value histograms (of all fingerprints) predict. For t_i = 2r
both sides go to the buckets of all values within r bits of their own. Buckets are verified on the whole fingerprint.

Where tau is too large for that, as for near copies by the Jaccard similarity of their shingles (see jaccard), partitions of more
bits are dealt out again and again over the same fingerprint, and the thresholds come from the same dynamic programming, for as many
units as a pair with a given share of differing bits needs to meet with near certainty (`links` with chance).

Else nothing here is approximate: partitions and thresholds change the cost, never the result. A bucket with more rows than
BUCKET is dealt out in blocks of that size, one task for each pair of blocks, so no task holds an unbounded group; within a
bucket only a spanning forest of the links is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import join_hot, materialised, per_batch, table
from attestor.llm.components import components

#: Most rows of one bucket that a task holds and compares.
BUCKET = 20_000
#: Estimated seconds for a bucket row and for a compared pair; the choice of partitions weighs them.
ROW_S, PAIR_S = 2e-6, 4e-9
#: Shuffle rows per fingerprint above which a layout isn't considered.
MOST_ROWS = 200
#: Expected partitions in which a pair meets if links() is given a chance; a pair at just that share meets in none with probability exp(-MEETINGS).
MEETINGS = 12
#: Fewest bits of a partition there.
LEAST_WIDTH = 12


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of uint64 words as big-endian bytes."""
    n, k = words.shape
    offsets = np.arange(0, 8 * k * n + 1, 8 * k, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words).astype(">u8").tobytes())])


def _words(column: pa.Array, k: int) -> np.ndarray:
    """Rows of k uint64 words from a binary column without nulls, all values of 8 k bytes."""
    n = len(column)
    if not n:
        return np.zeros((0, k), np.uint64)
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(column.buffers()[2], ">u8", n * k, first).astype(np.uint64).reshape(n, k)


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the number of each row's; rows are sorted by a mix of their words, and by the words if mixes clash."""
    if words.shape[1] == 1:
        found, at = np.unique(words[:, 0], return_inverse=True)
        return found[:, None], at.ravel()
    mixed = words[:, 0].copy()
    for i in range(1, words.shape[1]):
        mixed = _mix(mixed + np.uint64(i)) ^ words[:, i]
    _, first, at = np.unique(mixed, return_index=True, return_inverse=True)
    found, at = words[first], at.ravel()
    if (found[at] != words).any():
        found, at = np.unique(words, axis=0, return_inverse=True)
    return found, at.ravel()


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes, the bits that are set in over half of them; 0 for an empty group."""
    full = lengths > 0
    out = np.zeros(len(lengths), np.uint64)
    if not full.any():
        return out
    n = lengths[full]
    first = np.cumsum(n) - n
    # Eight counters of one byte in a word hold up to 255 rows, so each group is summed in blocks of 255.
    blocks = (n + 254) // 255
    begin = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    owner = np.cumsum(blocks) - blocks
    bits = np.zeros(len(n), np.uint64)
    lane = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lane, begin)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        for byte in range(8):
            bits |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def fingerprint_batch(texts: list[bytes | None], words: int, seeds: tuple[int, ...]) -> np.ndarray:
    """One uint64 for each text and seed."""
    from xxhash import xxh64_digest

    shingles, lengths = [], []
    for text in texts:
        w = (text or b"").lower().split()
        if len(w) <= words:
            own = [b" ".join(w)] if w else []
        else:
            own = [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]
        shingles += own
        lengths.append(len(own))
    n = np.array(lengths, np.int64)
    return np.stack([majority_bits(np.frombuffer(b"".join([xxh64_digest(x, s) for x in shingles]), ">u8").astype(np.uint64), n) for s in seeds], axis=1)


def fingerprints(docs: DataFrame, words: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id, fp for every row of docs (doc_id, text): fp has eight bytes a seed, most significant first.

    Null and blank texts have the fingerprint zero. Other columns of docs aren't read.
    """
    def f(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": _binary(fingerprint_batch(batch.column(1).to_pylist(), words, seeds))}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), "doc_id long, fp binary", f, 256)


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def correlations(fps: DataFrame, bits: int) -> np.ndarray:
    """Absolute correlation of each two bits over all fingerprints, from one pass with sums of a bounded size."""
    k = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits + 1, bits + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                b = _bit_matrix(_words(batch.column(0).slice(at, 8192), k)).astype(np.float32)
                b = np.concatenate([b, np.ones((len(b), 1), np.float32)], axis=1)
                total += (b.T @ b).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size, dtype=np.int32), "n": total.ravel()})

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((bits + 1) ** 2)
    for r in rows:
        total[r.cell] = r.n
    total = total.reshape(bits + 1, bits + 1)
    n = max(total[bits, bits], 1)
    p = total[:bits, bits] / n
    cov = total[:bits, :bits] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def partitions(corr: np.ndarray, m: int) -> list[list[int]]:
    """Bits (0 is the most significant) in m groups of nearly equal size, each grown by the bit most correlated with it."""
    left = set(range(len(corr)))
    groups = []
    for i in range(m):
        size = (len(left) + m - i - 1) // (m - i)
        first = max(left, key=lambda b: (sum(corr[b, x] for x in left), -b))
        own = [first]
        left.remove(first)
        while len(own) < size:
            b = max(left, key=lambda x: (max(corr[x, y] for y in own), -x))
            own.append(b)
            left.remove(b)
        groups.append(sorted(own))
    return groups


def _values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The value of the bits of a group, its first bit highest."""
    v = np.zeros(len(fps), np.uint64)
    for b in group:
        v = (v << np.uint64(1)) | ((fps[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
    return v


def _ball(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def count_partitions(n: int, bits: int, tau: int) -> int:
    """How many partitions cost least for n fingerprints if all values were equally frequent."""
    best = (float("inf"), 0)
    for m in range(max(3, bits // 22), 13):
        w, units, rows, pairs = bits / m, tau + 1, 0.0, 0.0
        radii = [0] * m if units <= m else [1] * m if units <= 3 * m else None
        if radii is None:
            continue
        if units > m:  # as few partitions with radius 1 as reach the threshold
            need = -(-(units - m) // 2)
            radii = [1] * need + [0] * (m - need)
        for r in radii:
            ball = sum(comb(round(w), x) for x in range(r + 1))
            rows += ball
            pairs += (n * ball) ** 2 / 2 / 2**w
        if rows <= MOST_ROWS:
            best = min(best, (n * rows * ROW_S + pairs * PAIR_S, m))
    if not best[1]:
        raise ValueError(f"no layout for {tau} of {bits} bits stays under {MOST_ROWS} rows a fingerprint")
    return best[1]


def repeated_partitions(n: int, corr: np.ndarray, chance: float) -> tuple[list[list[int]], int]:
    """Groups of bits for n fingerprints, and how many of them a pair needs of whose bits the share chance differs.

    Such a pair agrees on all of w bits with probability (1 - chance)^w; w is the width that costs least if all values were
    equally frequent, but at least LEAST_WIDTH, so that rows grow in proportion to n until buckets call for more. The bits are
    dealt out once by their correlations and then at random, a quarter more often than needed, so that the thresholds can leave
    out the partitions with the largest buckets.
    """
    bits, best = len(corr), (float("inf"), 0, 0)
    for w in range(LEAST_WIDTH, 33):
        need = int(np.ceil(MEETINGS / (1 - chance) ** w))
        if need <= MOST_ROWS:
            best = min(best, (n * need * ROW_S + n * n / 2 / 2**w * need * PAIR_S * bits / 64, w, need))
    _, w, need = best
    groups, rng = partitions(corr, bits // w), np.random.default_rng(w)
    while len(groups) < need + need // 4:
        order = rng.permutation(bits)
        groups += [sorted(order[at : at + w].tolist()) for at in range(0, bits - w + 1, w)]
    return groups[: need + need // 4], need


def histograms(fps: DataFrame, groups: list[list[int]], k: int, most: int = 16) -> list[np.ndarray]:
    """How often each value (its first bits, so many at most) of each group occurs among all fingerprints."""
    widths = [min(len(g), most) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.zeros(1 << w, np.int64) for w in widths]
        for batch in batches:
            words = _words(batch.column(0), k)
            for h, g, w in zip(own, groups, widths, strict=True):
                h += np.bincount((_values(words, g) >> np.uint64(len(g) - w)).astype(np.int64), minlength=len(h))
        for i, h in enumerate(own):
            key = np.flatnonzero(h)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(key), i, np.int32), "key": key.astype(np.int32), "n": h[key]})

    out = [np.zeros(1 << w, np.int64) for w in widths]
    found = fps.select("fp").mapInArrow(run, "part int, key int, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).toArrow()
    part, key, count = (found.column(x).to_numpy() for x in ("part", "key", "n"))
    for i, h in enumerate(out):
        h[key[part == i]] = count[part == i]
    return out


def _spread(h: np.ndarray, radius: int) -> np.ndarray:
    """Rows in each bucket if all values go to the buckets within radius (0 or 1) bits."""
    if not radius:
        return h
    at = np.arange(len(h))
    return h + sum(h[at ^ (1 << b)] for b in range(len(h).bit_length() - 1))


def allocate(hists: list[np.ndarray], groups: list[list[int]], tau: int) -> list[int]:
    """Radius of each partition (-1: not used): dynamic programming on the estimated cost. Radius r covers t = 2r, 2r+1 units."""
    n = hists[0].sum()
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for h, g in zip(hists, groups, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        finer = 2.0 ** (len(g) - (len(h).bit_length() - 1))
        own = {-1: 0.0}
        for r in (0, 1):
            rows = _spread(h, r).astype(float) * (1 + (len(g) - (len(h).bit_length() - 1)) * r / (1 + len(g)))
            own[r] = n * len(_ball(len(g), r)) * ROW_S + (rows**2).sum() / 2 / finer * PAIR_S
        for have, (cost, radii) in best.items():
            for r, more in own.items():
                units = min(tau + 1, have + (2 * r + 1 if r >= 0 else 0))
                if units not in after or cost + more < after[units][0]:
                    after[units] = (cost + more, [*radii, r])
        best = after
    return best[tau + 1][1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket_rows(words: np.ndarray, group: list[int], part: int, radius: int, rows_at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids, row numbers, and codes: twice the partition, plus one in the bucket of the row's own value. rows_at: expected rows by the value's first bits, for buckets of more than most rows, which must be split."""
    v = _values(words, group)
    ball = _ball(len(group), radius)
    keys = (v[:, None] ^ ball[None, :]).ravel()
    row = np.repeat(np.arange(len(words)), len(ball))
    code = np.tile(np.where(np.arange(len(ball)) == 0, 2 * part + 1, 2 * part).astype(np.int16), len(words))
    tag = _mix(keys + (np.uint64(part + 1) << np.uint64(56)))
    blocks = -(-rows_at[(keys >> np.uint64(len(group) - (len(rows_at).bit_length() - 1))).astype(np.int64)] // most)
    hot = blocks > 1
    if not hot.any():
        return tag, row, code
    tags, at, codes = [tag[~hot]], [row[~hot]], [code[~hot]]
    own = _mix(words[:, 0] ^ np.uint64(0x9E3779B97F4A7C15))
    for b in np.unique(blocks[hot]):
        here = np.flatnonzero(hot & (blocks == b))
        mine = (own[row[here]] % np.uint64(b)).astype(np.int64)
        for other in range(b):
            pair = np.minimum(mine, other) * b + np.maximum(mine, other)
            tags.append(_mix(tag[here] ^ _mix(pair.astype(np.uint64) + np.uint64(1))))
            at.append(row[here])
            codes.append(code[here])
    return np.concatenate(tags), np.concatenate(at), np.concatenate(codes)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(a ^ b)
    out = bits[..., 0].astype(np.int32)
    for i in range(1, bits.shape[-1]):
        out += bits[..., i]
    return out


class Forest:
    """Union of pairs of local rows."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up


def link_buckets(bucket: np.ndarray, words: np.ndarray, value: np.ndarray, own: np.ndarray, tau: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links within tau bits inside each bucket that are needed to connect all; rows are sorted by bucket. Row numbers.

    Two rows with one value of the partition's bits meet in the bucket of that value, as own rows, and in others. A forest of
    such links is given there only; elsewhere they are known, and only links that join what they leave apart are given.
    """
    n = len(bucket)
    distinct, same = _distinct(words)
    known = Forest(len(distinct))
    own_forest = Forest(len(distinct))
    cross: list[tuple[np.ndarray, np.ndarray]] = []

    def told(i: np.ndarray, j: np.ndarray) -> None:
        equal = value[i] == value[j]
        known.add(same[i[equal]], same[j[equal]])
        home = equal & own[i] & own[j]
        own_forest.add(same[i[home]], same[j[home]])
        cross.append((same[i[~equal]], same[j[~equal]]))

    for s, c in _link_small(bucket, words, tau, small, told):
        here, first = np.unique(same[s : s + c], return_index=True)
        bound = Forest(len(here))

        def told_here(i: np.ndarray, j: np.ndarray, here=here, bound=bound) -> None:
            told(i, j)
            bound.add(np.searchsorted(here, same[i]), np.searchsorted(here, same[j]))

        _link_large(s + first, words, tau, told_here)
        # Own rows that a pivot of another value connects are given as links too: elsewhere they are known.
        home = np.flatnonzero(own[s + first])
        _, root, at = np.unique(bound.label[home], return_index=True, return_inverse=True)
        known.add(here[home], here[home[root[at]]])
        own_forest.add(here[home], here[home[root[at]]])
    joined = Forest(len(distinct))
    a, b = (known.label[np.concatenate(x)] for x in zip(*cross, strict=True)) if cross else (np.zeros(0, np.int64),) * 2
    joined.add(a, b)
    place = np.zeros(len(distinct), np.int64)
    place[same[::-1]] = np.arange(n)[::-1]
    out = [(c, f.label[c]) for f in (own_forest, joined) for c in [np.flatnonzero(f.label != np.arange(len(distinct)))]]
    child, root = (np.concatenate(x) for x in zip(*out, strict=True))
    return place[child], place[root]


def _link_small(bucket: np.ndarray, words: np.ndarray, tau: int, small: int, told) -> Iterator[tuple[int, int]]:
    """Tells all pairs within tau bits of the buckets up to small, and gives first row and size of the others."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(bucket)])
    little = np.repeat(sizes, sizes) <= small
    for d in range(1, min(small, int(sizes[sizes <= small].max(initial=0)))):
        i = np.flatnonzero(little[:-d] & (bucket[:-d] == bucket[d:]))
        if not len(i):
            break
        step = (1 << 20) // words.shape[1]
        for at in range(0, len(i), step):
            j = i[at : at + step]
            near = j[_distance(words[j], words[j + d]) <= tau]
            told(near, near + d)
    return zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True)


def _merges(a: np.ndarray, b: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As few pairs that join the same rows at each level, ascending, and below."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(level, kind="stable")
    x, y, level = at[: len(a)][order], at[len(a) :][order], level[order]
    forest, every = Forest(len(nodes)), np.arange(len(nodes))
    out = [(a[:0], b[:0], level[:0])]
    cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, np.int64)
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        root = forest.label == every
        forest.add(x[s:e], y[s:e])
        child = np.flatnonzero(root & (forest.label != every))
        out.append((nodes[child], nodes[forest.label[child]], np.full(len(child), level[s])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def link_first(bucket: np.ndarray, words: np.ndarray, code: np.ndarray, masks: dict[int, np.ndarray], tau: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links like those of link_buckets for many partitions, in most of which a near pair has equal values and so meets again.

    A pair is at home in the first partition (masks: bits of those in use, ascending) on whose bits it agrees; a pair that agrees
    on none is at home wherever it meets. Pairs elsewhere are known, but links that are given may rely only on known pairs of
    earlier partitions, and on none of their own: so no two tasks rely on each other.
    """
    _, same = _distinct(words)
    part = code >> 1
    place = np.zeros(same.max() + 1, np.int64)
    place[same[::-1]] = np.arange(len(same))[::-1]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(same[:0], same[:0], same[:0])]

    def told(i: np.ndarray, j: np.ndarray) -> None:
        apart = words[i] ^ words[j]
        first, left = np.full(len(i), max(masks) + 1), np.arange(len(i))
        for p, mask in masks.items():
            if not len(left):
                break
            agree = ~(apart[left] & mask).any(axis=1)
            first[left[agree]] = p
            left = left[~agree]
        away = (first <= max(masks)) & (first != part[i])
        held.append((same[i], same[j], 2 * first + away))
        if len(held) >= 64 or len(i) >= 1 << 18:
            held[:] = [_merges(*(np.concatenate(x) for x in zip(*held, strict=True)))]

    for s, c in _link_small(bucket, words, tau, small, told):
        _, once = np.unique(same[s : s + c], return_index=True)
        _link_large(s + once, words, tau, told)
    a, b, level = _merges(*(np.concatenate(x) for x in zip(*held, strict=True)))
    own = level % 2 == 0
    return place[a[own]], place[b[own]]


def _link_large(left: np.ndarray, words: np.ndarray, tau: int, told) -> None:
    """Links that connect the rows of a large bucket: what is within tau of a pivot is one component and needs no comparison
    among itself; only rows within 2 tau of the pivot can be near those."""
    while len(left) > 1:
        d = _distance(words[left], words[left[0]])
        near, rest = left[d <= tau], left[d > tau]
        others = near[near != left[0]]
        told(others, np.full(len(others), left[0]))
        maybe = left[(d > tau) & (d <= 2 * tau)]
        if len(others) and len(maybe):
            step = max(1, (1 << 21) // (len(others) * words.shape[1]))
            for at in range(0, len(maybe), step):
                x = maybe[at : at + step]
                hit = _distance(words[x][:, None, :], words[others][None, :, :]) <= tau
                row = np.flatnonzero(hit.any(axis=1))
                told(x[row], others[hit[row].argmax(axis=1)])
        left = rest


def links(fps: DataFrame, tau: int, bits: int = 64, chance: float | None = None, small: int = 48, most: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join every two within tau bits into one component.

    With chance, they join two within tau bits of which that share of all bits differs with a probability of about
    1 - exp(-MEETINGS), more if fewer differ. Buckets up to small are compared in vectors; larger ones than most are dealt out.
    """
    k, most = bits // 64, most or BUCKET
    n = fps.count()
    if chance is None:
        groups, units, first = partitions(correlations(fps, bits), count_partitions(n, bits, tau)), tau + 1, 16
    else:
        (groups, units), first = repeated_partitions(n, correlations(fps, bits), chance), min(16, max(8, (n // most).bit_length() + 4))
    hists = histograms(fps, groups, k, first)
    radii = allocate(hists, groups, units - 1)
    masks = {i: np.array([sum(1 << 63 - b % 64 for b in g if b // 64 == x) for x in range(k)], np.uint64) for i, (g, r) in enumerate(zip(groups, radii, strict=True)) if r >= 0}
    expected = [_spread(h, max(r, 0)) for h, r in zip(hists, radii, strict=True)]

    def expand(batch: pa.RecordBatch) -> dict:
        words = _words(batch.column(0), k)
        made = [_bucket_rows(words, g, i, r, e, most) for i, (g, r, e) in enumerate(zip(groups, radii, expected, strict=True)) if r >= 0]
        return {"bucket": np.concatenate([x[0] for x in made]).view(np.int64), "code": np.concatenate([x[2] for x in made]), "fp": _binary(words[np.concatenate([x[1] for x in made])])}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def out(bucket: np.ndarray, code: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
            if chance is None:
                value = np.zeros(len(bucket), np.uint64)
                for part in np.unique(code >> 1):
                    here = np.flatnonzero(code >> 1 == part)
                    value[here] = _values(words[here], groups[part])
                a, b = link_buckets(bucket, words, value, (code & 1).astype(bool), tau, small)
            else:
                a, b = link_first(bucket, words, code, masks, tau, small)
            if len(a):
                yield pa.RecordBatch.from_arrays([_binary(words[a]), _binary(words[b])], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _words(batch.column(2), k)))
            rows += batch.num_rows
            if rows < 200_000:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            if cut:
                yield from out(*(x[:cut] for x in whole))
            held, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if rows:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = per_batch(fps.select("fp"), "bucket long, code short, fp binary", expand, 4096 // k)
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = 4, tau: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text).

    Two documents are linked if their fingerprints differ by at most tau bits; component_id is the smallest doc_id that can
    be reached over links. Rows without a doc_id take part; a component of such rows only has a null component_id. Repeated
    rows stay. An empty table gives an empty result.
    """
    own = materialised(fingerprints(docs, words, seeds), "fingerprints")
    nodes = materialised(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    found = components(links(nodes, tau, 64 * len(seeds)))
    labelled = materialised(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")).withColumnRenamed("n", "copies"), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # One fingerprint may be that of a third of all documents, one component as large: neither key is shuffled.
    by_fp = join_hot(labelled.select("fp", "label", "copies"), smallest, "label").select("fp", "component_id", F.col("copies").alias("n"))
    return join_hot(own, by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, that of the smallest doc_id, then of the smallest text digest.

    Two texts are linked if the Jaccard similarity of their shingle sets, verified on the sets, is at least part / whole (see
    jaccard). A row is known by its doc_id and its text: rows without a doc_id and different texts under one doc_id are rows
    like others; a row without a doc_id stays only where its component has no other. Exact repeats of a row stay once.
    """
    from attestor.llm.jaccard import near_copies, text_key  # it builds on this module

    found = near_copies(docs, words, similarity)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = found.groupBy("label").agg(F.min(row).alias("row")).select("row.*")
    # A row's keys are never null, and repeats are sought by the keys of the join, so that texts are shuffled once.
    known = lambda doc_id: {"__id": F.coalesce(doc_id, F.lit(0)), "__none": doc_id.isNull()}
    own = docs.withColumns({"__text": text_key(F.col("text")), **known(F.col("doc_id").cast("long"))})
    kept = kept.select(F.col("text_key").alias("__text"), *(x.alias(name) for name, x in known(F.col("doc_id")).items()))
    keys = ["__text", "__id", "__none"]
    return own.join(kept, keys, "left_semi").dropDuplicates([*keys, "doc_id"]).drop(*keys)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 4-word shingles and 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
