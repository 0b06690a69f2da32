"""Near-duplicate components by an exact Jaccard join on word shingles with PartEnum signatures.

Sizes are cut into bands.  Two sets that link have sizes within the ratio of the threshold, so
both sign for the band of the larger; there they differ in at most k elements.  The shingle
domain is split into k // 2 + 1 partitions by hash, each into three cells: some partition
holds at most one difference, hence two of its three cells are equal in both sets.  A signature
is a hash of two cells' contents, for each partition and each choice of two, so linking sets share
one.  Two empty cells say nothing; there the signature is combined with each signature of a
second, independent partitioning, which linking sets share by the same argument.

Equal sets are one class before anything else, so exact copies sign once.  A signature with few
classes gives all its pairs.  One with many gives pairs with three of its members only, and
after these are linked, what is still apart meets by its rarest shingles: two sets that link share one
among the first of each, in any order of all shingles, when so many are taken that what is left can't be
enough for a link.  In the order of rarity few sets that don't link have one in common, though a common passage
may be in all of them.  So no link between components is lost, and a group of near copies costs about its size.

Signatures of a band and a partition meet only their like, so they are dealt by these: a set's
name goes along once for some partitions of one band, not once for each signature, however many
parts a large table has.

Pairs are first held against sketches that can't rule out a link, then verified on whole sets of
64-bit shingle hashes.  Texts are sent to where they are needed, since they are smaller than their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import components, freed, marked, row_key, written
from ._text import Words, mix, pack, ranges, slices, spared, unpack, utf8, windows

#: Classes under one signature up to which all pairs are tried; rows of a block of pairs beyond that.
FEW, BLOCK = 24, 2048
#: Signatures of a part and the least number of parts; signatures that a task packs at once.
PART_SIGS, LEAST_PARTS, PACKED_SIGS = 1_500_000, 64, 1 << 20
#: Rare shingles of a part, and the least number of parts: a pair is made once in each part it meets in.
PART_RARE, LEAST_RARE = 1 << 18, 8
#: One spare partition for so many needed.
SPARE = 5
#: Cells of a sketch.
CELLS = 128
#: Counters of shingles, by which they are rare or common, and the parts in which tasks' counts are added up.
COUNTERS, COUNTER_PARTS = 1 << 16, 64
_BAND = 1.3
_S = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6D)]
_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


class Bands:
    """Upper sizes of the bands and the differences that linking sets of a band can have."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        top = [max(1, (num + den - 1) // (2 * (den - num)))] if num < den else [1 << 40]
        while top[-1] < 1 << 40:
            top.append(max(top[-1] + 1, int(top[-1] * _BAND)))
        self.top = np.array(top, np.int64)
        self.k = 2 * self.top * (den - num) // (den + num)

    def span(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.top, n), np.searchsorted(self.top, n * self.den // self.num)

    def partitions(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many partitions a set of the band has, and how many of them are spare."""
        need = self.k[band] // 2 + 1
        spare = 1 + need // SPARE
        return need + spare, spare


class Parts:
    """Where signatures are dealt.  Bands lie one after the other, the partitions of a band too, each as long as it
    has signatures (three a set); the line is cut into parts of equal length.  A partition longer than a part is spread over
    several by signature."""

    def __init__(self, bands: Bands, sets: np.ndarray):
        """sets: how many sets sign for each band."""
        n1, _ = bands.partitions(np.arange(len(sets)))
        self.each = 3.0 * sets * (bands.k[: len(sets)] > 0)
        total = float((self.each * n1).sum())
        self.start = np.cumsum(self.each * n1) - self.each * n1
        self.size = max(1.0, min(PART_SIGS, total / LEAST_PARTS))
        self.count = int(total / self.size) + 1

    def of(self, band: np.ndarray, index: np.ndarray, sig: np.ndarray) -> np.ndarray:
        each = self.each[band]
        inside = np.where(each >= self.size, each * ((sig >> _32).astype(np.float64) / float(1 << 32)), 0.0)
        return np.minimum((self.start[band] + index * each + inside) / self.size, self.count - 1).astype(np.int64)


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash, and how many each has."""
    words = Words(*utf8(column), lower=True)
    counts = words.counts
    whole = np.flatnonzero(words.room() >= size)
    found, owner = [words.windows(size)[whole]], [words.owner()[whole]]
    for short in range(1, size):
        at = np.flatnonzero(counts == short)
        if len(at):
            found.append(windows_at(words, words.first[at], short)), owner.append(at)
    x, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    if len(x):
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])])
        x, d = x[new], d[new]
    return x, np.bincount(d, minlength=len(counts))


def windows_at(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    take = at[:, None] + np.arange(size)
    return windows(words.hashes[take].reshape(-1), size).reshape(-1, size)[:, 0]


def fingerprints(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x ^ _S[0]))])
    end = np.cumsum(n)
    return mix(total[end] - total[end - n] + n.astype(np.uint64) * _S[1]).view(np.int64)


def sketches(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall in each of CELLS cells, modulo 256.  The sum of differences
    between two rows (the shorter way round) is never more than the sets differ by."""
    cell = (mix(x ^ _S[2]) >> np.uint64(57)).astype(np.int64) + np.repeat(np.arange(len(n)) * CELLS, n)
    return (np.bincount(cell, minlength=len(n) * CELLS) & 255).astype(np.uint8).reshape(-1, CELLS)


def _cells(x: np.ndarray, d: np.ndarray, n1: np.ndarray, seed: int):
    """Content hash and count of each cell: rows are partitions of the sets one after the other."""
    base = np.cumsum(n1) - n1
    h = mix(x ^ _S[seed])
    cell = (base[d] + ((h >> _32) * n1[d].astype(np.uint64) >> _32).astype(np.int64)) * 3 + ((h & _LOW32) * np.uint64(3) >> _32).astype(np.int64)
    total = np.zeros(3 * int(n1.sum()), np.uint64)
    np.add.at(total, cell, mix(x + _S[seed + 1]))
    return total.reshape(-1, 3), np.bincount(cell, minlength=len(total)).reshape(-1, 3), np.arange(len(total) // 3) - np.repeat(base, n1)


def _pairs_of_cells(total, count, index, band):
    """Signatures (partitions x 3) and whether both cells are empty."""
    tag = mix((index + (band << 32)).astype(np.uint64) ^ _S[4])
    sig, empty = np.empty(total.shape, np.uint64), np.empty(total.shape, bool)
    for c in range(3):
        a, b = (c + 1) % 3, (c + 2) % 3
        sig[:, c] = mix(total[:, a] * _S[1] + total[:, b] * _S[3] + tag + np.uint64(c))
        empty[:, c] = count[:, a] + count[:, b] == 0
    return sig, empty


def signatures(x: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the set of each."""
    return placed_signatures(x, n, bands)[:2]


def placed_signatures(x: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets; the set, the band and the partition of each."""
    low, high = bands.span(n)
    start = np.cumsum(n) - n
    none = np.zeros(0, np.int64)
    sigs, owners, of_band, of_index = [np.zeros(0, np.uint64)], [none], [none], [none]
    for e in range(int((high - low).max(initial=0)) + 1):
        band = low + e
        who = np.flatnonzero((band <= high) & (bands.k[np.minimum(band, len(bands.k) - 1)] > 0) & (n > 0))
        if not len(who):
            continue
        size, (n1, spare) = n[who], bands.partitions(band[who])
        d = np.repeat(np.arange(len(who)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[who], size)
        y, own = x[at], np.repeat(np.arange(len(who)), n1)
        total, count, index = _cells(y, d, n1, 0)
        sig, empty = _pairs_of_cells(total, count, index, band[who][own])
        each = own[np.nonzero(~empty)[0]]
        sigs.append(sig[~empty]), owners.append(who[each]), of_band.append(band[who][each]), of_index.append(index[np.nonzero(~empty)[0]])
        light = np.bincount(own[empty.any(axis=1)], minlength=len(who)) > spare
        if light.any():
            empty &= light[own][:, None]
            lost = np.flatnonzero(light)
            again = np.full(len(who), -1)
            again[lost] = np.arange(len(lost))
            keep = again[d] >= 0
            second, _ = _pairs_of_cells(*_cells(y[keep], again[d[keep]], n1[lost], 2), np.repeat(band[who][lost], n1[lost]))
            bound = np.concatenate([[0], np.cumsum(n1[lost])])
            rows, cols = np.nonzero(empty)
            for r, c in zip(rows.tolist(), cols.tolist()):
                i = again[own[r]]
                more = mix(second[bound[i] : bound[i + 1]].reshape(-1) + sig[r, c : c + 1] * _S[5])
                sigs.append(more), owners.append(np.full(len(more), who[own[r]]))
                of_band.append(np.full(len(more), band[who[own[r]]])), of_index.append(np.full(len(more), index[r]))
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(of_band), np.concatenate(of_index)


_MEMBER = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
_PACKED = pa.schema([("part", pa.int64()), ("data", pa.binary())])
_TRIED = pa.schema([("kind", pa.int32()), ("vb", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_PAIR = pa.schema([("vb", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_COUNT = pa.schema([("slot", pa.int32()), ("n", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _members(size: int):
    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                x, n = shingle_sets(rows.column("text"), size)
                whole = sketches(x, n).tobytes()
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(fingerprints(x, n), mask=n == 0), pa.array(n, pa.int64()), pa.array([whole[i : i + CELLS] for i in range(0, len(whole), CELLS)], pa.binary())], schema=_MEMBER)

    return run


def _packed(part: np.ndarray, sig: np.ndarray, fp: np.ndarray, n: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each part: 32 bits of each signature (others that share them are pairs tried in vain, few in a part),
    then each set's name, signatures there, size and what more there is of a set."""
    order = np.lexsort((fp, part))
    part, sig, fp, n, more = part[order], sig[order].astype(np.uint32), fp[order], n[order].astype(np.uint32), [a[order] for a in more]
    starts, sizes = ranges(part)
    data = []
    for s, m in zip(starts.tolist(), sizes.tolist()):
        first, times = ranges(fp[s : s + m])
        data.append(pack(sig[s : s + m], fp[s : s + m][first], times.astype(np.uint32), n[s : s + m][first], *(a[s : s + m][first].reshape(-1) for a in more)))
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), pa.array(data, pa.binary())], schema=_PACKED)


def _sign(size: int, bands: Bands, parts: Parts):
    def run(batches):
        seen: set[int] = set()
        held, many = [], 0
        for batch in batches:
            for rows in slices(batch):
                x, n = shingle_sets(rows.column("text"), size)
                fp = fingerprints(x, n)
                fresh = np.zeros(len(n), bool)
                for i, f in enumerate(fp.tolist()):
                    if f not in seen:
                        fresh[i] = True
                        seen.add(f)
                if len(seen) > 200_000:
                    seen.clear()
                x, n, fp = x[np.repeat(fresh, n)], n[fresh], fp[fresh]
                sig, who, band, index = placed_signatures(x, n, bands)
                held.append((parts.of(band, index, sig), sig.astype(np.uint32), fp[who], n[who]))
                many += len(sig)
                if many >= PACKED_SIGS:
                    yield _packed(*(np.concatenate(a) for a in zip(*held)))
                    held, many = [], 0
        if many:
            yield _packed(*(np.concatenate(a) for a in zip(*held)))

    return run


def _home(fp: np.ndarray, parts: int) -> np.ndarray:
    return (mix(fp.view(np.uint64) ^ _S[5]) % np.uint64(parts)).astype(np.int64)


def _try(bands: Bands, parts: int):
    """Rows of kind 0: pairs a < b to try, and the place vb where sets of a group meet; of kind 1: a
    class b under a signature of many, with the least class a there."""

    def run(table: pa.Table) -> pa.Table:
        sig, fp, size = [], [], []
        for data in table.column("data").to_pylist():
            low, who, times, n = unpack(data)
            sig.append(low), fp.append(np.repeat(who, times)), size.append(np.repeat(n, times))
        sig, fp, size = np.concatenate(sig), np.concatenate(fp), np.concatenate(size).astype(np.int64)
        order = np.lexsort((fp, sig))
        sig, fp, size = sig[order], fp[order], size[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (fp[1:] != fp[:-1])])
        sig, fp, size = sig[new], fp[new], size[new]
        fit = lambda x, y: bands.den * np.minimum(x, y) >= bands.num * np.maximum(x, y)
        starts, sizes = ranges(sig)
        where = lambda f: _home(f, parts)
        rows = [np.zeros((0, 3), np.int64)]
        for m in range(2, FEW + 1):
            at = starts[sizes == m]
            if len(at):
                group = fp[at[:, None] + np.arange(m)]
                i, j = np.triu_indices(m, 1)
                sizes_ = size[at[:, None] + np.arange(m)]
                some = fit(sizes_[:, i], sizes_[:, j]).reshape(-1)
                rows.append(np.stack([np.repeat(where(group[:, 0].copy()), len(i)), group[:, i].reshape(-1), group[:, j].reshape(-1)], axis=1)[some])
        many = [np.zeros((0, 2), np.int64)]
        for s, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            group = fp[s : s + m]
            for pivot in {int(group[0]), *(int(group[np.argmin(mix(group.view(np.uint64) ^ _S[z]))]) for z in (1, 2))}:
                own = size[s : s + m]
                rest = group[(group != pivot) & fit(own, own[group == pivot][0])]
                rows.append(np.stack([where(rest), np.minimum(rest, pivot), np.maximum(rest, pivot)], axis=1))
            many.append(np.stack([np.full(m - 1, group[0]), group[1:]], axis=1))
        pairs, many = np.unique(np.concatenate(rows), axis=0), np.unique(np.concatenate(many), axis=0)
        n, k = len(pairs), len(many)
        zero = np.zeros(k, np.int64)
        return pa.Table.from_arrays([pa.array(np.repeat([0, 1], [n, k]).astype(np.int32)), pa.array(np.append(pairs[:, 0], zero)), pa.array(np.append(pairs[:, 1], many[:, 0])), pa.array(np.append(pairs[:, 2], many[:, 1]))], schema=_TRIED)

    return run


def _counted(size: int):
    """How many sets of a task hold a shingle of each counter."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for rows in slices(batch):
                total += np.bincount(_slot(shingle_sets(rows.column("text"), size)[0]), minlength=COUNTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema=_COUNT)

    return run


def _packed_counts(slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Counts by ascending counter, a row for each part of the counters."""
    part = slot.astype(np.int64) * COUNTER_PARTS // COUNTERS
    starts, sizes = ranges(part)
    data = [pack(slot[s : s + m].astype(np.uint16), n[s : s + m]) for s, m in zip(starts.tolist(), sizes.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(data, pa.binary())], schema=_PACKED)


def _counted_parts(size: int):
    """What ``_counted`` says of a task: a row for each part of the counters, not for each counter."""

    def run(batches):
        for rows in _counted(size)(batches):
            yield _packed_counts(*(c.to_numpy() for c in rows.columns))

    return run


def _added(table: pa.Table) -> pa.Table:
    """The counts of all tasks for a part of the counters."""
    total = np.zeros(COUNTERS, np.int64)
    for data in table.column("data").to_pylist():
        slot, n = unpack(data)
        total[slot] += n
    some = np.flatnonzero(total)
    return pa.Table.from_batches([_packed_counts(some, total[some])])


def _slot(x: np.ndarray) -> np.ndarray:
    return (mix(x ^ _S[2]) >> np.uint64(48)).astype(np.int64)


def _rarest(size: int, bands: Bands, rank: np.ndarray, parts: int):
    """The first shingles of each set by rarity, so many that fewer are left than a link needs, packed by part like
    signatures; a shingle is told apart by cluster."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                x, n = shingle_sets(rows.column("text"), size)
                d, sketch = np.repeat(np.arange(len(n)), n), sketches(x, n)
                order = np.lexsort((x, rank[_slot(x)], d))
                first = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) < (n - -(-bands.num * n // bands.den) + 1)[d]
                x, d = x[order][first], d[first]
                named = lambda k: rows.column(k).to_numpy(zero_copy_only=False)[d]
                h = mix(x + mix(named("cluster").view(np.uint64)))
                if len(x):
                    yield _packed((h >> _32).astype(np.int64) % parts, h, named("fp"), n[d], named("comp"), sketch[d])

    return run


def _meet(bands: Bands, parts: int, pivots: bool = False):
    """With pivots, of a shingle of more than FEW sets only the pairs with three of them, which differ from shingle to shingle.  Pairs a < b of different components under one shingle, that sizes and sketches don't rule out, and the place vb where they meet: a pair is
    dealt by the end whose component has more sets there, so these don't go along with each of the few."""

    def run(table: pa.Table) -> pa.Table:
        each = [unpack(d) for d in table.column("data").to_pylist()]
        sig = np.concatenate([e[0] for e in each])
        fp, size, comp = (np.concatenate([np.repeat(e[k], e[2]) for e in each]) for k in (1, 3, 4))
        size, flat = size.astype(np.int64), np.concatenate([e[5] for e in each]).reshape(-1, CELLS)
        name = np.repeat(np.arange(len(flat)), np.concatenate([e[2] for e in each]))
        order = np.lexsort((fp, comp, sig))
        sig, fp, size, comp, name = sig[order], fp[order], size[order], comp[order], name[order]

        def pairs(i, j, by):
            fit = (comp[i] != comp[j]) & (bands.den * np.minimum(size[i], size[j]) >= bands.num * np.maximum(size[i], size[j]))
            i, j, by = i[fit], j[fit], by[fit]
            for k in range(0, len(i), 1 << 15):
                a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                fit = _may_link(flat[name[a]], flat[name[b]], size[a] + size[b], bands)
                a, b = fp[a[fit]], fp[b[fit]]
                yield np.unique(np.stack([_home(by[k : k + (1 << 15)][fit], parts), np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)

        out, many = [np.zeros((0, 3), np.int64)], 0
        starts, sizes = ranges(sig)
        own = ranges(np.cumsum(np.concatenate([[1], (sig[1:] != sig[:-1]) | (comp[1:] != comp[:-1])])))
        same, after = np.repeat(own[1], own[1]), np.repeat(own[0] + own[1], own[1])
        end = np.repeat(starts + sizes, sizes)
        # each row with the rows of its shingle after those of its component, some at a time
        left = end - after
        if pivots:
            large = np.repeat(sizes > FEW, sizes)
            left[large] = 0
            group = np.repeat(np.arange(len(sizes)), sizes)
            for z in (1, 2, 3):
                at = np.lexsort((mix(fp.view(np.uint64) ^ mix(sig.astype(np.uint64) + _S[z])), sig))[starts][group]
                out += pairs(np.flatnonzero(large), at[large], fp[large])
        upto = np.cumsum(left)
        at = 0
        while at < len(sig):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK * 256, "right")))
            n = left[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(after[at:to], n)
            by = np.where(same[i] > same[j], fp[i], np.where(same[i] < same[j], fp[j], np.minimum(fp[i], fp[j])))
            new = list(pairs(i, j, by))
            out, many, at = out + new, many + sum(map(len, new)), to
            if many > 1 << 21:
                out, many = [np.unique(np.concatenate(out), axis=0)], 0
        found = np.unique(np.concatenate(out), axis=0)
        return pa.Table.from_arrays([pa.array(found[:, k]) for k in range(3)], schema=_PAIR)

    return run


def _links(one: np.ndarray, others: list[np.ndarray], bands: Bands) -> np.ndarray:
    """Which of the others link with the set: exact, in integers."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return bands.den * both >= bands.num * (len(one) + sizes - both)


def _forest(found: np.ndarray) -> np.ndarray:
    """As few of the links (rows a, b) as connect the same sets."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    keep = []
    for k, (a, b) in enumerate(found.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return found[keep]


def _may_link(one: np.ndarray, other: np.ndarray, both: np.ndarray, bands: Bands) -> np.ndarray:
    """Whether sketches leave no more differences than linking sets with so many shingles in both have at most."""
    gap = one - other
    return (bands.den + bands.num) * np.minimum(gap, -gap).sum(axis=1, dtype=np.int64) <= (bands.den - bands.num) * both


def _near(bands: Bands):
    """Pairs that their sizes and sketches don't rule out."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names, n = sets.column("fp").to_numpy(), sets.column("n").to_numpy()
        order = np.argsort(names)
        names, n = names[order], n[order]
        flat = np.frombuffer(b"".join(sets.column("sketch").to_pylist()), np.uint8).reshape(-1, CELLS)[order]
        out = []
        for batch in pairs.to_batches(max_chunksize=16384):
            a, b = np.searchsorted(names, batch.column("a").to_numpy()), np.searchsorted(names, batch.column("b").to_numpy())
            out.append(batch.filter(pa.array(_may_link(flat[a], flat[b], n[a] + n[b], bands))))
        return pa.Table.from_batches(out, schema=pairs.schema).select(["vb", "a", "b"]) if out else pairs.select(["vb", "a", "b"])

    return run


def _verify(size: int, bands: Bands):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        by = {}
        for rows in slices(sets):
            x, n = shingle_sets(rows.column("text"), size)
            by.update(zip(rows.column("fp").to_pylist(), np.split(x, np.cumsum(n)[:-1])))
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        swap = np.bincount(np.unique(a, return_inverse=True)[1]).max(initial=0) < np.bincount(np.unique(b, return_inverse=True)[1]).max(initial=0)
        a, b = (b, a) if swap else (a, b)
        order = np.argsort(a, kind="stable")
        a, b, out = a[order], b[order], [np.zeros((0, 2), np.int64)]
        for s, m in zip(*(r.tolist() for r in ranges(a))):
            one = by[int(a[s])]
            for t in range(s, s + m, 256):
                near = b[t : min(t + 256, s + m)]
                sizes = np.array([len(by[f]) for f in near.tolist()])
                near = near[(bands.den * np.minimum(sizes, len(one)) >= bands.num * np.maximum(sizes, len(one)))]
                if len(near):
                    near = near[_links(one, [by[f] for f in near.tolist()], bands)]
                    out.append(np.stack([np.full(len(near), a[s]), near], axis=1))
        found = _forest(np.concatenate(out))
        return pa.Table.from_arrays([pa.array(np.minimum(found[:, 0], found[:, 1])), pa.array(np.maximum(found[:, 0], found[:, 1]))], schema=_LINK)

    return run


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, key, component_key) for each row of ``docs``.

    Words of the text with A-Z in lower case; distinct shingles of ``size`` words, or all words
    as one shingle if there are fewer.  Two rows link if den * intersection >= num * union.
    class_id: the least id of the rows with an equal set; component_id: the least id that links
    reach.  Null or empty text or only blanks: no shingle, linked with nothing, both ids its own.
    Null id: takes part in links, never the least id unless no row of the component has one.
    key: a hash of id and text (``row_key``); component_key: the same for all rows of a component,
    whatever their ids, null for a row without shingles.
    Repeated rows are rows of one class.  Empty input: no rows.  Other columns are ignored.
    """
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bands = Bands(num, den)
    keyed = plain.withColumn("key", row_key())
    member = written(keyed.mapInArrow(spared(_members(size)), "doc_id long, key long, fp long, n long, sketch binary"), "members")
    parts = Parts(bands, _sets_of_bands(member, bands))
    signed = plain.select("text").mapInArrow(spared(_sign(size, bands, parts)), "part long, data binary")
    tried = written(signed.groupBy("part").applyInArrow(spared(_try(bands, parts.count)), "kind int, vb long, a long, b long"), "tried")
    one = member.where("fp is not null").groupBy("fp").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    pairs = tried.where("kind = 0").groupBy("a", "b").agg(F.min("vb").alias("vb")).withColumn("home", F.col("vb"))
    # sketches and sets meet where a pair is dealt: a pivot's pairs are dealt by their other ends
    sketched = _ends(pairs, "home").join(one.select("fp", "n", "sketch"), "fp")
    near = written(pairs.groupBy("home").cogroup(sketched.groupBy("at")).applyInArrow(spared(_near(bands)), "vb long, a long, b long"), "near")
    # a class's other least classes hang on the least of them
    hung = tried.where("kind = 1").select("a", "b").distinct().withColumn("m", F.min("a").over(Window.partitionBy("b")))
    many = written(hung.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), "many")
    freed(tried)
    # where each text is wanted; null: where what is still apart will be compared
    wanted = near.select("vb", F.explode(F.array("a", "b")).alias("fp")).union(many.select(F.lit(None).cast("long"), F.explode(F.array("a", "b"))))
    wanted = wanted.groupBy("fp").agg(F.collect_set("vb").alias("homes"), F.max(F.col("vb").isNull()).alias("many"))
    # only texts that may be wanted are dealt by key, rows that repeat once a task
    chosen = written(one.select("fp", "key").join(wanted, "fp"), "wanted")
    some = marked(keyed.select("key", "text"), "key", chosen, "may").where("may").drop("may").dropDuplicates(["key"])
    whole = written(some.join(chosen, "key").select("fp", "homes", "many", "text"), "texts")
    links = written(_linked(near, whole.select(F.explode("homes").alias("at"), "fp", "text"), size, bands), "links")
    roots = components(links)
    if not many.isEmpty():
        roots = _settle(many, links, roots, whole, size, bands)
    freed(near, many, chosen, whole, links)
    low = member.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    rooted = low.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "class_id", "component_id", F.col("root").alias("component_key"))
    return member.join(classes, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "key", "component_key")


def _sets_of_bands(member: DataFrame, bands: Bands) -> np.ndarray:
    """How many rows sign for each band."""
    # as many rows as there are spans of bands
    place = lambda n: F.size(F.filter(F.array(*[F.lit(int(t)) for t in bands.top]), lambda t: t < n))
    spans = member.where("fp is not null").groupBy(place(F.col("n")).alias("low"), place(F.floor(F.col("n") * bands.den / bands.num)).alias("high")).count().collect()
    sets = np.zeros(len(bands.top), np.int64)
    for low, high, n in spans:
        sets[low : high + 1] += n
    return sets


def _ends(pairs: DataFrame, at: str) -> DataFrame:
    return pairs.select(F.col(at).alias("at"), F.explode(F.array("a", "b")).alias("fp")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Links (a, b) among the pairs; texts: (at, fp, text)."""
    return pairs.groupBy("vb").cogroup(texts.groupBy("at")).applyInArrow(spared(_verify(size, bands)), "a long, b long").distinct()


def _settle(many: DataFrame, links: DataFrame, roots: DataFrame, whole: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Roots after the sets of a cluster, which signatures with many classes hold together, have met by rare shingles."""
    cluster = written(components(many).select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "clusters")
    rank, made = None, [cluster]
    # most of what can be linked is linked by pivots; then all pairs of what is still apart
    for pivots in (True, False):
        node = cluster.join(roots.select(F.col("node").alias("fp"), F.col("root").alias("comp")), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        node = written(node, "nodes")
        apart = node.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        open_ = written(node.join(apart.select("cluster"), "cluster").select("fp", "cluster", "comp"), "open")
        made += [node, open_]
        if open_.isEmpty():
            break
        texts = written(marked(whole.where("many").select("fp", "text"), "fp", open_, "may").where("may").drop("may").join(open_, "fp"), "apart")
        if rank is None:
            count = texts.select("text").mapInArrow(spared(_counted_parts(size)), "part long, data binary").groupBy("part").applyInArrow(spared(_added), "part long, data binary").collect()
            times = np.zeros(COUNTERS, np.int64)
            for slot, n in (unpack(r["data"]) for r in count):
                times[slot] = n
            rank = np.argsort(np.argsort(times, kind="stable")).astype(np.uint16)
            parts = max(LEAST_RARE, int(times.sum()) * (bands.den - bands.num) // bands.den // PART_RARE + 1)
        rare = texts.mapInArrow(spared(_rarest(size, bands, rank, parts)), "part long, data binary")
        met = rare.groupBy("part").applyInArrow(spared(_meet(bands, max(LEAST_PARTS, parts), pivots)), "vb long, a long, b long")
        near = written(met.groupBy("a", "b").agg(F.min("vb").alias("vb")), "met")
        more = written(_linked(near, _ends(near, "vb").join(texts.select("fp", "text"), "fp"), size, bands), "more")
        links = links.union(more)
        roots = components(links)
        made += [texts, near, more]
    freed(*made)
    return roots
