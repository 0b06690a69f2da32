"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words.  A word goes if a window over it also starts in a
document with a smaller id.  Comparing every window would shuffle one row a word.  Instead only
runs of ``window - period + 1`` words at places p with ``p % period`` in a difference cover are
hashed: for any two places i and j some d < period has both i + d and j + d in the cover, so two
equal windows share an anchor at the same distance from their starts.  Anchors found in one
document alone rule out most windows; the rest are extended to whole windows and compared.

Steps (each one grouped by hash, with what one task can settle settled there):
1. map: anchors; those shared inside a slice of rows become one marker, so a passage that a
   third of the documents share sends a few rows a task.
2. by anchor hash: which anchors occur in several rows.
3. by bucket of rows: windows over shared anchors; of equal windows only the least document's go on.
4. by window hash: the least document of each window.
5. by bucket of rows: kept words.
Equality is that of 64-bit hashes of the words.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import groups_for, row_key, spread
from ._text import Words, pack, ranges, slices, spared, texts, unpack, utf8

#: Period and cover: every difference modulo 7 is one of two members of {0, 1, 3}.
PERIOD, COVER = 7, (0, 1, 3)
SLICE = 4 << 20
_PACKED = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_SENT = "part long, kind int, data binary"


def _deal(part: np.ndarray, arrays: list[np.ndarray], kind: int):
    order = np.argsort(part, kind="stable")
    starts, sizes = ranges(part[order])
    for s, n in zip(starts.tolist(), sizes.tolist()):
        at = order[s : s + n]
        yield int(part[at[0]]), kind, pack(*(a[at] for a in arrays))


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _PACKED.field(i).type) for i in range(3)], schema=_PACKED)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, sizes = ranges(keys)
    return keys[starts], sizes.astype(np.uint32)


def _keys(table) -> np.ndarray:
    return table.column("key").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("key").to_numpy()


def _find_anchors(window: int, parts: int, buckets: int):
    length = window - PERIOD + 1

    def run(batches):
        cover = np.isin(np.arange(PERIOD), COVER)
        for batch in batches:
            for rows in slices(batch, limit=SLICE):
                words = Words(*utf8(rows.column("text")))
                if not len(words):
                    continue
                key = _keys(rows)
                known = rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                owner = words.owner()
                place = np.arange(len(words)) - words.first[owner]
                fit = (words.room() >= length) & cover[place % PERIOD] & (known & (words.counts >= window))[owner]
                at = np.flatnonzero(fit)
                if not len(at):
                    continue
                h, k, p = words.windows(length)[at] >> np.uint64(16), key[owner[at]], place[at].astype(np.uint32)
                order = np.argsort(h, kind="stable")
                starts, sizes = ranges(h[order])
                several = np.minimum.reduceat(k[order], starts) != np.maximum.reduceat(k[order], starts)
                shared = np.empty(len(at), bool)
                shared[order] = np.repeat(several, sizes)
                out = []
                one, marks = ~shared, h[order][starts[several]]
                part = (h[one] % np.uint64(parts)).astype(np.int64)
                seq = np.argsort(part, kind="stable")
                h1, k1, p1 = h[one][seq], k[one][seq], p[one][seq]
                starts, sizes = ranges(part[seq])
                for s, n in zip(starts.tolist(), sizes.tolist()):
                    who, times = _runs(k1[s : s + n])
                    x = h1[s : s + n]
                    out.append((int(part[seq[s]]), 0, pack((x >> np.uint64(32)).astype(np.uint16), x.astype(np.uint32), who, times, p1[s : s + n])))
                if len(marks):
                    out += _deal((marks % np.uint64(parts)).astype(np.int64), [marks], 1)
                    out += [(parts + b, t, d) for b, t, d in _deal(k[shared] % buckets, [k[shared], p[shared]], 2)]
                yield _batch(out)

    return run


def _shared_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, keys, places, marked, out = [], [], [], [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            got = unpack(data)
            if kind == 2:
                out.append((int(got[0][0] % buckets), 0, data))
            elif kind == 1:
                hashes.append(got[0]), keys.append(np.zeros(len(got[0]), np.int64)), places.append(np.zeros(len(got[0]), np.uint32)), marked.append(np.ones(len(got[0]), bool))
            else:
                hashes.append((got[0].astype(np.uint64) << np.uint64(32)) | got[1]), keys.append(np.repeat(got[2], got[3])), places.append(got[4]), marked.append(np.zeros(len(got[1]), bool))
        if hashes:
            h, k, p, m = map(np.concatenate, (hashes, keys, places, marked))
            order = np.argsort(h, kind="stable")
            starts, sizes = ranges(h[order])
            k, p, m = k[order], p[order], m[order]
            several = (np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)) | np.logical_or.reduceat(m, starts)
            hit = np.repeat(several, sizes) & ~m
            out += _deal(k[hit] % buckets, [k[hit], p[hit]], 0)
        return pa.Table.from_batches([_batch(out)])

    return run


def _flags(table: pa.Table, kind: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    got = [unpack(d)[:2] for d in table.column("data").to_pylist()]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    k, p = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.argsort(k, kind="stable")
    return k[order], p[order]


def _placed(key: np.ndarray, k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with these keys: row and word place of each flag."""
    low, high = np.searchsorted(k, key), np.searchsorted(k, key, "right")
    n = high - low
    row = np.repeat(np.arange(len(key)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return row, p[at].astype(np.int64)


def _windows(window: int, parts: int, buckets: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        k, p = _flags(flags)
        found = []
        for rows in slices(docs, limit=SLICE) if len(k) else ():
            key = _keys(rows)
            row, place = _placed(key, k, p)
            if not len(row):
                continue
            words = Words(*utf8(rows.column("text")))
            mark = np.zeros(len(words), bool)
            for d in range(PERIOD):
                mark[(words.first[row] + place - d)[place >= d]] = True
            at = np.flatnonzero(mark & (words.room() >= window))
            owner = words.owner()[at]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found.append((words.windows(window)[at], ids[owner], key[owner], (at - words.first[owner]).astype(np.uint32)))
        out = []
        if found:
            h, d, key, place = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((d, h))
            h, d, key, place = h[order], d[order], key[order], place[order]
            starts, sizes = ranges(h)
            later = d > np.repeat(d[starts], sizes)
            out += [(parts + b, t, x) for b, t, x in _deal(key[later] % buckets, [key[later], place[later]], 2)]
            rest = ~later
            h, d, key, place = h[rest], d[rest], key[rest], place[rest]
            order = np.lexsort((place, key))
            h, d, key, place = h[order], d[order], key[order], place[order]
            out += _deal((h % np.uint64(parts)).astype(np.int64), [key, place, h, d], 0)
        return pa.Table.from_batches([_batch(out)])

    return run


def _later_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        out, got = [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            arrays = unpack(data)
            if kind == 2:
                out.append((int(arrays[0][0] % buckets), 0, data))
            else:
                got.append(arrays)
        if got:
            key, place, h, d = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((d, h))
            starts, sizes = ranges(h[order])
            key, place, d = key[order], place[order], d[order]
            later = d > np.repeat(d[starts], sizes)
            out += _deal(key[later] % buckets, [key[later], place[later]], 0)
        return pa.Table.from_batches([_batch(out)])

    return run


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def _kept(window: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        k, p = _flags(flags)
        out = []
        for rows in slices(docs, limit=SLICE):
            row, place = _placed(_keys(rows), k, p)
            by: dict[int, list] = {}
            for r, q in zip(row.tolist(), place.tolist()):
                by.setdefault(r, []).append(q)
            counts, gone, kept, spans = [], [], [], []
            for i, text in enumerate(texts(*utf8(rows.column("text")))):
                words, runs = text.split(), []
                counts.append(len(words))
                if i in by:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(by[i])
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    cover = np.cumsum(edge[:-1]) > 0
                    starts, sizes = ranges(cover)
                    runs = [{"first": s, "last": s + n - 1} for s, n in zip(starts.tolist(), sizes.tolist()) if cover[s]]
                    words = list(compress(words, ~cover))
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
                spans.append(runs)
            out.append(pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, _KEPT.field(4).type)], schema=_KEPT))
        return pa.Table.from_batches(out, schema=_KEPT)

    return run


def remove_repeats(docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) for each row of ``docs``.

    kept: the words left, joined by one space; removed: runs of removed words, as first and last
    place.  Windows are judged on the input.  Null or empty text: no words.  Null id: the row is
    neither cut nor a reason to cut another.  Rows that repeat an id are judged each by its own
    text and don't count as smaller than one another.  Empty input: no rows.  Other columns of
    ``docs`` are ignored, whatever their names.
    """
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD}")
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = groups_for(plain)
    # rows without an id get no flags, so any bucket does: a third of all rows may be such
    keyed = plain.withColumn("key", row_key()).withColumn("bucket", F.when(F.col("doc_id").isNull(), spread(n)).otherwise(F.pmod("key", F.lit(n).cast("long"))))
    by_row = keyed.groupBy("bucket")
    found = plain.withColumn("key", row_key()).mapInArrow(spared(_find_anchors(window, n, n)), _SENT)
    near = found.groupBy("part").applyInArrow(spared(_shared_anchors(n)), _SENT).groupBy("part")
    whole = by_row.cogroup(near).applyInArrow(spared(_windows(window, n, n)), _SENT)
    later = whole.groupBy("part").applyInArrow(spared(_later_windows(n)), _SENT).groupBy("part")
    return by_row.cogroup(later).applyInArrow(spared(_kept(window)), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,last:long>>")
