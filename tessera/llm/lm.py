"""Stupid-backoff scores with bigram and unigram count tables over the whole corpus.

Each bucket of rows explodes its texts into bigrams and words and keeps one row for each
distinct one (so the commonest word pair is one row a bucket).  Those go, by hash, to the
part of the count table that owns them, as one packed row for each part that a bucket has n-grams of, so rows
are never more than distinct n-grams of buckets; the part sums the counts of all buckets and sends each
bucket the totals of the n-grams it asked for; the bucket joins them to its exploded n-grams
and sums each document's log scores.  Nothing is gathered on the driver.

A document is scored against all others: its own counts are taken off first, so a bigram
that no other document has backs off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import LEAST_GROUPS, spread
from ._text import Words, mix, pack, ranges, slices, spared, unpack, utf8

ALPHA = 0.4
#: Text bytes of a bucket; scoring holds some 60 times that.
BUCKET_BYTES = 6 << 20
_TAG = np.uint64(0x5851F42D4C957F2D)
_SENT = "part long, bucket long, data binary"
_PACKED = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("n_unseen", pa.int64()), ("log_score", pa.float64())])


def _words(docs: pa.Table):
    """Hashes of all words of a bucket, and row bounds."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows in slices(docs, limit=4 << 20):
        words = Words(*utf8(rows.column("text")))
        hashes.append(words.hashes), counts.append(words.counts)
    return np.concatenate(hashes), np.concatenate(counts)


def _grams(hashes: np.ndarray, counts: np.ndarray):
    """Words, then bigrams (each ends at a word that isn't its row's first), with their rows."""
    owner = np.repeat(np.arange(len(counts)), counts)
    again = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    pairs = mix(hashes[again - 1] * _TAG + hashes[again]) | np.uint64(1)
    return owner, again, hashes & ~np.uint64(1), pairs


def _part(grams: np.ndarray, parts: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _thin(gaps: np.ndarray) -> list[np.ndarray]:
    """Gaps between sorted hashes, without the bytes that are zero in all of them."""
    return [gaps] if len(gaps) and int(gaps.max()) >> 56 else [(gaps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gaps >> np.uint64(32)).astype(np.uint16), (gaps >> np.uint64(48)).astype(np.uint8)]


def _thick(arrays: list[np.ndarray]) -> np.ndarray:
    return arrays[0] if len(arrays) == 1 else arrays[0].astype(np.uint64) | arrays[1].astype(np.uint64) << np.uint64(32) | arrays[2].astype(np.uint64) << np.uint64(48)


def _measure(batches):
    """Bytes and words of each batch."""
    for batch in batches:
        for rows in slices(batch):
            data, offsets = utf8(rows.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([len(Words(data, offsets, hashed=False))], pa.int64())], names=["bytes", "words"])


def _ask(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        _, _, words, pairs = _grams(*_words(docs))
        distinct, times = np.unique(np.concatenate([words, pairs]), return_counts=True)
        bound = np.searchsorted(_part(distinct, parts), np.arange(parts + 1))
        rows, asked = [], np.flatnonzero(np.diff(bound)).tolist()
        for i in asked:
            own = slice(bound[i], bound[i + 1])
            rows.append(pack(times[own].astype(np.uint32), *_thin(np.diff(distinct[own], prepend=np.uint64(0)))))
        bucket = docs.column("bucket")[0].as_py()
        return pa.Table.from_arrays([pa.array(asked, pa.int64()), pa.array([bucket] * len(asked), pa.int64()), pa.array(rows, pa.binary())], schema=_PACKED)

    return run


def _count():
    def run(table: pa.Table) -> pa.Table:
        asked = [unpack(d) for d in table.column("data").to_pylist()]
        grams = [np.cumsum(_thick(a[1:])) for a in asked]
        whole, back = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(whole), np.int64)
        np.add.at(totals, back, np.concatenate([a[0] for a in asked]).astype(np.int64))
        at = np.cumsum([0] + [len(g) for g in grams])
        kind = np.uint32 if not len(totals) or totals.max() < 1 << 32 else np.int64
        out = [pack(totals[back[a:b]].astype(kind)) for a, b in zip(at[:-1], at[1:])]
        return pa.Table.from_arrays([table.column("part"), table.column("bucket"), pa.chunked_array([pa.array(out, pa.binary())])], schema=_PACKED)

    return run


def _own(owner: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """How often each gram occurs in its own row."""
    _, back, times = np.unique(owner * size + index, return_inverse=True, return_counts=True)
    return times[back]


def _score(alpha: float, n_all: int):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        hashes, sizes = _words(docs)
        owner, again, words, pairs = _grams(hashes, sizes)
        distinct, back = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        got = [unpack(d) for _, d in sorted(zip(counts.column("part").to_pylist(), counts.column("data").to_pylist()))]
        totals = np.concatenate([g[0].astype(np.int64) for g in got] or [np.zeros(0, np.int64)])
        if len(totals) != len(distinct):
            raise RuntimeError("a bucket got totals of other rows than it asked for")
        left = totals[back] - _own(np.concatenate([owner, owner[again]]), back, max(1, len(distinct)))
        one, two = left[: len(words)].astype(float), left[len(words) :].astype(float)
        rest = (n_all - sizes)[owner].astype(float)
        seen = one > 0
        score = np.where(seen, one, 1.0) / np.where(seen, np.maximum(rest, 1), rest + 1)
        backed = np.zeros(len(words), bool)
        backed[again] = two == 0
        score[again] = np.where(two > 0, two / np.maximum(one[again - 1], 1), alpha * score[again])
        log = np.bincount(owner, np.log(score), len(sizes)) if len(words) else np.zeros(len(sizes))
        fresh = np.bincount(owner, ~seen & (backed | (np.arange(len(words)) == np.cumsum(np.append(0, sizes))[owner])), len(sizes)) if len(words) else np.zeros(len(sizes))
        off = np.bincount(owner, backed, len(sizes)) if len(words) else np.zeros(len(sizes))
        ids = docs.column("doc_id")
        return pa.Table.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(off.astype(np.int64)), pa.array(fresh.astype(np.int64)), pa.array(log.astype(float))], schema=_SCORED)

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backed_off, n_unseen, log_score) for each row of ``docs``.

    Counts c leave out the row itself; N is the number of words of all other rows.  The first
    word scores c(w) / N; each later one c(vw) / c(v), or if c(vw) is 0, alpha * c(w) / N.  A word
    with c(w) = 0 counts as 1 / (N + 1) in place of c(w) / N.  log_score is the sum of natural
    logarithms; n_backed_off counts words that backed off, n_unseen those without any count.
    Null or empty text: no words, score 0.  Null ids are kept.  Each repeated row is a row of its
    own (and evidence for its copies).  Empty input: no rows.  Other columns are ignored.
    """
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = plain.select("text").mapInArrow(spared(_measure), "bytes long, words long").agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    n, n_all = max(LEAST_GROUPS, -(-(total["bytes"] or 0) // BUCKET_BYTES)), total["words"] or 0
    keyed = plain.withColumn("bucket", spread(n)).groupBy("bucket")
    asked = keyed.applyInArrow(spared(_ask(n)), _SENT)
    told = asked.groupBy("part").applyInArrow(spared(_count()), _SENT).groupBy("bucket")
    return keyed.cogroup(told).applyInArrow(spared(_score(alpha, n_all)), "doc_id long, n_words long, n_backed_off long, n_unseen long, log_score double")
