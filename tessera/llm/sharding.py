"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Groups go from large to small, each into the bin that has the least room of those it fits in,
found through a balanced tree of (room, bin); a new bin opens where none fits.  That order only
depends on sizes, so the packing works on the histogram of group sizes: a run of equal groups fills
the tightest bin as far as it fits, then the next.  Sizes of EXACT and more are rounded up to their
leading bits, which bounds the histogram by some 100,000 classes whatever the data; it is all
that the driver sees.  Groups then find their bin by class and rank, rows by group.

With a given number of shards a group of more than the mean has a shard of its own; for the rest the
capacity is the least for which the packing needs no more than the other shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written

EXACT = 1 << 12
RANK_BUCKETS = 4096
#: A group with more than one in so many rows is hot.
HOT = 1000


class Tree:
    """A balanced search tree (treap) of (room, bin) pairs."""

    def __init__(self):
        self.root = None
        self._seed = 88172645463325252

    def _priority(self) -> int:
        self._seed ^= (self._seed << 13) & 0xFFFFFFFFFFFFFFFF
        self._seed ^= self._seed >> 7
        self._seed ^= (self._seed << 17) & 0xFFFFFFFFFFFFFFFF
        return self._seed

    def _split(self, node, key):
        """Nodes under key, the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(), None, None]), high)

    def take(self, room: int) -> tuple[int, int] | None:
        """Remove and return the pair with the least room of ``room`` or more."""
        low, high = self._split(self.root, (room, -1))
        node, parent = high, None
        while node is not None and node[2] is not None:
            node, parent = node[2], node
        if node is None:
            self.root = low
            return None
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._join(low, high)
        return node[0]


def pack(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first, end, bin) for (size, groups) by falling size; None if more than ``most``
    bins open.  A size over the capacity is an error."""
    tree, opened, out = Tree(), 0, []
    for size, n in sizes:
        if size > capacity:
            raise ValueError(f"a group of {size} exceeds the capacity {capacity}")
        first = 0
        while first < n:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found = (capacity, opened)
                opened += 1
            room, bin_ = found
            fits = min(n - first, room // size)
            out.append((size, first, first + fits, bin_))
            first += fits
            if room - fits * size:
                tree.add((room - fits * size, bin_))
    return out


def pack_into(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Groups above the mean of what is left get a bin each, by falling size; the rest the packing of
    least capacity that needs no more than the other bins."""
    total, alone = sum(s * n for s, n in sizes), []
    for size, n in sizes:
        first = 0
        while first < n and size * shards > total:
            alone.append((size, first, first + 1, len(alone)))
            first, total, shards = first + 1, total - size, shards - 1
        if first < n:
            break
    else:
        return alone
    rest = [(size, n - first), *sizes[[s for s, _ in sizes].index(size) + 1 :]]
    low = high = -(-total // shards)
    step = max(1, low >> 12)
    while (found := pack(rest, high, shards)) is None:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        mid = (low + high) // 2
        tried = pack(rest, mid, shards)
        low, high, found = (mid + 1, high, found) if tried is None else (low, mid, tried)
    return alone + [(s, a + first * (s == size), b + first * (s == size), bin_ + len(alone)) for s, a, b, bin_ in found]


def _size_class(size):
    """The size itself under EXACT, else rounded up to its 12 leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) - 11)).cast("long")
    return F.when(size < EXACT, size).otherwise(F.ceil(size.cast("double") / step).cast("long") * step)


def _ranked(rows: DataFrame, by: str, order: list, salt, name: str, buckets: int) -> DataFrame:
    """rows with ``name``: gapless place from 0 among rows of ``by``, ranked in salted buckets."""
    rows = rows.withColumn("rb", F.pmod(salt, F.lit(buckets)).cast("int"))
    sized = rows.groupBy(by, "rb").agg(F.count("*").alias("rn"))
    w = Window.partitionBy(by).orderBy("rb").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select(by, "rb", F.coalesce(F.sum("rn").over(w), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(by, "rb").orderBy(*order))
    return rows.join(before, [by, "rb"]).withColumn(name, (F.col("before") + place - 1).cast("long")).drop("rb", "before")


def shard(docs: DataFrame, shards: int | None = 24, capacity: int | None = None, overhead: int = 8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``.

    size: UTF-8 bytes of the text plus ``overhead``; rows of equal text are a group and share a
    shard (null is a text of its own, of 0 bytes and CRC 0).  Give ``shards`` for about equal sizes
    in at most that many, or ``capacity`` for as few as best fit finds.  slot: gapless from 0 in
    each shard; ties in any order.  Null ids are placed.  Empty input: no rows.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    # the texts are read once: what follows works on their sizes and digests
    rows = written(docs.select(F.col(id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + overhead).alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b"")).alias("digest")), "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = written(groups.select("digest", "n", _size_class(F.col("bytes")).alias("class")), "groups")
    seen = groups.groupBy("class").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).collect()
    sizes = sorted(((r["class"], r["groups"]) for r in seen), reverse=True)
    runs = pack(sizes, capacity) if capacity else pack_into(sizes, shards)
    total = sum(r["n"] for r in seen)
    buckets = max(1, min(RANK_BUCKETS, total // 512))
    bins = spark.createDataFrame(runs, "run_class long, first long, last long, shard int").coalesce(1)
    ranked = _ranked(groups, "class", ["digest"], F.xxhash64("digest"), "rank", buckets)
    # runs: at most the classes and one more for each bin that a run fills
    held = ranked.join(F.broadcast(bins), (F.col("class") == F.col("run_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    held = written(held.select("digest", "n", "shard"), "bins")
    # fewer than HOT groups have more than one in HOT of the rows: they are sent along, so no task gets all copies
    hot = held.where(F.col("n") * HOT > total)
    known = rows.join(F.broadcast(hot.select("digest", "shard")), "digest", "left")
    rest = known.where("shard is null").drop("shard").join(held.where(F.col("n") * HOT <= total).select("digest", "shard"), "digest")
    placed = known.where("shard is not null").unionByName(rest.select(known.columns)).drop("digest")
    return _ranked(placed, "shard", ["doc_id", "text_crc32"], F.xxhash64("doc_id", "text_crc32"), "slot", buckets).select("doc_id", "size", "text_crc32", "shard", "slot")
