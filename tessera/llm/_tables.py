"""Written intermediate tables, sizes of inputs and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import freed, shared_folder, written

__all__ = ["components", "freed", "groups_for", "marked", "row_key", "shared_folder", "spread", "written"]

#: Text bytes that one packed group stands for, and the least number of groups.
GROUP_BYTES, LEAST_GROUPS = 24 << 20, 64


def groups_for(docs: DataFrame, text: str = "text", size: int = GROUP_BYTES) -> int:
    """How many packed groups of ``size`` bytes of text to deal work into."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_GROUPS, -(-total // size))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


#: Bits of a bitmap for each value, and of one of its rows.
BITS_EACH, ROW_BITS = 16, 1 << 15


def marked(rows: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if the long in ``column`` is not in that column of ``values``; true for
    all that are, and for about one in BITS_EACH of the others.  What is sent along are two bytes a value."""
    n = max(1, -(-values.count() * BITS_EACH // ROW_BITS))
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(n * ROW_BITS).cast("long"))
    at, place = F.floor(h / ROW_BITS).cast("long"), (h % ROW_BITS).cast("long")
    bits = values.select(at.alias("__at"), place.alias("__place")).groupBy("__at").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("__at", at).join(F.broadcast(bits), "__at", "left")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).select(*rows.columns, name)


def spread(n: int) -> Column:
    """A bucket of 0 to n - 1 for each row, by doc_id, text and input partition: rows equal in id and text are dealt to as
    many buckets as there are input partitions.  A task that is run again deals its rows alike."""
    return F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n).cast("long"))


#: A node with more than one in so many of the edges is a hub: there are fewer of them than this.
HUBS = 1000


def _with_least(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with the least m of u from ``low`` (u, m, n): hubs, of which there are fewer than HUBS, are sent along,
    so that no task gets all edges of one."""
    hub = F.col("n") * HUBS > total
    marked = rows.join(F.broadcast(low.where(hub).select("u", F.col("m").alias("hm"))), "u", "left")
    others = marked.where("hm is null").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return marked.where("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(others.select("u", "v", "m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the smallest node
    that can be reached.  Alternates large-star and small-star steps, each a grouped minimum
    and a join, and writes each round to the shared folder.  No edges: no rows."""
    now = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), "edges")
    least = [F.min("v").alias("m"), F.count("*").alias("n")]
    sign, count = None, now.count()
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(*least).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), low, 2 * count).select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = written(large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), "large")
        low = down.groupBy("u").agg(*least)
        small = _with_least(down, low, count).select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y").where("x <> y")
        last, now = now, written(small.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "star")
        freed(last, down)
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 30) - 1)))).first())
        if new == sign:
            break
        sign, count = new, new[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
