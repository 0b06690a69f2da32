"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks; one block is sent in each slot.  Weights are fractions, not
rounded beyond what a float is (0.1 is a tenth).  Block j (from 1) of a source of weight w is released at floor((j - 1) / w) and due
at ceil(j / w); of the released blocks the one due first is sent.  On one line of slots with
weights that add up to 1 every block meets its window, so at any slot a source has had less than
one block more or less than its share.  The schedule repeats after as many slots as the weights' common
denominator, hence one period, or all slots if they are fewer, is a table joined to all blocks.

When a source runs out, a new phase starts with the weights of those left.  Every row is sent once.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of a period that weights are rounded to, where that is asked for.
PERIOD = 512
#: Rows of a table that goes into the plan as a literal, at most.
LITERAL_ROWS = 50_000
#: Buckets that a source's rows are ranked in, at most: a source may hold most rows.
RANK_BUCKETS = 4096
OTHER = "__other__"


def parts_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole parts for each weight by largest remainder; each gets one at least."""
    total = sum(weights.values())
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {k: Fraction(w) * period / Fraction(total) for k, w in weights.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k)):
        if sum(out.values()) >= period:
            break
        out[k] += 1
    return out


def exact(weight) -> Fraction:
    """The simplest fraction that a float stands for, its last bits being rounding (0.03 + 0.006 is 9/250)."""
    own = Fraction(weight)
    for digits in range(1, 17 if isinstance(weight, float) else 0):
        near = own.limit_denominator(10**digits)
        if abs(near - own) <= 4 * math.ulp(weight):
            return near
    return own


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole parts in the proportion of the weights, the least there are."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    shares = {k: exact(w) for k, w in weights.items()}
    scale = math.lcm(*(v.denominator for v in shares.values()))
    parts = {k: int(v * scale) for k, v in shares.items()}
    common = math.gcd(*parts.values())
    return {k: v // common for k, v in parts.items()}


def schedule(parts: dict[str, int], slots: int | None = None) -> list[str]:
    """One period, or its first ``slots``: the source sent in each slot, earliest due block among
    the released first."""
    period = sum(parts.values())
    waiting = [(0, k, 1) for k in parts]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(period if slots is None else min(period, slots)):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // parts[k]), k, j))
        due, k, j = heapq.heappop(ready)
        if due < slot + 1:
            raise AssertionError("a block missed its window")
        out.append(k)
        heapq.heappush(waiting, (j * period // parts[k], k, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """Weights are exact, or rounded to parts of ``period``.  Spans (phase, source, first block, blocks, first slot, parts, slots a period) and patterns
    (phase, source, index in the period, slot in the period): bounded by sources and the period or the blocks, if they are fewer."""
    left, sent = {k: n for k, n in blocks.items() if n}, {k: 0 for k in blocks}
    spans, patterns, slot, phase = [], [], 0, 0
    while left:
        own = {k: weights[k] for k in left}
        parts = exact_parts(own) if period is None else parts_of(own, max(period, len(left)))
        # a source ends within all blocks, so a longer period isn't gone through
        order = schedule(parts, sum(left.values()))
        whole = min(left[k] // parts[k] for k in left)
        take = {k: whole * parts[k] for k in left}
        length = whole * len(order)
        if all(take[k] < left[k] for k in left):
            for k in order:
                take[k] += 1
                length += 1
                if take[k] == left[k]:
                    break
        at: dict[str, int] = {}
        for place, k in enumerate(order if whole else order[:length]):
            patterns.append((phase, k, at.get(k, 0), place))
            at[k] = at.get(k, 0) + 1
        for k in left:
            spans.append((phase, k, sent[k], take[k], slot, parts[k], sum(parts.values())))
            sent[k] += take[k]
        left = {k: left[k] - take[k] for k in left if left[k] > take[k]}
        slot += length
        phase += 1
    return spans, patterns


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver rows as a plan without Python: parsed from one JSON literal, unless they are many."""
    if len(rows) > LITERAL_ROWS:
        return spark.createDataFrame(rows, schema)
    fields = T._parse_datatype_string(schema)
    text = "[" + ",".join("{" + ",".join(f'"{f.name}":' + (str(v) if not isinstance(v, str) else _quoted(v)) for f, v in zip(fields, r)) + "}" for r in rows) + "]"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(fields))))


def _quoted(text: str) -> str:
    import json

    return json.dumps(text)


def lane(source: Column, weights: dict[str, float]) -> Column:
    """The source itself if it has a weight, else OTHER (null too)."""
    return F.when(source.isin(*[k for k in weights if k != OTHER]), source).otherwise(F.lit(OTHER))


def mix_positions(docs: DataFrame, weights: dict[str, float], block_rows: int = 64, seed: int = 0, id: str = "doc_id", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lane, phase, block, slot, position) for each row of ``docs``.

    lane: the row's source, or OTHER for null and for sources without a weight (their common
    weight is ``weights[OTHER]``, else the mean); block: its place among the lane's blocks of
    ``block_rows`` rows; slot: when the block is sent; position: the row's place in the mix, from
    0 and gapless.  In a lane rows come in hash order; repeated rows and null ids all are placed,
    ties in any order.  Empty input: no rows.
    """
    spark = docs.sparkSession
    weights = {k: exact(w) for k, w in weights.items()}
    weights = {OTHER: sum(weights.values()) / len(weights), **weights}
    base = docs.select(F.col(id).cast("long").alias("doc_id"), lane(F.col(source), weights).alias("lane"), *[F.col(k) for k in keep])
    order = F.xxhash64(F.lit(seed), "doc_id")
    total = {r["lane"]: r["n"] for r in base.groupBy("lane").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, min(RANK_BUCKETS, sum(total.values()) // 256))
    rows = base.withColumn("h", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sized = rows.groupBy("lane", "bucket").agg(F.count("*").alias("n"))
    before = sized.select("lane", "bucket", (F.sum("n").over(_window("lane", "bucket")) - F.col("n")).alias("before"))
    # lanes x RANK_BUCKETS rows at most
    ranked = rows.join(F.broadcast(before), ["lane", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(_window(("lane", "bucket"), "h", "doc_id")) - 1)
    blocks = {k: -(-n // block_rows) for k, n in total.items()}
    spans, patterns = phases(blocks, weights)
    # a slot sends one block of some lane; all are full but each lane's last, which ends a phase
    span = _table(spark, spans, "phase int, lane string, first long, blocks long, at long, parts long, period long")
    pattern = _table(spark, patterns, "phase int, lane string, index long, place long")
    blocked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    placed = blocked.join(F.broadcast(span), "lane").where((F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("blocks")))
    own = F.col("block") - F.col("first")
    placed = placed.withColumn("turn", F.floor(own / F.col("parts"))).withColumn("index", own - F.col("turn") * F.col("parts"))
    placed = placed.join(F.broadcast(pattern), ["phase", "lane", "index"])
    slot = F.col("at") + F.col("turn") * F.col("period") + F.col("place")
    out = placed.withColumn("slot", slot)
    # rows that the last block of an ended lane lacked, over all lanes: a constant
    ends = ",".join(f'{{"e":{_last_slot(k, blocks[k] - 1, spans, patterns)},"m":{blocks[k] * block_rows - total[k]}}}' for k in total)
    gaps = F.from_json(F.lit(f"[{ends}]"), "array<struct<e:long,m:long>>")
    missing = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + F.when(g["e"] < F.col("slot"), g["m"]).otherwise(F.lit(0)))
    position = F.col("slot") * block_rows + (F.col("rank") - F.col("block") * block_rows) - missing
    return out.select("doc_id", *keep, "lane", "phase", "block", "slot", position.cast("long").alias("position"))


def _last_slot(k: str, block: int, spans: list[tuple], patterns: list[tuple]) -> int:
    for phase, lane_, first, n, at, parts, period in spans:
        if lane_ == k and first <= block < first + n:
            turn, index = divmod(block - first, parts)
            return at + turn * period + next(p for f, s, i, p in patterns if f == phase and s == k and i == index)
    raise AssertionError("a block without a slot")


def _window(by, *order):
    from pyspark.sql import Window

    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)


def mixed(docs: DataFrame, weights: dict[str, float], block_rows: int = 64, seed: int = 0, id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with all its columns, in the order of the mix: ranges of positions become
    partitions, sorted inside, so files written from it follow the mix."""
    names = docs.columns
    kept = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({"doc_key": F.col(f"c{names.index(id)}"), "source_key": F.col(f"c{names.index(source)}")})
    placed = mix_positions(kept, weights, block_rows, seed, "doc_key", "source_key", keep=tuple(f"c{i}" for i in range(len(names))))
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
