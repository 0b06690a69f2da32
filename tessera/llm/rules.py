"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of each whole text are counted in one pass.  From those of labelled rows the learner
grows one conjunction of thresholds after another (the condition of most information gain
first), prunes it on rows held out, and takes away what it covers.  The list becomes one Spark
conditional expression, so applying it is plain column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import Words, ranges, slices, spared, texts, utf8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct"]
#: Rates that conditions are about: numerator, denominator.
RATES = {"chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines_per_line": ("n_dup_lines", "n_lines"), "repeats_per_word": ("n_repeat_words", "n_words"), "upper_per_char": ("n_upper", "word_chars"), "bangs_per_word": ("n_bangs", "n_words"), "distinct_per_word": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines")}
_SYMBOL, _UPPER, _BANG = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_BANG[33] = True


def _count(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=n)


def _stats(batches):
    for batch in batches:
        for rows in slices(batch):
            data, offsets = utf8(rows.column("text"))
            words, n = Words(data, offsets), rows.num_rows
            owner = words.owner()
            bounds = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
            lead = (data & 0xC0) != 0x80
            total = np.concatenate([[0], np.cumsum(lead)])
            chars = np.concatenate([[0], np.cumsum(total[words.ends] - total[words.starts])])
            assert len(bounds) == len(chars)
            # words of 3-word windows found twice or more
            at = np.flatnonzero(words.room() >= 3)
            h, o = words.windows(3)[at], owner[at]
            order = np.lexsort((h, o))
            hs, os_ = h[order], o[order]
            new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])]) if len(hs) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(hs)))
            twice = at[order[np.repeat(size > 1, size)]]
            mark = np.zeros(len(words) + 3, bool)
            for k in range(3):
                mark[twice + k] = True
            repeat = _count(mark[: len(words)], words.first)
            dup, lines = [], []
            for text in texts(data, offsets):
                own = [x for x in text.split(b"\n") if x and not x.isspace()]
                lines.append(len(own)), dup.append(len(own) - len(set(own)))
            yield pa.RecordBatch.from_arrays(rows.columns + [pa.array(np.asarray(x, np.int64)) for x in (words.counts, chars[words.first[1:]] - chars[words.first[:-1]], _count(_SYMBOL[data], offsets), dup, repeat, lines, _count(_UPPER[data], offsets), _count(_BANG[data], offsets), _distinct(owner, words.hashes, n))], names=rows.schema.names + COUNTS)


def text_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS of each row's whole text (null: none); base_failed by fixed limits."""
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _counted(plain, text="text").drop("text")


def _counted(rows: DataFrame, text: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    stats = rows.mapInArrow(spared(_stats), f"{fields}, " + ", ".join(f"{c} long" for c in COUNTS))
    return stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rate(name: str) -> Column:
    over, under = RATES[name]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Rule:
    """Rejects where all conditions (rate, above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            out = out & ((_rate(name) >= F.lit(limit)) if above else (_rate(name) <= F.lit(limit)))
        return out

    def holds(self, rates: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(rates.values()))), bool)
        for name, above, limit in self.conditions:
            out &= rates[name] >= limit if above else rates[name] <= limit
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<='} {t:.6g}" for n, a, t in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def keeps(self) -> Column:
        """The list as one conditional expression: the first rule that holds rejects."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _grow(rates, bad, rows, limits) -> list[tuple[str, bool, float]]:
    conditions, inside = [], rows.copy()
    while len(conditions) < 4:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not n or not p:
            break
        best, gain = None, 1e-9
        for name, cuts in limits.items():
            for cut in cuts:
                for above in (True, False):
                    held = inside & (rates[name] >= cut if above else rates[name] <= cut)
                    q = (held & bad).sum()
                    if q and (g := q * (np.log2(q / held.sum()) - np.log2(p / (p + n)))) > gain:
                        best, gain = (name, above, float(cut)), g
        if best is None:
            break
        conditions.append(best)
        inside &= rates[best[0]] >= best[2] if best[1] else rates[best[0]] <= best[2]
    return conditions


def learn(rates: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray, precision: float = 0.99, cuts: int = 24, most: int = 16) -> DecisionList:
    """Sequential covering over rows with these rates: rules for the bad ones.  A rule stands if
    it covers 3 bad rows or more and at least ``precision`` of what it covers is bad, in all rows
    and in those held out.  No bad or no good rows: an empty list."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most and (left & bad & ~held_out).sum() >= 3 and (~bad).any():
        limits = {k: np.unique(np.quantile(v[left & bad], np.linspace(0, 1, cuts))) for k, v in rates.items()}
        grown = _grow(rates, bad, left & ~held_out, limits)
        best, value = None, -2.0
        for n in range(1, len(grown) + 1):
            held = Rule(tuple(grown[:n])).holds(rates) & left
            p, q = (held & held_out & bad).sum(), (held & held_out & ~bad).sum()
            if (v := (p - q) / (p + q) if p + q else -1.0) > value:
                best, value = Rule(tuple(grown[:n])), v
        if best is None:
            break
        held = best.holds(rates) & left
        good = held & ~bad
        if (held & bad).sum() < 3 or good.sum() > (1 - precision) * held.sum() or (good & held_out).sum() > (1 - precision) * max(1, (held & held_out).sum()):
            break
        rules.append(best)
        left &= ~held
    return DecisionList(tuple(rules))


def learn_rules(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, id: str = "doc_id", text: str = "text", label: str = "quality") -> DecisionList:
    """A decision list from labelled rows (label 0: bad; null: not used).

    Fitted on at most ``train_rows`` labelled ids, the least by hash; a few thousand fix the
    thresholds, and the sample goes to the driver, so it is bounded.  An id with several labels
    counts as bad if one of them is 0.  Rows that fail the fixed limits aren't used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("doc_id")).agg((F.min(label) == 0).alias("bad"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = plain.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    stats = text_statistics(some).where("not base_failed").join(F.broadcast(sample), "doc_id")
    rows = stats.orderBy(F.xxhash64("doc_id"), *["doc_id", *COUNTS]).limit(train_rows).select("bad", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)) == 0).alias("out"), *[_rate(k).alias(k) for k in RATES]).toPandas()
    if not len(rows):
        return DecisionList(())
    return learn({k: rows[k].to_numpy(float) for k in RATES}, rows["bad"].to_numpy(bool), rows["out"].to_numpy(bool))


def judge(docs: DataFrame, rules: DecisionList, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) for each row: kept is false if base_failed, else what
    the list says.  Null or empty text: no words, so base_failed.  Null ids are kept; repeated
    rows are judged each; no rows in, no rows out; other columns are ignored."""
    return text_statistics(docs, id, text).withColumn("kept", ~F.col("base_failed") & rules.keeps())


def keep(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass."""
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*[f"c{i}" if i != at else "text" for i in range(len(names))])
    counted = _counted(plain, "text").where(~F.col("base_failed") & rules.keeps())
    return counted.select(*plain.columns).toDF(*names)
