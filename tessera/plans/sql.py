"""DuckDB SQL for the same relations, as lists of common table expressions."""

from __future__ import annotations

from .data import CONTEXT, ESTIMATORS, REG_BINS, REG_CONTEXT


def h(seed: int, tag: str, *columns: str) -> str:
    return f"md5(concat_ws(':', '{seed}', '{tag}', {', '.join(columns)}))"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select


def allocate(name: str, sizes: str, budget: str, min_one: bool = False) -> str:
    return f"""
{name}_a AS (SELECT grp, n, CASE WHEN {min_one} AND n > 0 AND (SELECT count(*) FROM {sizes} WHERE n > 0) <= {budget} THEN 1 ELSE 0 END AS f FROM {sizes}),
{name}_b AS (SELECT *, n - f AS room, sum(n - f) OVER () AS rooms, least({budget}, sum(n) OVER ()) - sum(f) OVER () AS lft FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN rooms > 0 THEN lft::DOUBLE * room::DOUBLE / greatest(rooms, 1)::DOUBLE ELSE 0::DOUBLE END AS share FROM {name}_b),
{name}_d AS (SELECT *, floor(share)::BIGINT AS base_, lft - sum(floor(share)::BIGINT) OVER () AS rest FROM {name}_c),
{name} AS (SELECT grp, n, (f + base_ + CASE WHEN row_number() OVER (ORDER BY share - base_ DESC, grp) <= rest AND base_ < room THEN 1 ELSE 0 END)::BIGINT AS take FROM {name}_d)
"""


def digest(id: str) -> str:
    part = lambda at: f"sum(('0x' || substr(md5({id}::VARCHAR), {at}, 12))::UBIGINT)::VARCHAR"
    return f"concat_ws(':', count(*)::VARCHAR, {part(1)}, {part(13)})"


def cover(name: str, chosen: str, rows: str, by: str, seed: int = 0) -> str:
    """Contexts (by, row_id, protected) with a row of each missing class swapped in."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in by.split(","))
    hash_ = lambda t: h(seed, "cover", *[f"{'k' if t == 'b' else t}.{k.strip()}" for k in by.split(",")], f"{t}.row_id")
    return f"""
{name}_c AS (SELECT c.*, b.y, {hash_('c')} AS hh, count(*) OVER (PARTITION BY {by}) AS size FROM {chosen} c JOIN {rows} b USING (row_id)),
{name}_k AS (SELECT * FROM (SELECT DISTINCT {by}, size FROM {name}_c) k CROSS JOIN (SELECT DISTINCT y FROM {rows}) l WHERE size >= (SELECT count(DISTINCT y) FROM {rows}) AND NOT EXISTS (SELECT 1 FROM {name}_c c WHERE {on('c', 'k')} AND c.y = l.y)),
{name}_n AS (SELECT {by}, row_id FROM (SELECT {', '.join('k.' + x.strip() for x in by.split(','))}, b.row_id, row_number() OVER (PARTITION BY {', '.join('k.' + x.strip() for x in by.split(','))}, k.y ORDER BY {hash_('b')}, b.row_id) AS r FROM {name}_k k JOIN {rows} b ON b.y = k.y) WHERE r = 1),
{name}_s AS (SELECT {by}, row_id, row_number() OVER (PARTITION BY {by} ORDER BY protected, hh, row_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY {by}, y ORDER BY protected DESC, hh DESC, row_id DESC) AS z FROM {name}_c) WHERE z > 1),
{name}_o AS (SELECT s.* FROM {name}_s s JOIN (SELECT {by}, count(*) AS m FROM {name}_k GROUP BY {by}) m ON {on('s', 'm')} WHERE r <= m),
{name} AS (SELECT {by}, row_id FROM {name}_c c WHERE NOT EXISTS (SELECT 1 FROM {name}_o o WHERE {on('o', 'c')} AND o.row_id = c.row_id) UNION ALL SELECT {by}, row_id FROM {name}_n)"""


VECTORS = "base AS (SELECT vec_id AS row_id, label AS y, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"


def split(src: str, name: str, seed: int, strata: bool = True, size: float = 0.3) -> str:
    if not strata:
        return f"""
{name} AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {h(seed, 'split', 'row_id')}, row_id) <= ceil({size}::DOUBLE * (SELECT count(*) FROM {src})) THEN 'test' ELSE 'train' END AS part FROM {src})"""
    return f"""
{name}_z AS (SELECT y AS grp, count(*) AS n FROM {src} GROUP BY y),
{allocate(name + '_t', name + '_z', f'(SELECT ceil({size}::DOUBLE * count(*))::BIGINT FROM {src})').strip()},
{name} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY {h(seed, 'split', 'row_id')}, row_id) <= take THEN 'test' ELSE 'train' END AS part FROM {src} s JOIN {name}_t ON grp = y)"""


def context(src: str, name: str, budget: int, estimators: int, seed: int = 0) -> str:
    return f"""
{name} AS (SELECT est, row_id FROM (SELECT e.est, t.row_id, row_number() OVER (PARTITION BY e.est ORDER BY {h(seed, 'est', 'e.est', 't.row_id')}, t.row_id) AS rn
  FROM {src} t CROSS JOIN (SELECT unnest(range({estimators}))::INTEGER AS est) e) WHERE rn <= {budget})"""


def centroid(train: str, test: str, ctx: str, name: str, estimators: int = ESTIMATORS) -> str:
    return f"""
{name}_l AS (SELECT row_id, y, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos FROM {train}),
{name}_m AS (SELECT c.est, l.y AS cls, l.pos, avg(l.x) AS m FROM {name}_l l JOIN {ctx} c USING (row_id) WHERE (l.pos + c.est) % {estimators} <> 0 GROUP BY c.est, l.y, l.pos),
{name}_q AS (SELECT row_id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS pos FROM {test}),
{name}_o AS (SELECT q.row_id, m.est, m.cls, -sum((q.x - m.m) * (q.x - m.m)) / count(*) AS logit FROM {name}_q q JOIN {name}_m m USING (pos) GROUP BY q.row_id, m.est, m.cls),
{name} AS (SELECT g.row_id, g.est, k.cls, coalesce(o.logit, -50::DOUBLE) AS logit FROM (SELECT DISTINCT row_id, est FROM {name}_o) g
  CROSS JOIN (SELECT DISTINCT y AS cls FROM {train}) k LEFT JOIN {name}_o o ON o.row_id = g.row_id AND o.est = g.est AND o.cls = k.cls)"""


#: train, test and outs of the centroid model.
CLF = [VECTORS, split("base", "parts", 0), "train AS (SELECT * FROM parts WHERE part = 'train')", "test AS (SELECT * FROM parts WHERE part = 'test')", context("train", "ctx", CONTEXT, ESTIMATORS), centroid("train", "test", "ctx", "outs")]
#: the same on a part of the training rows: vtrain, vtest, vouts.
VAL = ["vbase AS (SELECT row_id, y, f FROM train)", split("vbase", "vparts", 1), "vtrain AS (SELECT * FROM vparts WHERE part = 'train')", "vtest AS (SELECT * FROM vparts WHERE part = 'test')", context("vtrain", "vctx", CONTEXT, ESTIMATORS), centroid("vtrain", "vtest", "vctx", "vouts")]


def scores(pred: str, name: str) -> str:
    """log_loss, accuracy, roc_auc and ece of pred (row_id, cls, p) against tr (row_id, y): (metric, value)."""
    n = name
    return f"""
{n}_t AS (SELECT row_id, cls AS c, p AS conf FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS z FROM {pred}) WHERE z = 1),
{n}_u AS (SELECT cls, p, (y = cls)::INTEGER AS hit, rank() OVER (PARTITION BY cls ORDER BY p) + (count(*) OVER (PARTITION BY cls, p) - 1) / 2.0::DOUBLE AS r FROM {pred} JOIN tr USING (row_id)),
{n}_v AS (SELECT CASE WHEN sum(hit) > 0 AND sum(hit) < count(*) THEN (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit)::DOUBLE * (count(*) - sum(hit))) END AS area FROM {n}_u GROUP BY cls),
{n}_e AS (SELECT count(*) AS n, avg((c = y)::INTEGER) AS acc, avg(conf) AS conf FROM {n}_t JOIN tr USING (row_id) GROUP BY least(floor(conf * 15), 14)),
{n} AS (SELECT 'log_loss' AS metric, round(-avg(ln(least(greatest(p, 1e-15), 1))), 6) AS value FROM {pred} JOIN tr ON tr.row_id = {pred}.row_id AND tr.y = {pred}.cls
  UNION ALL SELECT 'accuracy', round(avg((c = y)::INTEGER), 6) FROM {n}_t JOIN tr USING (row_id) UNION ALL SELECT 'roc_auc', round(avg(area), 6) FROM {n}_v UNION ALL SELECT 'ece', round(sum(n * abs(acc - conf)) / sum(n), 6) FROM {n}_e)"""


def t_tail2(t: str) -> str:
    """Two-sided tail of Student's t with two degrees of freedom."""
    return f"1 - abs({t}) / sqrt(2 + {t} * {t})"


def proba(out: str, name: str, keys: str = "row_id, est", temperature: str = "1::DOUBLE") -> str:
    return f"""
{name}_z AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY {keys})) / {temperature}) AS z FROM {out}),
{name} AS (SELECT *, z / sum(z) OVER (PARTITION BY {keys}) AS p FROM {name}_z)"""


P = proba("outs", "pr")
MEAN = "pred AS (SELECT row_id, cls, avg(p) AS p FROM pr GROUP BY row_id, cls)"
SHOW = "SELECT row_id, cls, round(p, 6) AS p FROM pred"


def renorm(src: str, name: str) -> str:
    return f"{name} AS (SELECT row_id, cls, CASE WHEN abs(s - 1) <= 1e-12 THEN p WHEN s > 1e-12 THEN p / s ELSE coalesce(q, p) END AS p FROM (SELECT *, sum(p) OVER (PARTITION BY row_id) AS s FROM {src}))"


PART = "rbase AS (SELECT p_partkey AS row_id, p_retailprice AS y, p_brand AS c0, (p_size % 5)::VARCHAR AS c1, substr(p_type, 1, 4) AS c2 FROM part)"
_AT = ", ".join(f"{i}::DOUBLE / {REG_BINS}" for i in range(REG_BINS + 1))
REG = [
    PART,
    split("rbase", "rparts", 0, strata=False),
    "train AS (SELECT * FROM rparts WHERE part = 'train')",
    "test AS (SELECT * FROM rparts WHERE part = 'test')",
    f"e0 AS (SELECT list_sort(list_distinct(quantile_cont(y, [{', '.join(str(i / REG_BINS) for i in range(REG_BINS + 1))}]))) AS q, min(y) AS a, max(y) AS b FROM train)",
    "e1 AS (SELECT list_concat([a - 0.1::DOUBLE * (b - a)], q[2:len(q) - 1], [b + 0.1::DOUBLE * (b - a)]) AS e FROM e0)",
    "bins AS (SELECT i::INTEGER - 1 AS bin, round(e[i], 6) AS lo, round(e[i + 1], 6) AS hi FROM (SELECT e, unnest(range(1, len(e))) AS i FROM e1))",
    context("train", "ctx", REG_CONTEXT, 3),
    "own AS (SELECT c.est, [t.c0, t.c1, t.c2][c.est + 1] AS cell, b.bin FROM train t JOIN ctx c USING (row_id) JOIN bins b ON (t.y >= b.lo OR b.bin = (SELECT min(bin) FROM bins)) AND (t.y < b.hi OR b.bin = (SELECT max(bin) FROM bins)))",
    "cnt AS (SELECT est, cell, bin, count(*) AS n FROM own GROUP BY est, cell, bin)",
    "tot AS (SELECT est, cell, sum(n) AS t FROM cnt GROUP BY est, cell)",
    "outs AS (SELECT g.row_id, g.est, b.bin, (coalesce(n, 0) + 0.01::DOUBLE) / (coalesce(t, 0) + 0.01::DOUBLE * (SELECT count(*) FROM bins)) AS p FROM (SELECT row_id, est, [c0, c1, c2][est + 1] AS cell FROM test CROSS JOIN (SELECT unnest(range(3))::INTEGER AS est)) g CROSS JOIN bins b LEFT JOIN cnt USING (est, cell, bin) LEFT JOIN tot USING (est, cell))",
]


def quantiles(src: str, name: str, levels: list[float], keys: str = "row_id") -> str:
    return f"""
{name}_r AS (SELECT {keys}, bin, lo, hi, p, sum(p) OVER (PARTITION BY {keys} ORDER BY bin) AS cum FROM (SELECT * EXCLUDE (p), p / sum(p) OVER (PARTITION BY {keys}) AS p FROM {src} JOIN bins USING (bin))),
{name}_h AS (SELECT *, unnest([{', '.join(f'{x}::DOUBLE' for x in levels)}]) AS level FROM {name}_r),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY {keys}, level ORDER BY (CASE WHEN cum >= level THEN 0 ELSE 1 END), (CASE WHEN cum >= level THEN bin ELSE -bin END)) AS k FROM {name}_h),
{name} AS (SELECT {keys}, level, lo + least(greatest((level - (cum - p)) / p, 0), 1) * (hi - lo) AS q FROM {name}_f WHERE k = 1)"""
