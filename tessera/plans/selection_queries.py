"""Queries of row selection, encoders, splits and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seeding import ranked, hash_order
from ..operators import cluster as C
from ..operators import encode as E
from ..operators import grid as G
from ..operators import routing as R
from ..operators import selection as S
from ..operators import subsets as U
from ..operators.allocate import allocate
from . import data, sql
from .sql import VECTORS, h, with_

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


ORD = "base AS (SELECT o_orderkey AS row_id, o_orderstatus AS y FROM orders)"
PRI = "base AS (SELECT o_orderkey AS row_id, o_totalprice AS y FROM orders)"
LAB = "base AS (SELECT doc_id AS row_id, quality AS y FROM labels)"
_SZ = "sz AS (SELECT y AS grp, count(*) AS n FROM base GROUP BY y)"


def _take(tag: str, src: str = "base", grp: str = "y", take: str = "t") -> str:
    return f"SELECT row_id FROM (SELECT b.row_id, take, row_number() OVER (PARTITION BY {grp} ORDER BY {h(0, tag, 'b.row_id')}, b.row_id) AS rn FROM {src} b JOIN {take} ON grp = {grp}) WHERE rn <= take"


def _sel(method, source, budget, **options):
    return lambda s, d: S.select_context(source(s, d), method, budget, 0, **options).select("row_id")


query("sel_random", with_(ORD, select=f"SELECT row_id FROM base ORDER BY {h(0, 'random', 'row_id')}, row_id LIMIT 500"))(_sel("random", data.orders, 500))
query("sel_stratified", with_(ORD, _SZ, sql.allocate("t", "sz", "501", True), select=_take("stratified")))(_sel("stratified", data.orders, 501))
_EDGE = lambda n: "ed AS (SELECT list_distinct(quantile_cont(y, [" + ", ".join(str(i / n) for i in range(1, n)) + "])) AS e FROM base), gb AS (SELECT row_id, y, len(list_filter(e, lambda x: x <= y)) AS g FROM base CROSS JOIN ed), sg AS (SELECT g AS grp, count(*) AS n FROM gb GROUP BY g)"
query("sel_stratified_bins", with_(PRI, _EDGE(100), sql.allocate("t", "sg", "250"), select=_take("stratified", "gb", "g")))(_sel("stratified", data.prices, 250, task="regression"))
query("sel_balanced", with_(LAB, "sz AS (SELECT y AS grp, count(*) AS n, " + h(0, "group", "y") + " AS g FROM base GROUP BY y)", "lv AS (SELECT grp, g, unnest(range(1, least(n, 61) + 1)) AS level FROM sz)", "t AS (SELECT grp, count(*) AS take FROM (SELECT grp, row_number() OVER (ORDER BY level, g) AS p FROM lv) WHERE p <= 61 GROUP BY grp)", select=_take("balanced")))(_sel("balanced", data.graded, 61))
query("sel_nested", with_(ORD, f"r AS (SELECT row_id, row_number() OVER (ORDER BY {h(0, 'nest', 'row_id')}, row_id) AS rn FROM base)", select="SELECT row_id, b::INTEGER AS budget FROM r CROSS JOIN (SELECT unnest([64, 128, 256, 512]) AS b) WHERE rn <= b"))(lambda s, d: S.nested(data.orders(s, d), [64, 128, 256, 512], 0))
query("sel_full", "SELECT o_orderkey AS row_id FROM orders")(_sel("full", data.orders, 1))
query("sel_canary_shuffled", with_(ORD, f"s AS (SELECT * FROM base ORDER BY {h(0, 'random', 'row_id')}, row_id LIMIT 300)", f"a AS (SELECT row_id, row_number() OVER (ORDER BY {h(0, 'left', 'row_id')}, row_id) AS rn FROM s)", f"b AS (SELECT y, row_number() OVER (ORDER BY {h(0, 'right', 'row_id')}, row_id) AS rn FROM s)", select="SELECT row_id, y FROM a JOIN b USING (rn)"))(lambda s, d: S.canary_shuffled(data.orders(s, d), 300, 0))
query("sel_resampled", with_(LAB, f"i AS (SELECT row_id, row_number() OVER (ORDER BY {h(0, 'slot', 'row_id')}, row_id) AS rn FROM base)", "c AS (SELECT unnest([0, 1, 2]) AS copy)", f"w AS (SELECT copy, (('0x' || substr({h(0, 'boot', 'rn', 'copy')}, 1, 12))::UBIGINT % (SELECT count(*) FROM base))::BIGINT + 1 AS draw FROM i CROSS JOIN c)", "hit AS (SELECT i.row_id, copy FROM w JOIN i ON i.rn = w.draw)", select="SELECT 'full' AS context, row_id, 0 AS copy FROM i UNION ALL SELECT 'dup3', row_id, copy FROM i CROSS JOIN c UNION ALL SELECT 'boot3', row_id, copy FROM hit UNION ALL SELECT 'boot1', row_id, copy FROM hit WHERE copy = 0"))(lambda s, d: S.resampled(data.graded(s, d), 3, 0))
query("sel_uncertainty_mix")(_sel("uncertainty_mix", data.vectors, 100))


# clustering, unrolled: hash-ordered start, five rounds, ties to the lower centre
def _lloyd(src: str, name: str, k: str, tag: str, by: str = "0") -> str:
    """Centres {name} (g, c, v) for each group expression ``by`` of ``src``; k may use g."""
    out = [f"{name}_p AS (SELECT * FROM (SELECT {by} AS g, row_id, f, row_number() OVER (PARTITION BY {by} ORDER BY {h(0, tag, 'row_id')}, row_id) AS rn FROM {src}) WHERE rn <= 4000)", f"{name}_0 AS (SELECT g, (rn - 1)::INTEGER AS c, f AS v FROM {name}_p WHERE rn <= {k})"]
    for i in range(C.ROUNDS):
        out.append(f"{name}_n{i} AS (SELECT g, row_id, f, c FROM (SELECT p.g, p.row_id, p.f, z.c, row_number() OVER (PARTITION BY p.g, p.row_id ORDER BY list_sum(list_transform(list_zip(p.f, z.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), z.c) AS k FROM {name}_p p JOIN {name}_{i} z ON z.g = p.g) WHERE k = 1)")
        out.append(f"{name}_a{i} AS (SELECT g, c, list(m ORDER BY pos) AS v FROM (SELECT g, c, pos, avg(x) AS m FROM (SELECT g, c, unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM {name}_n{i}) GROUP BY g, c, pos) GROUP BY g, c)")
        out.append(f"{name}_{i + 1} AS (SELECT z.g, z.c, coalesce(a.v, z.v) AS v FROM {name}_{i} z LEFT JOIN {name}_a{i} a ON a.g = z.g AND a.c = z.c)")
    return ",\n".join(out) + f",\n{name} AS (SELECT * FROM {name}_{C.ROUNDS})"


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def _near(src: str, centres: str, name: str, by: str = "0") -> str:
    return f"{name} AS (SELECT * FROM (SELECT s.*, z.c, {_d2('s.f', 'z.v')} AS d2, row_number() OVER (PARTITION BY s.row_id ORDER BY {_d2('s.f', 'z.v')}, z.c) AS k FROM {src} s JOIN {centres} z ON z.g = {by}) WHERE k = 1)"


@query("cluster_assign", with_(VECTORS, _lloyd("base", "ce", "6", "kmeans"), _near("base", "ce", "na"), select="SELECT row_id, c, round(d2, 6) AS d2 FROM na"))
def cluster_assign(s, d):
    rows = data.vectors(s, d)
    return C.nearest(rows, C.fit(rows, 6, 0)).select("row_id", "c", F.round("d2", 6).alias("d2"))


_TV = sql.allocate("t", "sz", "60", True)
query("sel_kmeans_stratified", with_(VECTORS, _SZ, _TV, _lloyd("base", "ce", "(SELECT take FROM t WHERE grp = g)", "kmeans", "y"), _near("base", "ce", "na", "s.y"), f"o AS (SELECT row_id, y, (row_number() OVER (PARTITION BY y, c ORDER BY d2, row_id) > 1)::INTEGER AS late FROM na)", f"q AS (SELECT o.row_id, take, row_number() OVER (PARTITION BY y ORDER BY late, {h(0, 'fill', 'o.row_id')}, o.row_id) AS rn FROM o JOIN t ON grp = y)", select="SELECT row_id FROM q WHERE rn <= take"))(_sel("kmeans_stratified", data.vectors, 60))
_CELL = "cl AS (SELECT grp, c AS cell, count(*) AS n FROM na JOIN t ON grp = y GROUP BY grp, c), cs AS (SELECT cl.grp, cell, cl.n, take AS own, take::DOUBLE * cl.n::DOUBLE / sum(cl.n) OVER (PARTITION BY cl.grp)::DOUBLE AS share FROM cl JOIN t ON t.grp = cl.grp), ct AS (SELECT grp, cell, floor(share)::BIGINT + CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY share - floor(share) DESC, cell) <= own - sum(floor(share)::BIGINT) OVER (PARTITION BY grp) AND floor(share) < n THEN 1 ELSE 0 END AS take FROM cs)"
_CK = "(SELECT greatest(1, least(4, take // 5, n)) FROM t WHERE grp = g)"
query("sel_representative", with_(VECTORS, _SZ, sql.allocate("t", "sz", "150", True), _lloyd("base", "ce", _CK, "cells", "y"), _near("base", "ce", "na", "s.y"), _CELL, f"q AS (SELECT na.row_id, take, row_number() OVER (PARTITION BY y, c ORDER BY {h(0, 'representative', 'na.row_id')}, na.row_id) AS rn FROM na JOIN ct ON grp = y AND cell = c)", select="SELECT row_id FROM q WHERE rn <= take"))(_sel("representative", data.vectors, 150, n_cells=4))
query("sel_embedding_kmeans", with_(VECTORS, _lloyd("base", "ce", "20", "embedding"), _near("base", "ce", "na"), f"o AS (SELECT row_id, {h(0, 'fill', 'row_id')} AS hh, (row_number() OVER (PARTITION BY c ORDER BY d2, row_id) > 1)::INTEGER AS late, (row_number() OVER (PARTITION BY y ORDER BY {h(0, 'fill', 'row_id')}, row_id) > 1)::INTEGER AS cover FROM na)", select="SELECT row_id FROM o ORDER BY cover, late, hh, row_id LIMIT 20"))(_sel("embedding_kmeans", data.vectors, 20))

# one context for each estimator
_E3 = "e AS (SELECT unnest([0, 1, 2])::INTEGER AS est)"


def _sub(method, source, budget, estimators=3, **options):
    return lambda s, d: U.subsets(source(s, d), method, budget, estimators, 0, **options)


def _each(tag: str, grp: str = "", take: str = "500", src: str = "base b") -> str:
    part = f", {grp}" if grp else ""
    return f"SELECT est, row_id FROM (SELECT est, b.row_id, {take} AS lim, row_number() OVER (PARTITION BY est{part} ORDER BY {h(0, tag, 'est', 'b.row_id')}, b.row_id) AS rn FROM {src} CROSS JOIN e) WHERE rn <= lim"


query("sub_perest_random", with_(ORD, _E3, select=_each("est")))(_sub("perest_random", data.orders, 500))
query("sub_perest_partition", with_(ORD, _E3, f"r AS (SELECT row_id, row_number() OVER (ORDER BY {h(0, 'partition', 'row_id')}, row_id) AS rn FROM base)", "n AS (SELECT count(*) AS n FROM base)", "k AS (SELECT n, CASE WHEN 3 * 500 >= n THEN n / 3::DOUBLE ELSE 500 END AS step FROM n)", select="SELECT est, row_id FROM r CROSS JOIN e CROSS JOIN k WHERE (((rn - 1 - floor(est * step)::BIGINT) % n) + n) % n < 500"))(_sub("perest_partition", data.orders, 500))
query("sub_perest_stratified", with_(ORD, _E3, _SZ, sql.allocate("t", "sz", "301", True), select=_each("perest_stratified", "y", "take", "base b JOIN t ON grp = y")))(_sub("perest_stratified", data.orders, 301))
query("sub_perest_representative", with_(VECTORS, _E3, _SZ, sql.allocate("t", "sz", "100", True), _lloyd("base", "ce", _CK, "cells", "y"), _near("base", "ce", "na", "s.y"), _CELL, select=_each("perest_representative", "y, c", "take", "na b JOIN ct ON grp = y AND cell = c")))(_sub("perest_representative", data.vectors, 100, n_cells=4))
query("sub_perest_kcenter")(_sub("perest_kcenter", data.vectors, 40))
query("sub_cluster_experts", with_(VECTORS, _lloyd("base", "ce", "3", "experts"), _near("base", "ce", "na"), f"x AS (SELECT n.row_id, n.y, n.c AS own, z.c AS est, {_d2('n.f', 'z.v')} AS dd, {h(0, 'experts', 'z.c', 'n.row_id')} AS hh FROM na n CROSS JOIN ce z)", "v AS (SELECT *, (row_number() OVER (PARTITION BY est, y ORDER BY hh, row_id) > 1)::INTEGER AS cover FROM x)", "o AS (SELECT *, row_number() OVER (PARTITION BY est ORDER BY cover, (own <> est)::INTEGER, CASE WHEN own = est THEN hh END NULLS FIRST, CASE WHEN own <> est THEN dd END NULLS FIRST, row_id) AS p FROM v)", select="SELECT est, row_id FROM o WHERE p <= 120"))(_sub("cluster_experts", data.vectors, 120))
query("sub_context_key", with_(ORD, _E3, "x AS (" + _each("est") + ")", select="SELECT est, sha256(" + sql.digest('row_id') + ") AS key, count(*) AS n FROM x GROUP BY est"))(lambda s, d: U.context_key(U.subsets(data.orders(s, d), "perest_random", 500, 3, 0)))


def _pool(n: int, k: int, estimators: int, tag: str, src: str, name: str) -> list[str]:
    """The same draws in SQL for a table of n rows."""
    plan, out, tail, parts = U.passes(n, k, estimators), [], None, []
    for number in sorted({p[0] for p in plan}):
        own = [p for p in plan if p[0] == number]
        anti = f" WHERE row_id NOT IN (SELECT row_id FROM {tail})" if tail else ""
        out.append(f"{name}{number} AS (SELECT row_id, row_number() OVER (ORDER BY {h(0, f'{tag}{number}', 'row_id')}, row_id) AS rn FROM {src}{anti})")
        parts += [f"SELECT {e}::INTEGER AS est, row_id FROM {name}{number} WHERE rn > {a} AND rn <= {b}" for _, e, a, b in own]
        last = own[-1]
        nxt = [p for p in plan if p[0] == number + 1]
        tail = None
        if nxt and nxt[0][1] == last[1]:
            tail = f"{name}t{number}"
            out.append(f"{tail} AS (SELECT row_id FROM {name}{number} WHERE rn > {last[2]} AND rn <= {last[3]})")
    return [*out, f"{name} AS ({' UNION ALL '.join(parts)})"]


# fixed tables, whose sizes the SQL may name: 25 nations and 1,000 rows of them
NAT = "base AS (SELECT n_nationkey::BIGINT AS row_id, (n_nationkey % 3)::VARCHAR AS y FROM nation)"


def _nations(s, d):
    return data.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), (F.col("n_nationkey") % 3).cast("string").alias("y"))


query("builtin_balanced", with_(NAT, *_pool(25, 7, 9, "pool", "base", "po"), select="SELECT est, row_id FROM po"))(lambda s, d: U.emulate_subsample(_nations(s, d), 7, "balanced", 9, 0))
_CLS = [(v, n, t) for v, n, t in (("0", 9, 3), ("1", 8, 3), ("2", 8, 2))]


def _strat() -> str:
    ctes, names = [NAT], []
    for v, n, t in _CLS:
        ctes.append(f"b{v} AS (SELECT row_id FROM base WHERE y = '{v}')")
        ctes += _pool(n, t, 5, f"pool:{v}:", f"b{v}", f"q{v}_")
        names.append(f"SELECT est, row_id FROM q{v}_")
    return with_(*ctes, select=" UNION ALL ".join(names))


query("builtin_stratified", _strat())(lambda s, d: U.emulate_subsample(_nations(s, d), 8, "stratified", 5, 0))
query("builtin_auto", _strat())(lambda s, d: U.emulate_subsample(_nations(s, d), 8, "auto", 5, 0))
query("builtin_majority_downsample", with_(NAT, "b0 AS (SELECT row_id FROM base WHERE y = '0')", *_pool(9, 4, 4, "pool", "b0", "po"), "e AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS est)", select="SELECT est, row_id FROM base CROSS JOIN e WHERE y <> '0' UNION ALL SELECT est, row_id FROM po"))(lambda s, d: U.emulate_subsample(_nations(s, d), 20, "majority_downsample", 4, 0))
query("builtin_explicit", with_(NAT, select="SELECT 0 AS est, row_id FROM base WHERE row_id < 5"))(lambda s, d: U.emulate_subsample(_nations(s, d), 5, "explicit", 1, 0, given=s.range(5).select(F.lit(0).alias("est"), F.col("id").alias("row_id"))))

# encoders, splits, budgets
query("encode_labels", "SELECT y, (row_number() OVER (ORDER BY y) - 1)::INTEGER AS code FROM (SELECT DISTINCT o_orderpriority AS y FROM orders)")(lambda s, d: E.encode_labels(data.table(s, d, "orders").select(F.col("o_orderpriority").alias("y"))).select("y", "code"))


@query("encode_table", "WITH f AS (SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::DOUBLE AS code FROM (SELECT DISTINCT lang AS value FROM documents)), g AS (SELECT value, (dense_rank() OVER (ORDER BY value) - 1)::DOUBLE AS code FROM (SELECT DISTINCT source AS value FROM documents WHERE source < 'src2')) SELECT doc_id AS row_id, f.code AS lang, g.code AS source FROM documents LEFT JOIN f ON f.value = lang LEFT JOIN g ON g.value = source")
def encode_table(s, d):
    """Some sources are hidden at the fit: they become null."""
    rows = data.table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "lang", "source")
    fitted = E.fit_table_encoder(rows.withColumn("source", F.when(F.col("source") < "src2", F.col("source"))), ["lang", "source"])
    return E.apply_table_encoder(rows, fitted, ["lang", "source"])


@query("encode_numeric", "SELECT c_custkey AS row_id, c_acctbal::DOUBLE AS c_acctbal, c_nationkey::DOUBLE AS c_nationkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS c_mktsegment FROM customer")
def encode_numeric(s, d):
    return E.to_numeric(data.table(s, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_acctbal", "c_nationkey", "c_mktsegment"))


_FT = ["p_size", "p_retailprice"]


@query("feature_transform", "WITH f AS (SELECT quantile_cont(p_size::DOUBLE, 0.5) AS a, avg(p_size::DOUBLE) AS m0, stddev_pop(p_size::DOUBLE) AS s0, avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1 FROM part) SELECT p_partkey AS row_id, round((p_size - m0) / s0, 6) AS x0, round((p_retailprice - m1) / s1, 6) AS x1 FROM part CROSS JOIN f")
def feature_transform(s, d):
    rows = data.table(s, d, "part").withColumnRenamed("p_partkey", "row_id")
    out = E.apply_features(rows, E.fit_features(rows, _FT), _FT)
    return out.select("row_id", F.round(F.col("features")[0], 6).alias("x0"), F.round(F.col("features")[1], 6).alias("x1"))


query("split_stratified", with_(ORD, sql.split("base", "p", 0), select="SELECT row_id, part FROM p"))(lambda s, d: E.split_rows(data.orders(s, d), 0).select("row_id", "part"))
query("split_plain", with_(PRI, sql.split("base", "p", 3, strata=False), select="SELECT row_id, part FROM p"))(lambda s, d: E.split_rows(data.prices(s, d), 3, label=None).select("row_id", "part"))
query("split_hash", with_(ORD, sql.split("base", "p", 0), select="SELECT substr(sha1(" + sql.digest('row_id') + "), 1, 16) AS test_hash, count(*) AS n FROM p WHERE part = 'test'"))(lambda s, d: E.split_hash(E.split_rows(data.orders(s, d), 0).where("part = 'test'")))
query("target_bins", with_(PRI, _EDGE(10), select="SELECT row_id, g AS grp FROM gb"))(lambda s, d: E.groups_of(data.prices(s, d), "regression").select("row_id", F.col("grp").cast("long").alias("grp")))
query("allocate_budget", with_(ORD, _SZ, sql.allocate("t", "sz", "97", True), select="SELECT grp, n, take FROM t"))(lambda s, d: allocate(data.orders(s, d).groupBy(F.col("y").alias("grp")).agg(F.count("*").alias("n")), 97, True))
query("class_prior", with_(LAB, select="SELECT k.y AS cls, round(count(b.y) / (SELECT count(*) FROM base)::DOUBLE, 6) AS prior FROM (SELECT DISTINCT y FROM base) k LEFT JOIN base b ON b.y = k.y GROUP BY k.y"))(lambda s, d: E.class_prior(data.graded(s, d), data.graded(s, d).select(F.col("y").alias("cls")).distinct()).select("cls", F.round("prior", 6).alias("prior")))
query("max_rows", with_(ORD, select=f"SELECT row_id, y FROM base ORDER BY {h(0, 'max_rows', 'row_id')}, row_id LIMIT 1000"))(lambda s, d: __import__("tessera.sources.datasets", fromlist=["x"]).limit_rows(data.orders(s, d), 1000, 0))
query("tier_of", "SELECT l_orderkey AS row_id, CASE WHEN n < 1000 THEN 'tiny' WHEN n < 10000 THEN 'small' WHEN n < 100000 THEN 'medium' ELSE 'large' END AS tier FROM (SELECT l_orderkey, 700 * count(*) AS n FROM lineitem GROUP BY l_orderkey)")(lambda s, d: data.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg((700 * F.count("*")).alias("n")).select("row_id", G.tier_of(F.col("n")).alias("tier")))
query("resolve_budgets", "WITH s AS (SELECT c_nationkey AS dataset, count(*) * 40 AS n FROM customer GROUP BY c_nationkey), b AS (SELECT DISTINCT dataset, greatest(b, 5) AS budget, n FROM (SELECT dataset, n, round_even(f * n, 0)::BIGINT AS b FROM s CROSS JOIN (SELECT unnest([0.5, 0.1, 0.001]) AS f) UNION ALL SELECT dataset, n, unnest([500, 2000, 1]) FROM s)) SELECT dataset, budget FROM b WHERE budget < n")(lambda s, d: G.resolve_budgets(data.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("dataset")).agg((F.count("*") * 40).alias("n")), [0.5, 0.1, 0.001], [500, 2000, 1], 5))
query("budget_keys", "WITH s AS (SELECT c_nationkey AS dataset, count(*) * 40 AS n FROM customer GROUP BY c_nationkey), k AS (SELECT dataset, n, 'f0.5' AS key, 0 AS pos, greatest(round_even(0.5 * n, 0)::BIGINT, 5) AS b FROM s UNION ALL SELECT dataset, n, 'f0.1', 1, greatest(round_even(0.1 * n, 0)::BIGINT, 5) FROM s UNION ALL SELECT dataset, n, 'a500', 2, 500 FROM s) SELECT dataset, b AS budget, arg_min(key, pos) AS budget_key FROM k WHERE b < n GROUP BY dataset, b")(lambda s, d: G.budget_keys(data.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("dataset")).agg((F.count("*") * 40).alias("n")), [0.5, 0.1], [500], 5))
query("rank_by_hash", with_(ORD, select=f"SELECT row_id, row_number() OVER (PARTITION BY y ORDER BY {h(5, 'r', 'row_id')}, row_id) AS rn FROM base"))(lambda s, d: ranked(data.orders(s, d), hash_order(5, "r", "row_id"), "row_id", ("y",)).select("row_id", "rn"))

# routing
_SPLITV = [VECTORS, sql.split("base", "parts", 0), "train AS (SELECT * FROM parts WHERE part = 'train')", "test AS (SELECT * FROM parts WHERE part = 'test')"]


def _parts(s, d):
    p = E.split_rows(data.vectors(s, d), 0)
    return p.where("part = 'train'").drop("part"), p.where("part = 'test'").drop("part")


_GD = [*_SPLITV, _lloyd("train", "ce", "3", "gate"), f"gd AS (SELECT t.row_id, z.c AS est, {_d2('t.f', 'z.v')} AS d2 FROM test t CROSS JOIN ce z)", _near("train", "ce", "na"), "tau AS (SELECT CASE WHEN t > 0 THEN t ELSE 1 END AS tau FROM (SELECT quantile_cont(d2, 0.5) AS t FROM na))"]


@query("gate_distances", with_(*_GD, select="SELECT row_id, est, round(d2, 6) AS d2 FROM gd"))
def gate_distances(s, d):
    train, test = _parts(s, d)
    dist, _ = R.gate_distances(train, test, 3, 0)
    return dist.select("row_id", "est", F.round("d2", 6).alias("d2"))


@query("gate_weights", with_(*_GD, "gz AS (SELECT row_id, est, -(d2 - min(d2) OVER (PARTITION BY row_id)) / tau AS z FROM gd CROSS JOIN tau)", select="SELECT row_id, est, round(exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY row_id), 6) AS w FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS mz FROM gz)"))
def gate_weights(s, d):
    train, test = _parts(s, d)
    dist, tau = R.gate_distances(train, test, 3, 0)
    return R.gate_weights(dist, tau).select("row_id", "est", F.round("w", 6).alias("w"))


_LM = [*_SPLITV, _lloyd("test", "tg", "2", "groups"), "gr AS (SELECT c AS grp, v FROM tg)", f"po AS (SELECT * FROM (SELECT grp, t.row_id, row_number() OVER (PARTITION BY grp ORDER BY {_d2('t.f', 'v')}, t.row_id) AS k FROM train t CROSS JOIN gr))", "e AS (SELECT unnest([0, 1])::INTEGER AS est)",
       f"lo AS (SELECT grp, est, row_id FROM (SELECT grp, est, row_id, row_number() OVER (PARTITION BY grp, est ORDER BY {h(0, 'local', 'grp', 'est', 'row_id')}, row_id) AS rn FROM po CROSS JOIN e WHERE k <= 80) WHERE rn <= 40)",
       f"re AS (SELECT grp, est, row_id FROM (SELECT p.grp, e.est, p.row_id, row_number() OVER (PARTITION BY p.grp, e.est ORDER BY {h(0, 'global', 'p.grp', 'e.est', 'p.row_id')}, p.row_id) AS rn FROM po p CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.grp = p.grp AND lo.est = e.est AND lo.row_id = p.row_id)) WHERE rn <= 10)",
       "lc0 AS (SELECT grp, est, row_id, 1 AS protected FROM lo UNION ALL SELECT grp, est, row_id, 0 FROM re)", sql.cover("lm", "lc0", "train", "grp, est")]


@query("local_mix", with_(*_LM, select="SELECT grp, est, row_id FROM lm"))
def local_mix(s, d):
    train, test = _parts(s, d)
    return R.local_mix(train, test, 50, 2, ratio=0.8, groups=2, seed=0)["context"]


@query("expert_route", with_(*_SPLITV, _lloyd("train", "ce", "5", "experts"), "nb AS (SELECT c, other, slot FROM (SELECT a.c, b.c AS other, row_number() OVER (PARTITION BY a.c ORDER BY (a.c <> b.c)::INTEGER, " + _d2("a.v", "b.v") + ", b.c) - 1 AS slot FROM ce a CROSS JOIN ce b) WHERE slot < 2)", _near("test", "ce", "na"), select="SELECT na.row_id, nb.slot::INTEGER AS slot, nb.other AS expert, round(" + _d2("na.f", "z.v") + ", 6) AS d2 FROM na JOIN nb ON nb.c = na.c JOIN ce z ON z.c = nb.other"))
def expert_route(s, d):
    train, test = _parts(s, d)
    plan = R.expert_plan(train, 60, 2, 0, clusters=5)
    return R.expert_route(plan, test).select("row_id", "slot", "expert", F.round("d2", 6).alias("d2"))


@query("rbf_bandwidth", with_(VECTORS, f"s AS (SELECT * FROM base ORDER BY {h(0, 'bandwidth', 'row_id')}, row_id LIMIT 200)", select=f"SELECT round(quantile_cont(dd, 0.5), 6) AS bandwidth FROM (SELECT sqrt({_d2('a.f', 'b.f')}) AS dd FROM s a JOIN s b ON a.row_id < b.row_id) WHERE dd > 0"))
def rbf_bandwidth(s, d):
    return s.createDataFrame([(round(R.rbf_bandwidth(data.vectors(s, d), 0, 200), 6),)], "bandwidth double")


_KM = with_(*_SPLITV, f"km AS (SELECT t.row_id, avg(exp(-0.5::DOUBLE * {_d2('t.f', 'q.f')})) AS mu FROM train t CROSS JOIN test q GROUP BY t.row_id)", select="SELECT row_id, round(mu, 6) AS mu FROM km")


@query("kernel_mean", _KM)
def kernel_mean(s, d):
    train, test = _parts(s, d)
    return R.kernel_mean(train, test, 0.5).select("row_id", F.round("mu", 6).alias("mu"))


@query("crumb_routing")
def crumb_routing(s, d):
    train, test = _parts(s, d)
    return R.crumb(train, test, 20, 2, groups=2, seed=0)["context"]


@query("gate_holdout", with_(ORD, f"r AS (SELECT *, row_number() OVER (ORDER BY {h(0, 'holdout', 'row_id')}, row_id) AS rn, count(*) OVER () AS n FROM base)", "k AS (SELECT *, rn <= least(2000, round_even(0.2 * n, 0)) AS held, row_number() OVER (PARTITION BY y ORDER BY rn DESC) AS last FROM r)", select="SELECT row_id, held AND NOT last = 1 AS held FROM k"))
def gate_holdout(s, d):
    return R.gate_holdout(data.orders(s, d), 0)


_GF = [*sql.CLF, _lloyd("train", "ce", "4", "gate"), f"gd AS (SELECT t.row_id, z.c AS est, {_d2('t.f', 'z.v')} AS d2 FROM test t CROSS JOIN ce z)", _near("train", "ce", "na"), "tau AS (SELECT CASE WHEN t > 0 THEN t ELSE 1 END AS t0 FROM (SELECT quantile_cont(d2, 0.5) AS t FROM na))", sql.P, "gs AS (SELECT pr.row_id, pr.est, greatest(-50, ln(greatest(pr.p, 1e-300))) AS s FROM pr JOIN test t ON t.row_id = pr.row_id AND t.y = pr.cls)",
       "gt AS (SELECT t0 * pow(10, -2 + 4 * i / 40.0::DOUBLE) AS tau FROM tau CROSS JOIN (SELECT unnest(range(41)) AS i))", "gz AS (SELECT tau, row_id, est, exp(-(d2 - min(d2) OVER (PARTITION BY tau, row_id)) / tau) AS w FROM gd CROSS JOIN gt)", "gm AS (SELECT tau, gz.row_id, sum(w * exp(s)) / sum(w) AS m FROM gz JOIN gs ON gs.row_id = gz.row_id AND gs.est = gz.est GROUP BY tau, gz.row_id)", "gl AS (SELECT tau, -avg(ln(m)) AS loss FROM gm GROUP BY tau)"]


@query("gate_fit_grid", with_(*_GF, select="SELECT round(arg_min(tau, loss), 6) AS tau, round(min(loss), 6) AS loss FROM gl"))
def gate_fit_grid(s, d):
    c = data.clf(s, d)
    dist, tau = R.gate_distances(c["train"], c["test"], data.ESTIMATORS, 0)
    score = R.gate_scores(c["out"], c["truth"])
    fit = R.fit_gate(dist, score, tau)
    return s.createDataFrame([(round(fit.tau, 6), round(fit.loss, 6))], "tau double, loss double")


_COVER = [LAB, "ch AS (SELECT est, row_id, (k % 2)::INTEGER AS protected FROM (SELECT est, row_id, row_number() OVER (PARTITION BY est ORDER BY md5(concat_ws(':', est, row_id))) AS k FROM (SELECT b.row_id, e.est FROM base b CROSS JOIN (SELECT unnest(range(40))::INTEGER AS est) e WHERE b.y = 1)) WHERE k <= 4)"]


@query("cover_classes", with_(*_COVER, sql.cover("cv", "ch", "base", "est"), select="SELECT est, row_id FROM cv"))
def cover_classes_query(s, d):
    """Forty contexts of one class get a row of each other class."""
    from pyspark.sql import Window

    from ..operators.coverage import cover_classes

    rows = data.graded(s, d)
    every = rows.where("y = 1").select("row_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("est"))
    k = F.row_number().over(Window.partitionBy("est").orderBy(F.md5(F.concat_ws(":", F.col("est").cast("string"), F.col("row_id").cast("string")))))
    chosen = every.withColumn("k", k).where("k <= 4").select("est", "row_id", (F.col("k") % 2).alias("protected"))
    return cover_classes(rows, chosen, ("est",))


@query("projection")
def projection(s, d):
    """Embeddings wider than the limit on their principal components."""
    model = E.fit_projection(data.vectors(s, d).select("row_id", "features"), 0, 50)
    out = E.apply_projection(data.vectors(s, d).select("row_id", "features"), model)
    return out.select("row_id", F.size("features").alias("dims"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


query("builtin_balanced_orders")(lambda s, d: U.emulate_subsample(data.orders(s, d), 0.1, "balanced", 4, 0))
query("builtin_auto_orders")(lambda s, d: U.emulate_subsample(data.orders(s, d), 0.1, "auto", 4, 0))
