"""Operators on texts against brute force, on rows with every oddity."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import jaccard
from tessera.llm._tables import components, spread
from tessera.llm.jaccard import near_duplicates
from tessera.llm.lm import backoff_scores
from tessera.llm.repeats import remove_repeats
from tessera.llm.rules import COUNTS, RATES, Rule, judge, keep, learn, learn_rules, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repeats_match_brute_force(odd, odd_rows):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(odd).collect())
    first = {}
    docs = [(r[0], WORD.findall(r[1] or "")) for r in odd_rows]
    for d, w in docs:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    want = Counter()
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert got == want
    assert sum(n for _, _, n, _ in got) > 100


def test_repeats_spans_and_other_windows(spark):
    w = [f"a{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "x y " + " ".join(w[5:20]) + " z"), (3, " ".join(w[5:13]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(df, window=9).collect()}
    assert [(s.first, s.last) for s in rows[2].removed] == [(2, 16)] and rows[2].kept == "x y z"
    assert rows[3].n_removed == 0 and rows[1].n_removed == 0
    with pytest.raises(ValueError):
        remove_repeats(df, window=7)


def _sets(rows, size):
    out = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


@pytest.mark.parametrize("few,block", [(24, 2048), (2, 3)])
@pytest.mark.parametrize("size,num", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components_match_brute_force(odd, odd_rows, monkeypatch, few, block, size, num):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = _sets(odd_rows, size)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                links += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert links >= 3
    low = defaultdict(list)
    for i, r in enumerate(odd_rows):
        low[find(i)].append(r[0])
    want = Counter((r[0], len(s), min((d for d in low[find(i)] if d is not None), default=None) if s else r[0]) for i, (r, s) in enumerate(zip(odd_rows, sets)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(odd, size, num, 100).collect())
    assert got == want


def test_jaccard_signatures_lose_no_link():
    import numpy as np

    rng = np.random.RandomState(3)
    for num in (60, 80, 85, 95):
        bands = jaccard.Bands(num, 100)
        for _ in range(250):
            m = int(np.exp(rng.uniform(np.log(2), np.log(400))))
            x = rng.randint(0, 1 << 62, 3 * m + 300).astype(np.uint64)
            r, q = rng.randint(0, m + 1), 0
            while 100 * (m - r) >= num * (m + q + 1) and rng.rand() < 0.98:
                q += 1
            if 100 * (m - r) < num * (m + q) or r + q == 0:
                continue
            a, b = np.sort(x[:m]), np.sort(x[r : m + q])
            sig, who = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
            s = jaccard.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            gap = s[0] - s[1]
            assert int(np.minimum(gap, -gap).sum()) <= r + q


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60) - 30, rng.randrange(60) * 2**55) for _ in range(45)] + [(i, i + 1) for i in range(1000, 1030)] + [(-(2**63), 2**63 - 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_scores_match_brute_force(odd, odd_rows):
    docs = [WORD.findall(r[1] or "") for r in odd_rows]
    one, two = Counter(), Counter()
    for w in docs:
        one.update(w)
        two.update(zip(w, w[1:]))
    total, want = sum(one.values()), []
    for r, w in zip(odd_rows, docs):
        o, t, n, score, off, fresh = Counter(w), Counter(zip(w, w[1:])), total - len(w), 0.0, 0, 0
        for i, x in enumerate(w):
            c = one[x] - o[x]
            p = c / n if c else 1 / (n + 1)
            backed = False
            if i:
                v = w[i - 1]
                both = two[v, x] - t[v, x]
                backed = not both
                p = both / (one[v] - o[v]) if both else 0.4 * p
            off += backed
            fresh += not c and (backed or i == 0)
            score += math.log(p)
        want.append((r[0], len(w), off, fresh, round(score, 6)))
    got = [(r.doc_id, r.n_words, r.n_backed_off, r.n_unseen, round(r.log_score, 6)) for r in backoff_scores(odd).collect()]
    assert Counter(got) == Counter(want)


def test_statistics_match_brute_force(odd, odd_rows, spark):
    lines = [(500, "a b c\na b c\n\n \nx  y\na b c \n#1 *$%&|<>!! A"), (501, "q " * 60), (502, "u v w u v w q")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(lines, "doc_id long, text string"))
    want = Counter()
    for d, text in [(r[0], r[1]) for r in odd_rows] + lines:
        x = text or ""
        w = WORD.findall(x)
        c = Counter(zip(w, w[1:], w[2:]))
        mark = set()
        for i in range(len(w) - 2):
            if c[w[i], w[i + 1], w[i + 2]] > 1:
                mark |= {i, i + 1, i + 2}
        own = [y for y in x.split("\n") if WORD.search(y)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(own) - len(set(own)), len(mark), len(own), len(re.findall("[A-Z]", x)), x.count("!"), len(set(w)), len(w) < 50 or 100 * len(mark) > 50 * len(w)] += 1
    got = Counter((r.doc_id, *[r[c] for c in COUNTS], r.base_failed) for r in text_statistics(df).collect())
    assert got == want


def test_decision_list_covers_planted_rules_and_keeps_the_rest(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    rates = {k: rng.rand(3000) for k in RATES}
    bad = (rates["symbols_per_word"] > 0.8) & (rates["bangs_per_word"] > 0.5) | (rates["upper_per_char"] < 0.1)
    found = learn(rates, bad, np.arange(3000) % 3 == 0)
    said = np.zeros(3000, bool)
    for rule in found.rules:
        said |= rule.holds(rates)
    assert (said & bad).sum() > 0.9 * bad.sum() and (said & ~bad).sum() < 0.02 * said.sum()
    assert learn(rates, np.zeros(3000, bool), np.arange(3000) % 3 == 0).rules == ()
    assert learn(rates, np.ones(3000, bool), np.arange(3000) % 3 == 0).rules == ()


def test_rules_column_equals_rule(odd):
    from tessera.llm.rules import DecisionList

    rules = DecisionList((Rule((("distinct_per_word", True, 0.99), ("chars_per_word", False, 5.0))),))
    rows = judge(odd, rules).collect()
    for r in rows:
        n = max(1, r.n_words)
        hit = r.n_distinct / n >= 0.99 and r.word_chars / n <= 5.0
        assert r.kept == (not r.base_failed and not hit)
    assert keep(odd, rules).columns == odd.columns
    assert keep(odd, rules).count() == sum(r.kept for r in rows)


def test_rules_from_tables(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = learn_rules(docs, labels)
    out = judge(docs, rules).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert out.where("not kept").count() <= 0.02 * out.count()
    assert learn_rules(docs, labels.limit(0)).rules == () and learn_rules(docs.limit(0), labels).rules == ()


def test_empty_tables(empty):
    assert remove_repeats(empty).count() == near_duplicates(empty).count() == backoff_scores(empty).count() == text_statistics(empty).count() == 0


def test_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "head " + long[1000:2000] + " tail")], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert rows[1].n_removed == 0 and rows[1].n_words == 400_000 and rows[2].n_removed > 50
    assert hashlib.sha256(rows[1].kept.encode()).hexdigest() == hashlib.sha256(long.encode()).hexdigest()


def test_a_third_of_rows_alike(spark):
    """Rows without an id that are equal in text meet no single task, and get what brute force gives."""
    rng = random.Random(4)
    texts = [None] * 60 + [" ".join(f"q{i}" for i in range(20))] * 60 + [" ".join(f"w{rng.randrange(99)}" for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame([(None if i < 120 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    dealt = docs.withColumn("b", spread(64)).where("text like 'q0 %'").groupBy("b").count().collect()
    assert len(dealt) > 2 and sum(r["count"] for r in dealt) == 60
    scored = backoff_scores(docs).collect()
    same = {(r.n_words, r.n_backed_off, r.n_unseen, round(r.log_score, 9)) for r in scored if r.doc_id is None}
    n = 59 * 20 + 60 * 30
    assert len(scored) == 180 and same == {(0, 0, 0, 0.0), (20, 0, 0, round(math.log(59 / n), 9))}
    kept = remove_repeats(docs).collect()
    assert len(kept) == 180 and all(r.n_removed == 0 for r in kept)


def test_long_texts(spark):
    """A text of some 3 MB among short ones: whole in every operator."""
    rng = random.Random(8)
    words = [f"t{rng.randrange(10**6)}" for _ in range(400_000)]
    long, near = " ".join(words), " ".join(words[:390_000])
    df = spark.createDataFrame([(1, long), (2, near), (3, " ".join(words[:30])), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(df, size=4, num=85, den=100).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    scored = {r.doc_id: r for r in backoff_scores(df).collect()}
    one, two = Counter(words[:390_000] + words[:30]), Counter([*zip(words, words[1:390_000]), *zip(words[:29], words[1:30])])
    off = sum(not two[v, x] for v, x in zip(words, words[1:]))
    assert (scored[1].n_words, scored[1].n_backed_off) == (400_000, off)
    assert scored[1].n_unseen == sum(not one[x] for x in words) and scored[3].n_backed_off == 0
    stats = {r.doc_id: r for r in text_statistics(df).collect()}
    assert stats[1].n_words == 400_000 and stats[1].word_chars == sum(map(len, words)) and stats[4].n_words == 0
