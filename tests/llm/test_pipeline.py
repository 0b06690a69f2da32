"""The pipeline's stages against plain Python, and registration."""

import re
from collections import defaultdict

import corpus_pipeline
from tessera.llm.mixing import mix_positions
from tessera.llm.pii import find_spans, fitted, redact
from tessera.llm.queries import ORACLES, QUERIES, WEIGHTS
from tessera.llm.rules import judge, learn_rules


def test_registration():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "tokens"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id for r in judge(docs, learn_rules(docs, labels)).where("kept").collect()}
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == kept and first.columns == docs.columns

    second = corpus_pipeline.near_copies(spark, first, sf)
    sets = {}
    for d, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    post = defaultdict(set)
    for d in sorted(sets):
        for e in {e for s in sets[d] for e in post[s]}:
            if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for s in sets[d]:
            post[s].add(d)
    stay = {d for d in sets if find(d) == d}
    assert {r.doc_id for r in second.collect()} == stay and second.columns == docs.columns

    third = corpus_pipeline.personal_data(spark, second, sf)
    field = fitted()
    clean = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns
    for d in stay:
        want = redact(rows[d].text, find_spans(rows[d].text, field))
        assert clean[d].text == want and clean[d].n_chars == len(want)

    fourth = corpus_pipeline.mixing(spark, third, sf)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == stay
    last = corpus_pipeline.tokens(spark, fourth, sf).collect()
    assert {r.doc_id for r in last} == stay and all(r.whole for r in last)


def test_stages_take_odd_and_empty_tables(spark, sf, odd, empty):
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            n = out.count()
            if name != "tokens":
                assert out.columns == df.columns
            if name in ("personal data", "mixing", "tokens"):
                assert n == df.count()


def test_order_of_the_mix_survives_files(spark, sf, tmp_path):
    """Several files of different sizes, reread: position gives the mix."""
    rows = [(i, f"w{i} " * (1 + (i * 7919) % 400), "en", f"src{i % 20}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in mix_positions(docs, WEIGHTS, 64, 17).orderBy("position").collect()]
    mixed = corpus_pipeline.mixing(spark, docs, sf)
    assert [r.doc_id for r in mixed.collect()] == want
    mixed.repartition(6, "doc_id").write.parquet(f"{tmp_path}/mix")
    last = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/mix"), sf).select("doc_id", "position").collect()
    assert sorted(r.position for r in last) == list(range(3000))
    assert [r.doc_id for r in sorted(last, key=lambda r: r.position)] == want


def test_near_copies_keep_one_row_of_each_component_whatever_its_id(spark, sf):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    near = lambda k: text[k] + " more"
    rows = [(None, text["a"]), (None, text["b"]), (None, near("b")), (None, text["c"]), (None, text["c"]), (5, near("c")), (6, text["d"]), (7, near("d")), (7, text["e"]), (8, text["f"]), (8, near("f")), (None, None), (None, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "src0", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, sf).collect()]
    words = {(t[0], d) for d, t in got if t and t[0] not in "bf"}
    # 7 goes as a copy of 6 and stays as the text of its own
    assert words == {("a", None), ("c", 5), ("d", 6), ("e", 7)} and len(got) == 4 + 2 + 3
    assert [d for d, t in got if t and t[0] == "b"] == [None] and [d for d, t in got if t and t[0] == "f"] == [8]
    assert sorted((r for r in got if not r[1]), key=str) == sorted([(None, None), (None, ""), (9, "")], key=str)
