"""What op7 and the pipeline send between tasks doesn't grow with the number of parts, nor hold texts that nobody asks for."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tessera.llm import jaccard
from tessera.llm._tables import marked


def test_signatures_of_a_set_go_to_few_parts_and_links_still_meet(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_PARTS", 200)
    rng, bands = np.random.RandomState(4), jaccard.Bands(85, 100)
    base = [np.unique(rng.randint(0, 1 << 62, int(m)).astype(np.uint64)) for m in np.geomspace(100, 3000, 40)]
    sets = base + [np.unique(np.append(b[9:], b[:5] ^ np.uint64(7))) for b in base]
    n = np.array([len(s) for s in sets])
    signs = np.zeros(len(bands.top), np.int64)
    for a, b in zip(*bands.span(n)):
        signs[a : b + 1] += 1
    parts = jaccard.Parts(bands, signs)
    sig, who, band, index = jaccard.placed_signatures(np.concatenate(sets), n, bands)
    part = parts.of(band, index, sig)
    assert part.min() >= 0 and part.max() < parts.count and np.bincount(part).max() < 4 * len(sig) / parts.count
    hashed = len({*zip((sig % np.uint64(parts.count)).tolist(), who.tolist())})
    assert len({*zip(part.tolist(), who.tolist())}) < 0.5 * hashed
    has = [{*zip(part[who == i].tolist(), sig[who == i].astype(np.uint32).tolist())} for i in range(len(sets))]
    assert all(has[i] & has[i + 40] for i in range(40))


def test_marked_rows_hold_all_values_and_few_others(spark):
    rows, values = spark.range(-3000, 30_000), spark.range(0, 3000, 3)
    got = {r.id for r in marked(rows, "id", values, "may").where("may").collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 8000


def test_near_copies_deal_only_rows_that_may_go_or_repeat(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(docs.where("doc_id % 50 = 0"))
    plan = corpus_pipeline.near_copies(spark, docs, sf)
    assert "Union" in plan._jdf.queryExecution().optimizedPlan().toString()
    got = [r.doc_id for r in plan.collect()]
    assert len(got) == len(set(got))
    found = jaccard.near_duplicates(docs, size=5, num=80).where("doc_id = component_id")
    assert set(got) == {r.doc_id for r in found.collect()}


def test_sets_that_share_a_common_passage_are_not_sent_to_each_other_and_links_still_meet():
    bands, size, parts = jaccard.Bands(80, 100), 2, 7
    words = lambda tag, n: [f"{tag}w{i}" for i in range(n)]
    passage = words("p", 60)
    texts = [" ".join(passage + words(f"a{i}x", 50)) for i in range(150)]
    texts += [" ".join(passage + words(f"a{i}x", 50)[: 50 - i] + words(f"new{i}x", i)) for i in range(9)]
    fp = list(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"fp": pa.array(fp, pa.int64()), "cluster": pa.array([5] * len(fp), pa.int64()), "comp": pa.array(fp, pa.int64()), "text": texts})
    times = np.zeros(jaccard.COUNTERS, np.int64)
    for rows in jaccard._counted(size)([batch]):
        times[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    met = {}
    for rank in (np.argsort(np.argsort(times, kind="stable")), np.random.RandomState(1).permutation(jaccard.COUNTERS)):
        dealt = {}
        for rows in jaccard._rarest(size, bands, rank, parts)([batch]):
            for part, data in zip(*(rows.column(k).to_pylist() for k in ("part", "data"))):
                dealt.setdefault(part, []).append(data)
        tables = [jaccard._meet(bands, parts)(pa.table({"data": pa.array(d, pa.binary())})) for d in dealt.values()]
        met[len(met)] = {(a, b) for t in tables for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())}
    sets = [frozenset(zip(w, w[1:])) for w in (t.split() for t in texts)]
    links = {(i, j) for j in fp for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    # any order of shingles loses no link, and hardly any others are sent on
    assert len(links) >= 5 and links <= met[0] and links <= met[1]
    assert max(len(met[0]), len(met[1])) < 3 * len(links)
