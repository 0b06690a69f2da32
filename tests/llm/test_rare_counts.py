"""What is counted to tell rare shingles from common ones is a few packed rows a task, and whole."""

import numpy as np
import pyarrow as pa
from tessera.llm import jaccard


def _texts():
    passage = [f"p{i}" for i in range(63)]
    own = [passage + [f"a{i}x{j}" for j in range(40)] for i in range(40)]
    return [" ".join(w) for w in own] + [" ".join(w[:-1] + ["other"]) for w in own[:5]]


def test_counts_of_sets_that_stay_apart_are_few_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    docs = spark.createDataFrame([*enumerate(_texts())], "doc_id long, text string")
    made, inside, plain, settle = [], [], type(docs).mapInArrow, jaccard._settle

    def spied(self, *args, **more):
        out = plain(self, *args, **more)
        if inside:
            made.append(out.count() / max(1, self.rdd.getNumPartitions()))
        return out

    def settled(*args):
        inside.append(True)
        try:
            return settle(*args)
        finally:
            inside.clear()

    monkeypatch.setattr(type(docs), "mapInArrow", spied)
    monkeypatch.setattr(jaccard, "_settle", settled)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, size=4, num=85).collect()}
    assert got == {i: i if i < 40 else i - 40 for i in range(45)}
    assert len(made) >= 2 and max(made) <= jaccard.COUNTER_PARTS


def test_packed_counts_of_tasks_add_up_to_all_counts():
    texts, of = _texts(), {}
    for share in (texts[:7], texts[7:30], ["", None], texts[30:]):
        for rows in jaccard._counted_parts(4)([pa.RecordBatch.from_pydict({"text": pa.array(share, pa.string())})]):
            for part, data in zip(*(c.to_pylist() for c in rows.columns)):
                of.setdefault(part, []).append(data)
    assert len(of) == jaccard.COUNTER_PARTS
    times, want = np.zeros((2, jaccard.COUNTERS), np.int64)
    for part, each in of.items():
        out = jaccard._added(pa.table({"part": [part] * len(each), "data": pa.array(each, pa.binary())}))
        assert out.column("part").to_pylist() == [part]
        slot, n = jaccard.unpack(out.column("data")[0].as_py())
        times[slot] = n
    (rows,) = jaccard._counted(4)([pa.RecordBatch.from_pydict({"text": texts})])
    want[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    assert (times == want).all() and want.sum() == 45 * 100
