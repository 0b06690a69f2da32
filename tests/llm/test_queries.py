"""Registered queries that SQL can't express, against brute force on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm.pii import luhn
from tessera.llm.queries import QUERIES, WEIGHTS

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1(spark, sf, docs):
    rows = QUERIES["op1_pfair_mix"](spark, sf).collect()
    assert sorted(r.position for r in rows) == list(range(len(docs))) and {r.doc_id for r in rows} == set(docs)
    assert all(r.lane == docs[r.doc_id].source for r in rows if docs[r.doc_id].source in WEIGHTS)
    # blocks of a source are sent in order, and while all sources last each is within a block of its target weight
    own = defaultdict(set)
    for r in rows:
        own[r.lane].add((r.slot, r.block))
    first = {r.slot: r.lane for r in rows if r.phase == 0}
    total = sum(WEIGHTS.values()) + (sum(WEIGHTS.values()) / len(WEIGHTS) if "__other__" in own else 0)
    sent, present = Counter(), {k: WEIGHTS[k] for k in own if k in WEIGHTS}
    if set(own) == set(present):
        total = sum(present.values())
        for slot in sorted(first):
            sent[first[slot]] += 1
            assert all(abs(sent[k] - w / total * (slot + 1)) < 1 for k, w in present.items())
    assert all([b for _, b in sorted(v)] == list(range(len(v))) for v in own.values())


def test_op2(spark, sf, docs):
    rows = QUERIES["op2_merge_dropout"](spark, sf).collect()
    # copies of a text are cut each in their own way
    texts = Counter(x.text for x in docs.values() if x.text and len(x.text) > 200)
    copies = {t for t, n in texts.items() if n > 1}
    cuts = defaultdict(set)
    for r in rows:
        if docs[r.doc_id].text in copies:
            cuts[docs[r.doc_id].text].add(r.ids_sha256)
    assert all(len(cuts[t]) == texts[t] for t in copies)
    assert {r.doc_id: (r.n_chars, r.decoded_sha256) for r in rows} == {d: (len(x.text or ""), sha(x.text or "")) for d, x in docs.items()}


def test_op5(spark, sf, docs):
    rows = QUERIES["op5_best_fit_shards"](spark, sf).collect()
    slots, total, held = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "bytes", None)
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        held[text].add(r.shard)
    assert len(rows) == len(docs) and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in held.values())


def test_op8(spark, sf, docs):
    for r in QUERIES["op8_quality_rules"](spark, sf).collect():
        x = docs[r.doc_id].text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        c = Counter(zip(w, w[1:], w[2:]))
        mark = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in x.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(mark) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(mark), failed)
        assert not (r.kept and failed)


def test_op9(spark, sf, docs):
    for r in QUERIES["op9_personal_data"](spark, sf).collect():
        x = docs[r.doc_id].text or ""
        found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(g) <= 255 for g in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
            d = re.sub("[ -]", "", m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        n = Counter(f[0] for f in found)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], sha(said))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
