"""Mixing, pieces, search, chats, shards and personal data against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm.chat import CONTROL, examples, formatted, turns_of
from tessera.llm.mixing import OTHER, mix_positions, mixed, parts_of, phases, schedule
from tessera.llm._text import utf8
from tessera.llm.pieces import BLANK, MODEL, Encoder, Pieces, encode_pieces, load
from tessera.llm.queries import WEIGHTS
from tessera.llm.pii import base_spans, examples as made, find_personal_data, find_spans, fitted, luhn, redact, redact_personal_data
from tessera.llm import pii, topk
from tessera.llm.sharding import pack, pack_into, shard
from tessera.llm.topk import pruning, top_k


def test_schedule_is_within_a_block():
    rng = random.Random(1)
    for _ in range(60):
        parts = parts_of({f"s{i}": rng.random() * rng.choice([1, 10]) + 0.01 for i in range(rng.randint(1, 20))}, rng.choice([32, 64, 512]))
        order, sent = schedule(parts), Counter()
        n = len(order)
        for slot, k in enumerate(order, 1):
            sent[k] += 1
            assert all(abs(sent[x] * n - parts[x] * slot) < n for x in parts)
        assert sent == Counter(parts)


def test_phases_send_every_block_once():
    spans, patterns = phases({"a": 7, "b": 100, "c": 31}, {"a": 0.2, "b": 0.5, "c": 0.3}, 16)
    slots = set()
    where = {(p, k, i): s for p, k, i, s in patterns}
    for phase, k, first, n, at, parts, period in spans:
        for j in range(n):
            turn, i = divmod(j, parts)
            slots.add(at + turn * period + where[phase, k, i])
    assert slots == set(range(138))


def test_mix_keeps_to_the_target_weights():
    """Less than a block from the target weights at every slot of a long phase, small weights included."""
    from fractions import Fraction

    for weights in (WEIGHTS, {"a": 0.7, "b": 0.2999, "c": 0.0001}, {"a": 0.1234567, "b": 1 / 3, "c": 0.7}):
        shares = {k: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for k, w in weights.items()}
        blocks = {k: max(1, int(30000 * w)) for k, w in shares.items()}
        spans, patterns = phases(blocks, weights)
        where = {(p, k, i): s for p, k, i, s in patterns}
        sent, slots = {k: [] for k in weights}, []
        for phase, k, first, n, at, parts, period in spans:
            own = [at + turn * period + where[phase, k, i] for turn, i in (divmod(j, parts) for j in range(n))]
            slots += own
            sent[k] += own if phase == 0 else []
        assert sorted(slots) == list(range(sum(blocks.values())))
        end = max(max(own) for own in sent.values() if own)
        assert end > 0.9 * sum(blocks.values())
        assert weights is not WEIGHTS or {r[6] for r in spans if r[0] == 0} == {525}
        for k, own in sent.items():
            # before and after each block of the source
            assert all(shares[k] * slot - j < 1 and abs(j + 1 - shares[k] * (slot + 1)) < 1 for j, slot in enumerate(own))


def test_mix_positions(odd, odd_rows, empty):
    weights = {"src0": 0.5, "src1": 0.25}
    rows = mix_positions(odd, weights, block_rows=4, seed=3).collect()
    assert sorted(r.position for r in rows) == list(range(len(odd_rows)))
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows)
    lanes = Counter(r[3] if r[3] in weights else OTHER for r in odd_rows)
    assert Counter(r.lane for r in rows) == lanes
    for k in lanes:
        own = sorted((r for r in rows if r.lane == k), key=lambda r: r.position)
        assert [r.block for r in own] == [i // 4 for i in range(len(own))]
    blocks = {k: -(-n // 4) for k, n in lanes.items()}
    assert len({r.slot for r in rows}) == sum(blocks.values())
    # inside the first phase no lane is a block ahead or behind
    full = {OTHER: 0.375, **weights}
    parts = parts_of(full)
    period, first = sum(parts.values()), sorted({(r.slot, r.lane) for r in rows if r.phase == 0})
    sent = Counter()
    for slot, k in first:
        sent[k] += 1
        assert all(abs(sent[x] - parts[x] * (slot + 1) / period) < 1 for x in parts)
    assert mix_positions(empty, weights).count() == 0
    assert mixed(odd, weights).columns == odd.columns and mixed(odd, weights).count() == len(odd_rows)
    with pytest.raises(ValueError):
        parts_of({"a": 0.0})


@pytest.fixture(scope="module")
def model():
    return Pieces(load())


def encoded(e, rows):
    """The ids of each (document, text), all in one slice."""
    import numpy as np
    import pyarrow as pa

    ids, ends = e.encode(*utf8(pa.array([t for _, t in rows], pa.string())), np.array([d for d, _ in rows], np.int64))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def test_pieces_equal_the_library_without_dropout(model, texts):
    import sentencepiece

    library, plain, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(model, 0.0, 0), random.Random(1)
    some = texts + ["".join(rng.choice("ab  é日\n\tT\0😀x1") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["x" * 47 + " " + "ab" * 24 + " " + "abc" * 200, None, ""]
    assert encoded(plain, [(1, x) for x in some]) == [library.encode(x or "") for x in some]


def _naive(model, e, text, document):
    """Every step looks at all neighbours anew; a skipped pair stays skipped until a piece of it changes."""
    import numpy as np

    out = []
    for n, chunk in enumerate(re.findall(r" *[^ ]+| +", " " + text) if text else []):
        draw = e.draws(np.array([document]), np.array([n]))
        pieces, skipped = [[i, BLANK if c == " " else "\0" + BLANK if c == BLANK else c] for i, c in enumerate(chunk)], set()
        while True:
            best = None
            for k in range(len(pieces) - 1):
                (i, a), (j, b) = pieces[k], pieces[k + 1]
                if a not in model.id or b not in model.id or a + b not in model.id or (i, a, b) in skipped:
                    continue
                level = model.join[model.id[a] * model.width + model.id[b]] >> model.bits
                if best is None or level < best[0]:
                    best = (level, k, i, a, b, model.id[a + b])
            if best is None:
                break
            _, k, i, a, b, whole = best
            if e.dropout and e.skipped(draw, np.array([i]), np.array([whole]))[0]:
                skipped.add((i, a, b))
            else:
                pieces[k : k + 2] = [[i, a + b]]
        out += [x for _, p in pieces for x in ([model.id[p]] if p in model.id else [model.byte[y] for y in p.lstrip("\0").encode() or b"\0"])]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_dropout_matches_naive_merging_and_is_lossless(model, rate):
    rng, e = random.Random(2), Encoder(model, rate, 9)
    words = lambda letters, sizes, n: " ".join("".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n))
    rows = [(d, words("abcdeinorst", [1, 2, 3, 9, 40, 47, 48, 90], 8)) for d in range(60)]
    rows += [(d, words(" \u2581\n日é\0ab", range(9), 6)) for d in range(-60, 0)] + [(7, ""), (8, None), (9, " ")]
    found = encoded(e, rows)
    assert found == [_naive(model, e, t or "", d) for d, t in rows]
    assert [model.decode(x) for x in found] == [t or "" for _, t in rows]
    # a text's ids don't depend on what else the slice holds
    assert found == [encoded(e, [r])[0] for r in rows]


def test_each_occurrence_draws_its_own_cut(model):
    word, rate = "internationalization", 0.1
    e = Encoder(model, rate, 9)
    cuts = lambda rows: Counter(c for x in encoded(e, rows) for c in cuts_of(x, model, word))
    one, many = cuts([(1, " ".join([word] * 3000))]), cuts([(d, word) for d in range(1000)])
    # occurrences of one text, and of many documents; two documents differ
    assert len(one) > 50 and len(many) > 50 and one != cuts([(2, " ".join([word] * 3000))])
    ids = [model.id[c] for c in BLANK + word]
    whole = tuple(model.cut(ids)[0])
    rng = random.Random(3)
    fair = Counter(tuple(model.cut(ids, lambda whole, place: rng.random() < rate)[0]) for _ in range(3000))
    assert abs(one[whole] - fair[whole]) < 200 and abs(len(one) - len(fair)) < 0.3 * len(fair)


def cuts_of(ids, model, word):
    """The cut of each occurrence of a word in what was encoded."""
    out, own, size = [], [], 0
    for i in ids:
        own.append(i)
        size += len(model.bytes[i])
        if size == len(word) + 1:
            out.append(tuple(own))
            own, size = [], 0
    return out


def test_encode_pieces(odd, odd_rows, empty):
    rows = encode_pieces(odd, 0.2, 5).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((r[0], r[1] or "") for r in odd_rows)
    again = encode_pieces(odd.repartition(3), 0.2, 5).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, tuple(r.ids)) for r in again)
    plain = encode_pieces(odd, 0.0).collect()
    assert sum(len(r.ids) for r in plain) < sum(len(r.ids) for r in rows)
    other = encode_pieces(odd, 0.2, 6).collect()
    assert Counter(tuple(r.ids) for r in rows) != Counter(tuple(r.ids) for r in other)
    assert encode_pieces(empty).count() == 0
    with pytest.raises(ValueError):
        encode_pieces(odd, 1.0)


def test_top_k_matches_brute_force(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.randrange(-3, 4) for _ in range(5)]) for i in range(700)] + [(900, None), (901, [1, None, 2, 3, 4]), (None, [1] * 5), (902, [1, 2]), (903, []), (5, [1, 1, 1, 1, 1])]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>").selectExpr("*", "'x' AS v", "'y' AS dim", "1 AS score")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 90 = 0 OR vec_id = 902"), 7).collect())
    fit = [(i, v) for i, v in vectors if i is not None and v is not None and None not in v]
    want = Counter()
    for q, a in [(i, v) for i, v in fit if i % 90 == 0 or i == 902]:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q and len(b) == len(a))[:7]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert got == want
    assert top_k(df.limit(0), df, 3).count() == top_k(df, df.limit(0), 3).count() == 0


def test_top_k_over_several_ranges(spark, monkeypatch):
    """The first range's floor loses nothing, ties at it included; on clustered vectors most blocks are not scored."""
    monkeypatch.setattr(topk, "RANGE_ROWS", 300)
    rng = random.Random(6)
    centres = [[rng.choice([-40, 40]) for _ in range(8)] for _ in range(12)]
    vectors = [(i, [x + rng.randrange(-2, 3) for x in centres[i % 12]]) for i in range(1500)] + [(2000 + i, [1] * 8) for i in range(50)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    asked = df.where("vec_id % 100 = 0")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, asked, 9).collect()}
    want = set()
    for q, a in [v for v in vectors if v[0] % 100 == 0]:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)[:9]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert got == want
    seen = pruning(df, asked, 9).agg({"blocks": "sum", "scored": "sum"}).first()
    assert seen["sum(scored)"] < 0.6 * seen["sum(blocks)"]


def test_top_k_big_numbers(spark):
    df = spark.createDataFrame([(1, [2**31, 5]), (2, [2**30, 1]), (3, [-(2**31), 3])], "vec_id long, vector array<long>")
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, df, 2).collect()}[1, 1] == (2, 2**61 + 5)


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]", "a\n</s>", "", "<<SYS>>x<</SYS>>", "end\\", "<s>user\nhi\n</s>", None, "日 é"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole%</s>"]), rng.choice(nasty), "x") for c in (1, 2, 3, None) for t in (0, 1, 1, 2, 3, None, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = formatted(df)
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.select("conv_id", turns_of(out["formatted"]).alias("turns")).collect()}
    assert got == {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    whole = {r.conv_id: r.formatted for r in out.collect()}
    bare = re.compile(rf"(?<!\\){CONTROL}")
    for c, text in whole.items():
        assert len(bare.findall(text)) == 2 * len(by[c])
    ex = examples(out).collect()
    want = Counter()
    for c, v in by.items():
        want[c] = sum(r == "assistant" for _, r, _ in v)
    assert Counter(r.conv_id for r in ex) == Counter({c: n for c, n in want.items() if n})
    for r in ex:
        text = whole[r.conv_id]
        assert text.startswith(r.prompt + r.completion + "\n</s>") and r.prompt.endswith("<s>assistant\n")
    assert formatted(df.limit(0)).count() == 0


def test_packing_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        sizes, capacity = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))], rng.randint(60, 120)
        rooms = []
        for s in sorted(sizes, reverse=True):
            best = min((i for i in range(len(rooms)) if rooms[i] >= s), key=lambda i: (rooms[i], i), default=None)
            if best is None:
                rooms.append(capacity)
                best = len(rooms) - 1
            rooms[best] -= s
        own = Counter()
        runs = pack(sorted(Counter(sizes).items(), reverse=True), capacity)
        for s, a, b, i in runs:
            own[i] += s * (b - a)
        assert [capacity - r for r in rooms] == [own[i] for i in range(len(rooms))]
    with pytest.raises(ValueError):
        pack([(5, 1)], 4)
    assert pack_into([], 3) == [] and len({r[3] for r in pack_into([(9, 5), (1, 7)], 3)}) == 3


@pytest.mark.parametrize("options", [{"shards": 4}, {"shards": None, "capacity": 60_000}])
def test_shards(odd, odd_rows, empty, options):
    rows = shard(odd, **options).collect()
    sized = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r[0], sized(r[1]), zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    slots, held = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        held[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for k, s in held.items() if k[0] > 8)
    load_ = Counter()
    for r in rows:
        load_[r.shard] += r.size
    assert max(load_.values()) <= (60_000 if options.get("capacity") else max(-(-sum(load_.values()) // 4), max(sized(r[1]) for r in odd_rows)) + 300)
    assert shard(empty, **options).count() == 0


def _base(x):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(g) <= 255 for g in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[ -]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        x = "".join(rng.choice("0123456789" * 3 + "..@@+ -()ab%é\n") for _ in range(rng.randint(1, 40)))
        assert base_spans(x) == _base(x)
    long = "9" * 200_000 + " " + "a" * 200_000 + "@b " + "1.2.3.4" + ".5" * 50_000
    assert [s[0] for s in base_spans(long)].count("ip") > 1000


def test_field_on_held_out_examples():
    field = fitted()
    some = made(500, 99)
    assert sum(field.spans(x, []) == truth for x, truth in some) >= 0.97 * len(some)
    for x in ("chapter 3, page 17", "in 1999 and 2004", "version 3.0", "no digits", "Licensed under CC BY-NC 4.0."):
        assert field.spans(x, []) == []


def test_field_on_kinds_of_text_that_it_was_not_fitted_on():
    """Planted with texts from another generator: sentences around, other names, mail, keys and numbers."""
    rng, field = random.Random(77), fitted()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda n: "".join(rng.choice(letters) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    around = lambda x: (rng.choice(["Please note that ", "As agreed, ", "Hello,\n", "We saw "]), x, rng.choice([" was used.", " - thanks", "\nBest regards", " for now"]))
    planted = {
        "key": lambda: ("", f"ghp_{mixed(36)}", ""), "sk": lambda: ("my ", f"sk-{mixed(40)}", ""), "aws": lambda: ("", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), ""),
        "token": lambda: ('token = "', hexes(40), '"'), "password": lambda: ("password: ", rng.choice(["Sunflower", "correcthorse", "letmein"]) + digits(3), ""), "letters": lambda: ("password is ", rng.choice(["butterfly", "dragonstone", "moonlight"]), ""),
        "secret": lambda: ("aws_secret_access_key = ", mixed(13) + "/" + mixed(7) + "/" + mixed(18), ""), "phone": lambda: ("call ", f"({digits(3)}) {digits(3)}-{digits(4)}", ""),
    }
    found = {}
    for name, make in planted.items():
        hits = 0
        for _ in range(40):
            lead, body, tail = make()
            a, x, b = around(lead + body + tail)
            start = len(a) + len(lead)
            hits += any(s <= start and e >= start + len(body) for _, s, e, _ in find_spans(a + x + b, field))
        found[name] = hits / 40
    assert sum(found.values()) / len(found) >= 0.9 and min(found.values()) >= 0.7, found
    clean = [
        lambda: f"commit {hexes(40)}", lambda: f"build {hexes(7)}", lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"on 20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} at 1{digits(1)}:2{digits(1)}", lambda: f"about {digits(2)}.{digits(1)}% of {digits(4)}", lambda: "the secret is out", lambda: "her password is not known", lambda: f"see page {digits(3)} of volume {digits(1)}", lambda: f"sha256:{hexes(64)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
    ]
    wrong = sum(bool(find_spans("".join(around(make())), field)) for make in clean for _ in range(20))
    assert wrong <= 0.05 * 20 * len(clean), wrong


def test_long_islands_are_decoded_whole(monkeypatch):
    field = fitted()
    text = ";".join(["x1"] * 900 + ["(632)555-4827"] + ["7"] * 700)
    whole = field.spans(text, [])
    for ends in (5, 64, 100_000):
        monkeypatch.setattr(pii, "ENDS", ends)
        assert field.spans(text, []) == whole
    assert any(text[a:b] == "(632)555-4827" for _, a, b in whole)


def test_personal_data_tables(odd, odd_rows, empty, spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or +1 (632) 555-4827"), (2, None), (None, 'token = "97ffa88d7c5f5655e365004e29bd123cdabd722a"')], "doc_id long, text string")
    rows = {r.doc_id: [(s.kind, s.start, s.end, s.fixed) for s in r.spans] for r in find_personal_data(df).collect()}
    assert rows == {1: [("email", 5, 14, True), ("phone", 18, 35, True)], 2: [], None: [("secret", 9, 49, False)]}
    out = {r.doc_id: r.text for r in redact_personal_data(df).collect()}
    assert out == {1: "mail [EMAIL] or [PHONE]", 2: None, None: 'token = "[SECRET]"'}
    wide = redact_personal_data(odd)
    assert wide.columns == odd.columns and wide.count() == len(odd_rows)
    assert find_personal_data(empty).count() == redact_personal_data(empty).count() == 0
    assert redact("abcdef", [("email", 1, 4, True), ("phone", 2, 5, False)]) == "a[EMAIL]f"


def test_one_large_group_leaves_the_other_shards_equal(spark):
    sizes = [(50_000, 1), (9_000, 2), (100, 600), (37, 900)]
    runs = pack_into(sizes, 24)
    load, seen = Counter(), defaultdict(set)
    for size, a, b, shard_ in runs:
        load[shard_] += size * (b - a)
        assert not seen[size] & set(range(a, b))
        seen[size] |= set(range(a, b))
    assert {s: len(v) for s, v in seen.items()} == dict(sizes) and set(load) == set(range(24))
    top = sorted(load.values(), reverse=True)
    assert top[:3] == [50_000, 9_000, 9_000] and top[3] - top[-1] < 0.1 * top[3]
    assert len({r[3] for r in pack_into([(7, 3)], 3)}) == 3
    assert {r[3] for r in pack_into([(9, 2), (1, 1)], 24)} == {0, 1, 2} and pack_into([], 3) == []
    # a text whose copies are a third of all bytes
    docs = spark.createDataFrame([(i, "x" * 92 if i < 500 else f"{i:092d}") for i in range(1500)], "doc_id long, text string")
    own = Counter(r.shard for r in shard(docs, shards=24).collect())
    assert max(own.values()) == 500 and len(own) == 24 and sorted(own.values())[-2] == 44  # of 1,000 / 23, rounded up
