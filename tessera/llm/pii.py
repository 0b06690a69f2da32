"""Personal data: fixed patterns, and a semi-Markov conditional random field for the rest.

The patterns' spans always stand.  The field then looks at islands: pieces of text between blanks
that hold a digit, an at sign or a known key's first letters (joined across blanks only where neither side has letters),
and what a word such as password, token or secret is said to be (letters alone included); less
what the patterns took.  Each candidate segment, up to MOST_TOKENS tokens, is scored as a whole by
its shape, length, checksum, first letters and surroundings, for each type; dynamic programming over segments
picks boundaries and types together, over islands of any length.  Outside islands there are no candidates.  The
weights are fitted by likelihood on generated, seeded examples, once a process on the driver; they are
a few thousand numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, spared

#: Kinds in the order that results list them.
KINDS = ("email", "ip", "card", "phone", "secret")
MOST_TOKENS = 20
#: Ends of segments that are scored at once.
ENDS = 1024
_TYPES = ("O", *KINDS)

# Fixed patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_SAID = r"(?i:(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key)[\"']?(?:\s*[:=]\s*|\s+is\s+)[\"']?[^\s\"']+)"
_TRIGGER = re.compile(rf"[0-9@]+|AKIA|{_SAID}")
_ANY = re.compile(r"[0-9@]|AKIA")
_SAID_ANYWHERE = re.compile(rf"(?s:.*?){_SAID}")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = re.compile(r"\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap inside each kind, in code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _ANY.search(text):
        return out
    for m in _DOTTED.finditer(text):
        groups = m.group().split(".")
        if len(groups) >= 4:
            at = m.start()
            for i in range(0, len(groups) - 3, 4):
                size = sum(map(len, groups[i : i + 4])) + 3
                if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in groups[i : i + 4]):
                    out.append(("ip", at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _blank_before(text: str, at: int) -> int:
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = max(done, _blank_before(text, m.start()))
        found = _BLANK.search(text, m.end())
        done = found.start() if found else len(text)
        if out and start - out[-1][1] == 1 and not _LETTER.search(text, out[-1][1] - 1, out[-1][1]) and not _LETTER.search(text, start, done):
            out[-1] = (out[-1][0], done)
        else:
            out.append((start, done))
    return out


def _bucket(n: int) -> str:
    return str(n) if n <= 4 else next(f"<{x}" for x in (6, 9, 13, 20, 32, 48, 10**18) if n < x)


def _class(token: str) -> str:
    if token.isdigit():
        return "9" + _bucket(len(token))
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "Aa"
    if token.isalnum() or "_" in token:
        case = "x" if token == token.lower() else "X" if token == token.upper() else "xX"
        return case + _bucket(len(token))
    return token


_CUES = {"token": "key", "password": "key", "secret": "key", "key": "key", "api": "key", "passwd": "key", "pwd": "key", "tel": "tel", "phone": "tel", "call": "tel", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "mail": "mail", "email": "mail", "version": "no", "page": "no", "chapter": "no", "commit": "no", "sha": "no", "isbn": "no", "uuid": "no", "id": "no", "order": "no", "md": "no", "checksum": "no", "revision": "no", "passphrase": "key", "is": "is"}


_WORD = re.compile(r"[A-Za-z]+")
_HEAD = re.compile(r"[A-Za-z]{2,6}[-_]")


def _features(text: str, tokens: list[tuple[int, int, str]], i: int, j: int) -> list[str]:
    """Of the segment tokens[i:j] as a whole."""
    start, end = tokens[i][0], tokens[j - 1][1]
    classes = [t[2] for t in tokens[i:j]]
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    left = text[max(0, start - 16) : start]
    cues = [_CUES[w] for w in reversed([x.lower() for x in _WORD.findall(left)][-3:]) if w in _CUES]
    cue = next((c for c in cues if c != "is"), "-")
    spaces = sum(b[0] > a[1] for a, b in zip(tokens[i : j - 1], tokens[i + 1 : j]))
    shape = "".join(classes)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    out = ["bias", f"shape={shape}", f"n={_bucket(j - i)}", f"digits={_bucket(len(digits))}", f"first={classes[0]}", f"last={classes[-1]}", f"cue={cue}", f"cue={cue}|n={min(j - i, 2)}|{classes[0][:2]}", f"left={left[-1:] if not left[-1:].isalnum() else 'w'}", f"right={text[end : end + 1] if not text[end : end + 1].isalnum() else 'w'}", f"spaces={min(spaces, 4)}", f"changes={_bucket(changes)}"]
    head = _HEAD.match(span)
    if head:
        out.append(f"head={head.group().lower()}")
    sign = left.rstrip(" \"'")[-1:]
    out.append(f"cue={cue}|sign={sign if sign in '=:' else 'is' if cues[:1] == ['is'] else '-'}")
    if j - i == 1 and classes[0][:1] in "aA":
        out.append(f"word|cue={cue}|{_bucket(len(span))}|sign={sign if sign in '=:' else 'is' if cues[:1] == ['is'] else '-'}")
    if all(c in "0123456789abcdef-" for c in span.lower()):
        out.append(f"hex={len(span) if len(span) in (32, 36, 40, 64) else _bucket(len(span))}|dashes={span.count('-')}|cue={cue}")
    if "@" in span:
        out.append(f"at={span.count('@')}|dot={'.' in span.rpartition('@')[2]}")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}|pure={all(c in '0123456789 -' for c in span)}")
    if span.count(".") == 3 and all(g.isdigit() for g in span.split(".")):
        out.append(f"octets={all(len(g) < 4 and int(g) <= 255 for g in span.split('.'))}")
    if span.startswith("AKIA"):
        out.append("akia")
    return out


def _tokens(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[list[tuple[int, int, str]]]:
    """Tokens of an island, in one list for each piece between taken spans."""
    out: list[list] = [[]]
    for m in _TOKEN.finditer(text, start, end):
        if any(a < m.end() and m.start() < b for a, b in taken):
            out.append([])
        else:
            out[-1].append((m.start(), m.end(), _class(m.group())))
    return [x for x in out if x]


def _segments(text: str, tokens, first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Segments that end after token ``first`` to ``last``, by end."""
    spans, features = [], []
    for j in range(first + 1, (len(tokens) if last is None else last) + 1):
        for i in range(max(0, j - MOST_TOKENS), j):
            spans.append((i, j)), features.append(_features(text, tokens, i, j))
    return spans, features


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of features by type, and of a type after another."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, after: np.ndarray):
        self.index, self.weights, self.after = index, weights, after

    def scores(self, spans, features) -> np.ndarray:
        out = np.stack([self.weights[[self.index[f] for f in fs if f in self.index]].sum(axis=0) for fs in features])
        out[[j - i > 1 for i, j in spans], 0] = -1e30
        return out

    def decode(self, text: str, tokens) -> list[tuple[str, int, int]]:
        n = len(tokens)
        best = np.full((n + 1, len(_TYPES)), -1e300)
        best[0, 0] = 0.0
        back: dict = {}
        for at in range(0, n, ENDS):
            spans, features = _segments(text, tokens, at, min(n, at + ENDS))
            for (i, j), own in zip(spans, self.scores(spans, features)):
                before = best[i][:, None] + self.after
                prev = before.argmax(axis=0)
                total = before.max(axis=0) + own
                for y in np.flatnonzero(total > best[j]).tolist():
                    best[j, y] = total[y]
                    back[j, y] = (i, int(prev[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((_TYPES[y], tokens[i][0], tokens[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        out = []
        taken = sorted(taken)
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
        for a, b in islands(text):
            low = int(np.searchsorted(ends, a, "right"))
            near = []
            for s in taken[low:]:
                if s[0] >= b:
                    break
                near.append(s)
            said = None
            for tokens in _tokens(text, a, b, near):
                fit = any("9" in t[2] or "x" in t[2] or "X" in t[2] or t[2] == "@" or text.startswith("AKIA", t[0]) for t in tokens)
                if not fit and said is None:
                    said = _SAID_ANYWHERE.match(text, a, b) is not None
                if fit or said:
                    out += self.decode(text, tokens)
        return out


def _example(rng: np.random.RandomState) -> tuple[str, list[tuple[str, int, int]]]:
    """One generated island with its neighbours and true spans."""
    pick = lambda *x: x[rng.randint(len(x))]
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstuvz"), rng.randint(2, 9)))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    upper = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), n))
    mixed = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    kind = rng.randint(0, 25)
    before, after, name = word() + pick(" ", " ", ". ", ", "), pick(" ", " ", ". ", ", ", "\n") + word(), None
    if kind == 0:
        name, body = "email", f"{word()}{pick('', '.', '_')}{digits(rng.randint(0, 3))}@{word()}{pick('', digits(1))}.{word()}{pick('', '.com')}"
    elif kind == 1:
        name, body = "ip", ".".join(str(rng.randint(0, 256)) for _ in range(4))
    elif kind in (2, 3):
        number = digits(15)
        number = next(number + str(d) for d in range(10) if luhn(number + str(d)))
        sep = pick("", " ", "-")
        name, body = "card", sep.join(number[i : i + 4] for i in range(0, 16, 4))
        if kind == 3:
            name, body = None, digits(pick(10, 14, 16)) if not sep else digits(4) + sep + digits(2)
            if luhn(body):
                body = body[:-1] + str((int(body[-1]) + 1) % 10)
    elif kind in (4, 5):
        a, b, c = digits(3), digits(3), digits(4)
        name, body = "phone", pick(f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}){b}-{c}")
    elif kind in (6, 7, 8, 9):
        lead, name = pick("password=", "passwd: ", 'token = "', "api_key=", "secret: ", 'key = "'), "secret"
        before += lead
        after = ('"' if lead.endswith('"') else "") + after
        body = pick(hexes(pick(12, 16, 20, 24, 32, 40)), upper(16) + word() + digits(2), word() + digits(4) + word())
    elif kind == 10:
        name, body = "secret", "AKIA" + upper(16)
    elif kind == 11:
        body = pick(digits(1) + ".", f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{rng.randint(300, 999)}.{digits(1)}.{digits(2)}.{digits(3)}")
    elif kind == 12:
        body = pick(str(rng.randint(1800, 2030)), f"{rng.randint(1, 13)}/{digits(2)}/{digits(4)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}")
    elif kind == 13:
        body = pick(f"${digits(2)}.{digits(2)}", f"{digits(2)}%", f"{digits(3)},{digits(3)}", f"{digits(1)}th", f"A{digits(1)}", f"{word()}{digits(1)}", f"@{word()}", f"Q{digits(1)}")
    elif kind == 16:
        # what a word says is secret, letters alone included
        lead, name = pick("password is ", "password: ", "passwd=", "token=", "secret = ", "my password is ", "api_key: ", "passphrase: "), "secret"
        before, body = word() + " " + lead, pick(word() + word(), upper(8).lower(), word().capitalize() + word(), word() + "!" + word())
    elif kind == 17:
        # keys known by their first letters
        name, body = "secret", pick(f"ghp_{mixed(36)}", f"sk-{mixed(pick(20, 32, 48))}", f"xoxb-{digits(11)}-{mixed(24)}", f"glpat-{mixed(20)}", f"sk_live_{mixed(24)}", f"AIza{mixed(35)}")
    elif kind == 18:
        lead, name = pick("aws_secret_access_key = ", "secret_key=", "secret: ", "token: "), "secret"
        before, body = word() + " " + lead, "".join(mixed(pick(3, 6, 9, 13)) + pick("/", "+") for _ in range(pick(1, 2, 3))) + mixed(pick(6, 12, 22))
    elif kind in (19, 20):
        # names of things that aren't secret
        before = word() + " " + pick("commit ", "sha256:", "uuid ", "id ", "md5 ", "checksum ", "", "", "revision ", "(")
        body = pick(f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", hexes(40), hexes(pick(7, 12)), hexes(32), hexes(64))
    elif kind == 21:
        body = pick(f"{digits(3)}-{digits(2)}-{digits(4)}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"ISBN {digits(9)}X", f"ISO 8601-{digits(1)}", f"{digits(3)}-{digits(4)}", f"ORD-{digits(6)}", f"INV{digits(7)}")
    elif kind == 22:
        # such words without a value
        before, body = word() + " ", pick("the token: ", "a secret is ", "the password is ", "this token is ", "secret: ") + pick("not", "a", "that", "kept", "safe", "the", "to", "used", "here", "in")
    elif kind == 23:
        body = pick(f"http://{word()}.com/{word()}/{digits(5)}", f"{word()}.{word()}/{digits(3)}", f"{digits(2)}.{digits(4)}, -{digits(2)}.{digits(4)}", f"{word()}_{digits(3)}", f"{word().capitalize()}{digits(2)}", f"0x{hexes(8)}", f"#{digits(4)}")
    else:
        body = pick(digits(rng.randint(1, 8)), f"({digits(2)})", f"{digits(1)} {digits(1)}", f"[{digits(1)}]", f"{digits(2)}-{digits(2)}")
    at = len(before)
    return before + body + after, [(name, at, at + len(body))] if name else []


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    rng = np.random.RandomState(seed)
    return [_example(rng) for _ in range(n)]


@lru_cache(maxsize=2)
def fitted(n: int = 1600, epochs: int = 5, seed: int = 11) -> Field:
    """Weights that maximise the penalised likelihood of generated examples (AdaGrad)."""
    index: dict[str, int] = {}
    items = []
    for text, truth in examples(n, seed):
        for a, b in islands(text):
            for tokens in _tokens(text, a, b, []):
                spans, features = _segments(text, tokens)
                true = {(s, e): k for k, s, e in truth}
                gold, j = [], 0
                while j < len(tokens):
                    hit = next(((k, e) for (s, e), k in true.items() if s == tokens[j][0]), None)
                    last = next((t for t in range(j, len(tokens)) if hit and tokens[t][1] == hit[1]), None)
                    y, end = (_TYPES.index(hit[0]), last + 1) if last is not None and last - j < MOST_TOKENS else (0, j + 1)
                    gold.append((j, end, y))
                    j = end
                ids = [[index.setdefault(f, len(index)) for f in fs] for fs in features]
                width = max(map(len, ids))
                items.append((spans, np.array([x + [-1] * (width - len(x)) for x in ids]), gold, len(tokens)))
    m, kinds = len(index), len(_TYPES)
    weights, after = np.zeros((m + 1, kinds)), np.zeros((kinds, kinds))
    sum_w, sum_a = np.full(weights.shape, 1e-4), np.full(after.shape, 1e-4)
    order = np.random.RandomState(seed)
    for _ in range(epochs):
        for k in order.permutation(len(items)):
            spans, ids, gold, size = items[k]
            score = weights[ids].sum(axis=1)
            long = np.array([j - i > 1 for i, j in spans])
            score[long, 0] = -1e30
            ends: list[list[int]] = [[] for _ in range(size + 1)]
            starts: list[list[int]] = [[] for _ in range(size + 1)]
            for s, (i, j) in enumerate(spans):
                ends[j].append(s), starts[i].append(s)
            from_, to = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
            alpha, beta = np.full((size + 1, kinds), -1e30), np.full((size + 1, kinds), 0.0)
            alpha[0, 0] = 0.0
            for j in range(1, size + 1):
                e = ends[j]
                alpha[j] = _lse(_lse(alpha[from_[e]][:, :, None] + after, 1) + score[e], 0)
            for i in range(size - 1, -1, -1):
                s = starts[i]
                beta[i] = _lse(_lse(after[None] + (score[s] + beta[to[s]])[:, None, :], 2), 0)
            total = _lse(alpha[size], 0)
            joint = np.exp(np.minimum(0, alpha[from_][:, :, None] + after + (score + beta[to])[:, None, :] - total))
            grad_w, grad_a = -joint.sum(axis=1), -joint.sum(axis=0)
            prev = 0
            where = {s: t for t, s in enumerate(spans)}
            for i, j, y in gold:
                grad_w[where[i, j], y] += 1
                grad_a[prev, y] += 1
                prev = y
            step = np.zeros_like(weights)
            np.add.at(step, ids.reshape(-1), np.repeat(grad_w, ids.shape[1], axis=0))
            rows = np.unique(ids)
            rows = rows[rows >= 0]
            g = step[rows] - 1e-4 * weights[rows]
            sum_w[rows] += g * g
            weights[rows] += 0.4 * g / np.sqrt(sum_w[rows])
            sum_a += grad_a * grad_a
            after += 0.2 * grad_a / np.sqrt(sum_a)
            weights[m] = 0
    return Field(index, weights[:m], after)


def find_spans(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    """All spans as (kind, start, end, fixed), by kind and start."""
    base = base_spans(text)
    more = field.spans(text, [(a, b) for _, a, b in base]) if _TRIGGER.search(text) else []
    return sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each stretch of overlapping spans becomes [KIND] of its first span."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_())])))])


def _scan(field: Field, redacted: bool):
    def run(batches):
        for batch in batches:
            for rows in slices(batch, limit=4 << 20):
                found, new = [], []
                for text in rows.column("text").to_pylist():
                    spans = find_spans(text, field) if text else []
                    found.append([dict(zip(("kind", "start", "end", "fixed"), s)) for s in spans])
                    new.append(None if not redacted else redact(text, spans) if spans else text)
                out = {"spans": pa.array(found, _FOUND.field("spans").type), "text": pa.array(new, pa.string())}
                yield pa.RecordBatch.from_arrays([out.get(n, rows.column(i) if n != "spans" else None) for i, n in enumerate([*batch.schema.names, "spans"])], names=[*batch.schema.names, "spans"])

    return run


_SPANS = "array<struct<kind:string,start:long,end:long,fixed:boolean>>"


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for each row: kind, start and end in code points (end exclusive), and
    whether a fixed pattern found it; by kind, then start.  Null or empty text: no spans.  Null
    ids are kept, repeated rows are scanned each, no rows in, no rows out; other columns are
    ignored."""
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(spared(_scan(fitted(), False)), f"doc_id long, text string, spans {_SPANS}").select("doc_id", "spans")


def redact_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets.  Null text stays
    null; all other columns are as they were, whatever their names."""
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*[f"c{i}" if i != at else "text" for i in range(len(names))])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(spared(_scan(fitted(), True)), f"{fields}, spans {_SPANS}").drop("spans").toDF(*names)
