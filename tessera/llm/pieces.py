"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins, again and again, the two neighbouring pieces whose union has the best
score; candidates wait in an agenda.  With dropout each candidate that comes up is skipped at the given
rate: a hash of seed, document, place of the chunk in the text, place in the chunk and union is its
coin.  So each occurrence of a word is cut on its own, and every run gives the same ids.  What is skipped
stays in smaller pieces, hence decoding gives the same text.

No piece joins a blank to what stands before it, so a text is cut into chunks (blanks and what
follows) with an agenda each.  All chunks of a slice of texts go through their agendas together: in
each round every chunk's best candidate comes up, as NumPy arrays over the slice.  Nothing is
remembered from one slice to the next.  Chunks longer than LONG go through a heap one by one.  A literal
U+2581, which the model would take for a blank, is sent as bytes.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix, slices, spared, utf8

#: The model's mark for a blank, and where its file lies.
BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk that goes through the rounds (LONG at most), bits of a place in it, bytes of a slice.
LONG, PLACE_BITS, SLICE = 48, 6, 128 << 10
_NONE = np.int32(0x7FFFFFFF)
#: Factors of a coin's place and union.
_AT, _OF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _fields(data: bytes):
    """(field, value) of a protocol-buffer message; lengths-delimited values as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A merge-type model: pieces, their scores, and which pairs of pieces make a piece."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        kinds, scores = [], []
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, 1))
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (1, 4)}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        if len(self.byte) != 256:
            raise ValueError("the model has no bytes to fall back on")
        # best score first; of equal scores the first in the chunk
        levels = {x: r for r, x in enumerate(sorted({scores[i] for i in self.id.values()}, reverse=True))}
        self.unknown = len(self.pieces)
        self.width = self.unknown + 1
        self.bits = self.width.bit_length()
        # pair of pieces to level and union
        self.join: dict[int, int] = {}
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                left, right = self.id.get(piece[:cut]), self.id.get(piece[cut:])
                if left is not None and right is not None:
                    self.join[left * self.width + right] = levels[scores[i]] << self.bits | i
        self._hash(np.array(list(self.join), np.uint64), np.array(list(self.join.values()), np.int64))
        self.of_char = np.full(0x110000, self.unknown, np.int64)
        for piece, i in self.id.items():
            if len(piece) == 1 and piece != BLANK:
                self.of_char[ord(piece)] = i
        self.of_char[32] = self.id.get(BLANK, self.unknown)
        self.bytes = [p.replace(BLANK, " ").encode() for p in self.pieces]
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.of_byte = np.array([self.byte[b] for b in range(256)], np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table without collisions: keys of a bucket are moved by a distance that suits them all."""
        bits = max(4, int(2 * len(keys)).bit_length())
        few, size = bits - 2, 1 << bits
        self.shift, self.mask = np.uint64(64 - few), np.uint64(size - 1)
        for turn in range(1000):
            # a factor that keeps keys of one bucket apart
            self.factor = _FACTOR + np.uint64(2 * turn)
            h = keys * self.factor
            place, bucket = (h >> np.uint64(24)) & self.mask, h >> self.shift
            if len(np.unique(bucket << np.uint64(bits) | place)) == len(keys):
                break
        self.keys, self.codes, self.moves = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(1 << few, np.uint64)
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(bucket.tolist()):
            buckets.setdefault(b, []).append(k)
        place, taken = place.tolist(), bytearray(size)
        for b, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
            at = [place[k] for k in own]
            move = next(d for d in range(size) if not any(taken[(x + d) & (size - 1)] for x in at))
            self.moves[b] = move
            for k in own:
                x = (place[k] + move) & (size - 1)
                taken[x], self.keys[x], self.codes[x] = 1, int(keys[k]), values[k]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Level and union of pairs, -1 where they don't make a piece."""
        key = left * self.width + right
        h = key.view(np.uint64) * self.factor
        at = (((h >> np.uint64(24)) + self.moves.take(h >> self.shift)) & self.mask).view(np.int64)
        return np.where(self.keys.take(at) == key, self.codes.take(at), -1)

    def cut(self, ids: list[int], skip=None) -> tuple[list[int], list[int]]:
        """Pieces, and their places, that the characters ``ids`` of one chunk come to; the agenda is a heap.
        skip(union, place): whether to skip the candidate that came up."""
        n, join, width, low = len(ids), self.join, self.width, (1 << self.bits) - 1
        ids, agenda = list(ids), []
        for i in range(n - 1):
            code = join.get(ids[i] * width + ids[i + 1])
            if code is not None:
                agenda.append((code >> self.bits, i, i + 1, ids[i], ids[i + 1], code & low))
        heapify(agenda)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        while agenda:
            _, i, j, a, b, whole = heappop(agenda)
            if gone[i] or gone[j] or ids[i] != a or ids[j] != b or after[i] != j:
                continue
            if skip is not None and skip(whole, i):
                continue
            ids[i], gone[j] = whole, 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                code = join.get(whole * width + ids[k])
                if code is not None:
                    heappush(agenda, (code >> self.bits, i, k, whole, ids[k], code & low))
            h = before[i]
            if h >= 0:
                code = join.get(ids[h] * width + whole)
                if code is not None:
                    heappush(agenda, (code >> self.bits, h, i, ids[h], whole, code & low))
        places = [i for i in range(n) if not gone[i]]
        return [ids[i] for i in places], places

    def decode(self, ids) -> str:
        """The text; the blank that encoding puts in front goes."""
        of = self.bytes
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def _model(data: bytes) -> Pieces:
    return Pieces(data)


def load(path: str = MODEL) -> bytes:
    """The model file, read on the driver; half a megabyte that goes along with the task."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes slices of texts with dropout."""

    def __init__(self, model: Pieces, dropout: float, seed: int):
        self.model, self.dropout = model, dropout
        self.seed, self.limit = mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64))[0], np.uint64(min(round(dropout * 2**64), 2**64 - 1))

    def skipped(self, draw: np.ndarray, place: np.ndarray, union: np.ndarray) -> np.ndarray:
        """The coin of each candidate: ``draw`` is its chunk's, of seed, document and place in the text."""
        return mix(draw + place.astype(np.uint64) * _AT + union.astype(np.uint64) * _OF) < self.limit

    def draws(self, documents: np.ndarray, places: np.ndarray) -> np.ndarray:
        return mix(mix(documents.astype(np.int64).view(np.uint64) + self.seed) + places.astype(np.uint64) * _AT)

    def encode(self, data: np.ndarray, offsets: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets) one after the other, and where each text's begin."""
        model = self.model
        full = np.flatnonzero(np.diff(offsets))
        # a blank in front of each text that isn't empty
        data = np.insert(data, offsets[:-1][full], 32)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n, ends = len(chars), np.zeros(len(offsets), np.int64)
        ends[full + 1] = 1
        ends = np.searchsorted(lead, offsets + np.cumsum(ends))
        blank = chars == 32
        first = np.ones(n + 1, bool)
        first[1:n] = blank[1:] & ~blank[:-1]
        first[ends] = True
        base = np.flatnonzero(first)
        size, base = np.diff(base), base[:-1]
        text = np.searchsorted(ends, base, "right") - 1
        row_first = np.searchsorted(base, ends[:-1])
        draw = self.draws(documents[text], np.arange(len(base)) - row_first[text])
        ids = model.of_char.take(chars.astype(np.int64))
        alive = np.ones(n, bool)
        for c in np.flatnonzero(size > LONG).tolist():
            own, at = ids[base[c] : base[c] + size[c]], int(base[c])
            skip = (lambda whole, place, d=draw[c : c + 1]: bool(self.skipped(d, np.array([place]), np.array([whole]))[0])) if self.dropout else None
            got, places = model.cut(own.tolist(), skip)
            alive[at : at + size[c]] = False
            alive[np.array(places) + at] = True
            ids[np.array(places) + at] = got
        few = np.flatnonzero((size > 1) & (size <= LONG))
        if len(few):
            self._rounds(ids, alive, base[few], size[few], draw[few])
        # unknown characters as bytes
        at = np.flatnonzero(alive)
        out = ids[at]
        odd = np.flatnonzero(out == model.unknown)
        counts = np.cumsum(np.concatenate([[0], alive]))[ends]
        if len(odd):
            width = np.diff(np.append(lead, len(data)))[at[odd]]
            many = np.ones(len(out), np.int64)
            many[odd] = width
            whole, place = np.repeat(out, many), np.concatenate([[0], np.cumsum(many)])
            run = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            whole[np.repeat(place[odd], width) + run] = model.of_byte[data[np.repeat(lead[at[odd]], width) + run]]
            out, counts = whole, place[counts]
        return out.astype(np.int32), counts

    def _rounds(self, ids: np.ndarray, alive: np.ndarray, base: np.ndarray, size: np.ndarray, draw: np.ndarray) -> None:
        """The agendas of chunks, all at once: in each round the best candidate of every chunk comes up.
        ids and alive are changed.  Where half of the chunks are done, the others are moved together."""
        model, dropout = self.model, self.dropout > 0
        bits, low = model.bits, (1 << model.bits) - 1
        # the chunks' characters one after the other, and one that joins with nothing
        own = np.cumsum(size) - size
        total = int(size.sum())
        slot = np.repeat(base - own, size) + np.arange(total)
        here, live = np.append(ids[slot], model.unknown), np.ones(total, bool)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        stop = np.zeros(total + 1, bool)
        stop[own] = stop[total] = True
        # of each piece that has a next one: level and union of the two; level and place, to find the best
        codes = model.joined(here[:-1], here[1:])
        codes[stop[1:]] = -1
        ranks = lambda code, place: np.where(code >= 0, (code >> bits << PLACE_BITS) | place, _NONE)
        best = ranks(codes, np.arange(total) - np.repeat(own, size)).astype(np.int32)
        there = len(own)
        while True:
            top = np.minimum.reduceat(best, own)
            go = np.flatnonzero(top != _NONE)
            if len(go) < len(own):
                own, draw, size, top = own[go], draw[go], size[go], top[go]
            if not len(own) or (2 * len(own) < there and total > 4096):
                ids[slot], alive[slot] = here[:-1], live
                if not len(own):
                    return
                at = np.repeat(own - (np.cumsum(size) - size), size) + np.arange(size.sum())
                own, end = np.cumsum(size) - size, np.repeat(np.cumsum(size), size)
                shift = at - np.arange(len(at))
                after = np.where(stop[after[at]], end, after[at] - shift)
                here, live, before, codes, best, slot = np.append(here[at], model.unknown), live[at], before[at] - shift, codes[at], best[at], slot[at]
                there, total = len(own), len(at)
                stop = np.zeros(total + 1, bool)
                stop[own] = stop[total] = True
            place = (top & ((1 << PLACE_BITS) - 1)).astype(np.int64)
            i, begin = own + place, own
            whole = codes.take(i) & low
            if dropout:
                skip = self.skipped(draw, place, whole)
                best[i[skip]] = _NONE
                stay = np.flatnonzero(~skip)
                i, place, whole, begin = i[stay], place[stay], whole[stay], own[stay]
            j = after.take(i)
            k = after.take(j)
            here[i], live[j], best[j], after[i] = whole, False, _NONE, k
            before[np.minimum(k, total - 1)] = i
            code = model.joined(whole, here.take(k))
            code[stop.take(k)] = -1
            codes[i], best[i] = code, ranks(code, place)
            inner = np.flatnonzero(place)
            h = before.take(i[inner])
            code = model.joined(here.take(h), whole[inner])
            codes[h], best[h] = code, ranks(code, h - begin[inner])


@lru_cache(maxsize=1)
def _encoder(data: bytes, dropout: float, seed: int) -> Encoder:
    """One a worker process: the model's tables, some 15 MB."""
    return Encoder(_model(data), dropout, seed)


_IDS = "doc_id long, n_chars long, ids array<int>, decoded string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _run(data: bytes, dropout: float, seed: int, keep: list[str]):
    def run(batches):
        encoder = _encoder(data, dropout, seed)
        parts = pa.array(encoder.model.bytes, pa.binary())
        for batch in batches:
            for rows in slices(batch, limit=SLICE):
                docs = rows.column("doc_id")
                ids, ends = encoder.encode(*utf8(rows.column("text")), docs.fill_null(-1).to_numpy())
                taken = parts.take(pa.array(ids))
                places = np.frombuffer(taken.buffers()[1], np.int32)[: len(ids) + 1][ends] if len(ids) else ends
                body = taken.buffers()[2].to_pybytes() if len(ids) else b""
                decoded = pa.array([body[a + 1 : b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([docs, pc.fill_null(pc.utf8_length(rows.column("text")), 0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), decoded, *[rows.column(k) for k in keep]], schema=pa.schema([*_SCHEMA, *[rows.schema.field(k) for k in keep]]))

    return run


def encode_pieces(docs: DataFrame, dropout: float = 0.1, seed: int = 0, model: str = MODEL, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_chars, ids, decoded, *keep) for each row: the ids of the whole text and what they decode
    to, which is the text.  dropout 0: the model's own segmentation.  Null or empty text: no ids,
    decoded empty.  A null id counts as -1 for the hash; repeated rows give the same ids.  No rows in,
    no rows out; other columns are ignored."""
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be in [0, 1)")
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(k) for k in keep])
    kept = [f"{k} {plain.schema[k].dataType.simpleString()}" for k in keep]
    return plain.mapInArrow(spared(_run(load(model), dropout, seed, list(keep))), ", ".join([_IDS, *kept]))
