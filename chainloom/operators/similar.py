"""Pairs of similar strings, exactly, where a distance of counts bounds the similarity.

A string becomes integer counts (of characters, of hashed trigrams).  Written in
unary and folded by exclusive or to 128 bits, two strings' codes differ in at most
as many places as their counts do, so a pair whose codes differ in more places than
the similarity allows is no match; every other pair is verified.  The two sides meet
in a grid of cells, one partition a cell: nothing is collected or broadcast, and the
shuffle holds each string once for every row or column of the grid.

Where only the best matches of a string count, each cell keeps these and no others, and
the strings travel in compressed blocks, so that what is written follows the input and
the matches kept, not the pairs.

Null strings match nothing; equal strings count once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.sources.checkpoints import stored

#: Most strings of a side in a cell, least number of cells, pairs verified at once.
SIDE, CELLS, VERIFIED = 131_072, 12, 65_536
_EPS, _SUM = 1e-9, (1 << 31) - 1
_OUT = "a string, b string, score double"


class Characters:
    """Indel similarity 2 LCS / (len a + len b): the counts of characters differ by
    at most (1 - least) (len a + len b)."""

    def __init__(self, least: float):
        self.least = least

    def encode(self, text: str) -> tuple[int, int, bytes]:
        code = 0
        for ch, n in Counter(text).items():
            slot = ord(ch) - 97 if "a" <= ch <= "z" else 36 if ch == " " else 26 + ord(ch) % 10 if ch.isascii() else 37 + ord(ch) % 5
            for level in range(n):
                code ^= 1 << (slot * 3 + (level if level < 3 else level * 41)) % 128
        return len(text), code, b""

    def differing(self, a: int, b: np.ndarray) -> np.ndarray:
        """Most differing places for sizes a and b, negative where no pair of these sizes matches."""
        most = (1 - self.least) * (a + b) + _EPS
        return np.where(np.abs(b - a) <= most, most, -1)

    def scores(self, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, of, where, full = np.empty(len(i)), -1, {}, 0
        for n, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            if x != of:
                of, text, where = x, a.texts[x], {}
                for p, ch in enumerate(text):
                    where[ch] = where.get(ch, 0) | 1 << p
                full = (1 << len(text)) - 1
            row = full
            for ch in b.texts[y]:
                u = row & where.get(ch, 0)
                row = (row + u | row - u) & full
            size = len(text) + len(b.texts[y])
            out[n] = 2 * (len(text) - row.bit_count()) / size if size else 1.0
        return out


class Trigrams:
    """Cosine of signed counts of hashed trigrams.  Integer counts u and v differ in
    sum by at most |u - v|^2 = |u|^2 + |v|^2 - 2 uv."""

    def __init__(self, least: float, size: int = 256):
        self.least, self.size = least, size

    def encode(self, text: str) -> tuple[int, int, bytes]:
        """Squared norm and sum of the counts, the code, and bucket and sign of each trigram."""
        padded, counts, places = f" {text} ", Counter(), []
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            sign = h >> 16 & 1
            counts[h % self.size] += 1 if sign else -1
            places.append(h % self.size * 2 + sign)
        code = 0
        for bucket, n in counts.items():
            for level in range(abs(n)):
                code ^= 1 << (bucket + (64 if n < 0 else 0) + level * 57) % 128
        norm, total = sum(n * n for n in counts.values()), sum(map(abs, counts.values()))
        return norm << 31 | total, code, np.array(places, np.uint16).tobytes()

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, both halves of the codes and the counts of many texts, as ``encode`` makes them."""
        if len(texts) > 32_768:
            made = [self.together(texts[at : at + 32_768]) for at in range(0, len(texts), 32_768)]
            return tuple(np.concatenate(x) for x in zip(*made))
        padded = [f" {t} " for t in texts]
        chars = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) for t in padded])
        runs = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
        known, which = np.unique(runs, return_inverse=True)
        hashes = np.array([zlib.crc32("".join(chr(r >> shift & 0x1FFFFF) for shift in (42, 21, 0)).encode()) for r in known.tolist()], np.int64)
        bucket, sign = (hashes % self.size)[which], np.where(hashes >> 16 & 1, 1, -1)[which]
        begins = ends - [len(t) for t in padded]
        longest = (ends - begins).max()
        counts = np.empty((len(texts), self.size), np.int8 if longest < 1 << 7 else np.int16 if longest < 1 << 15 else np.int64)
        sizes, codes = np.empty(len(texts), np.int64), np.empty((len(texts), 16), np.uint8)
        for at in range(0, len(texts), 4096):
            stop = min(at + 4096, len(texts))
            first, last = begins[at], ends[stop - 1] - 2
            row = np.repeat(np.arange(stop - at), ends[at:stop] - begins[at:stop])[: last - first]
            inside = np.arange(first, last) < ends[at:stop][row] - 2
            place = (row * self.size + bucket[first:last])[inside]
            own = np.bincount(place, sign[first:last][inside], (stop - at) * self.size).astype(np.int64)
            held = np.flatnonzero(own)
            n, bit = own[held], held % self.size + np.where(own[held] < 0, 64, 0)
            of, flips, level = held // self.size * 128, np.zeros((stop - at) * 128, np.int64), 0
            while len(n):
                flips += np.bincount(of + (bit + level * 57) % 128, minlength=len(flips))
                level += 1
                more = np.abs(n) > level
                n, bit, of = n[more], bit[more], of[more]
            own = own.reshape(-1, self.size)
            counts[at:stop], sizes[at:stop] = own, (own * own).sum(1) << 31 | np.abs(own).sum(1)
            codes[at:stop] = np.packbits((flips & 1).astype(np.uint8).reshape(-1, 128), axis=1, bitorder="little")
        low, high = np.ascontiguousarray(codes).view("<u8").T
        return sizes, low, high, counts

    def differing(self, a: int, b: np.ndarray) -> np.ndarray:
        norm, norms = a >> 31, b >> 31
        most = norm + norms - 2 * self.least * np.sqrt(norm * norms.astype(np.float64)) + 1e-6
        return np.where((norm > 0) & (norms > 0) & (np.abs((a & _SUM) - (b & _SUM)) <= most), most, -1)

    def scores(self, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # no sum exceeds the larger of two norms
        wide = np.int16 if max(a.sizes.max(), b.sizes.max()) >> 31 < 1 << 15 else np.int64
        inner = np.einsum("nk,nk->n", self.counts(a)[i], self.counts(b)[j], dtype=wide)
        return np.round(inner / np.sqrt((a.sizes[i] >> 31) * (b.sizes[j] >> 31).astype(np.float64)), 9)

    def counts(self, side: Side) -> np.ndarray:
        if side.dense is None:
            places = np.frombuffer(b"".join(side.extra), np.uint16).astype(np.int64)
            row = np.repeat(np.arange(len(side.extra)), [len(x) // 2 for x in side.extra])
            side.dense = np.zeros((len(side.extra), self.size), np.int16)
            np.add.at(side.dense, (row, places >> 1), (places & 1).astype(np.int16) * 2 - 1)
        return side.dense


class Vectors:
    """Inner product of unit vectors of any encoder; every pair is multiplied."""

    def __init__(self, least: float, vector):
        self.least, self.vector = least, vector

    def encode(self, text: str) -> tuple[int, int, bytes]:
        return 0, 0, np.asarray(self.vector(text), np.float32).tobytes()

    def differing(self, a: int, b: np.ndarray) -> np.ndarray:
        return np.zeros(len(b))

    def scores(self, a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("nk,nk->n", self.matrix(a)[i], self.matrix(b)[j], dtype=np.float64)

    def matrix(self, side: Side) -> np.ndarray:
        if side.dense is None:
            side.dense = np.frombuffer(b"".join(side.extra), np.float32).reshape(len(side.extra), -1)
        return side.dense


class Side:
    """The strings of one side of a cell, by size."""

    def __init__(self, rows: pa.Table, kind=None):
        if "size" not in rows.column_names:
            texts = rows["text"].to_pylist()
            sizes, low, high, dense = kind.together(texts)
            order = np.argsort(sizes, kind="stable")
            self.rows = rows.take(order)
            self.sizes, self.low, self.high, self.dense = sizes[order], low[order].astype(np.uint64), high[order].astype(np.uint64), dense[order]
            return
        self.rows = rows = rows.sort_by("size")
        self.texts, self.extra = rows["text"].to_pylist(), rows["extra"].to_pylist()
        self.sizes, self.low, self.high = (rows[c].to_numpy().astype(t) for c, t in (("size", np.int64), ("low", np.uint64), ("high", np.uint64)))
        self.dense = None


def _near(a: Side, b: Side, kind, block: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs whose codes don't exclude a match."""
    i, j, held = [], [], 0
    low, high = b.low, b.high
    mixed, places, fit = (np.empty(block, t) for t in (np.uint64, np.uint8, bool))
    for size in np.unique(a.sizes).tolist():
        most = kind.differing(size, b.sizes)
        fits = most >= 0
        if not fits.any():
            continue
        first, last = int(fits.argmax()), len(fits) - int(fits[::-1].argmax())
        # codes have 128 places, so a byte holds any number of differing ones
        limit = np.clip(np.floor(most), 0, 255).astype(np.uint8)
        for n in range(*np.searchsorted(a.sizes, [size, size + 1]).tolist()):
            x, y = a.low[n], a.high[n]
            for at in range(first, last, block):
                stop = min(at + block, last)
                m, p, f = mixed[: stop - at], places[: stop - at], fit[: stop - at]
                np.bitwise_count(np.bitwise_xor(low[at:stop], x, out=m), out=p)
                hit = np.flatnonzero(np.less_equal(p, limit[at:stop], out=f))
                hit = hit[p[hit] + np.bitwise_count(high[at:stop][hit] ^ y) <= limit[at:stop][hit]] + at
                hit = hit[fits[hit]]
                if len(hit):
                    i.append(np.full(len(hit), n))
                    j.append(hit)
                    held += len(hit)
                    if held >= VERIFIED:
                        yield np.concatenate(i), np.concatenate(j)
                        i, j, held = [], [], 0
    if held:
        yield np.concatenate(i), np.concatenate(j)


def _sum(inputs: list[np.ndarray]) -> list[np.ndarray]:
    """The number of inputs that hold each bit, as the planes of its binary digits."""
    planes = []
    while inputs:
        carries = []
        while len(inputs) > 2:
            x, y, z = inputs.pop(), inputs.pop(), inputs.pop()
            odd, both = x ^ y, x & y
            both |= odd & z
            odd ^= z
            carries.append(both)
            inputs.insert(0, odd)
        if len(inputs) == 2:
            x, y = inputs
            carries.append(x & y)
            inputs = [x ^ y]
        planes.append(inputs[0])
        inputs = carries
    return planes


def _near_counts(a: Side, b: Side, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_near``, where both sides have their counts.  Counts whose distance is at most
    d share at least (sum + other sum - d) / 2; of a's rarest nonzero counts, b must share
    all but what the others can give.  How many b shares is added up for 64 of b at once."""
    total, count = len(b.sizes), -(-len(b.sizes) // 64)
    held = np.zeros((2 * kind.size, count * 8), np.uint8)
    for k in range(kind.size):
        column = b.dense[:, k]
        for sign, bits in enumerate((column > 0, column < 0)):
            held[2 * k + sign, : -(-total // 8)] = np.packbits(bits, bitorder="little")
    bits = held.view("<u8")
    often = np.bitwise_count(bits).sum(1, dtype=np.int64)
    of_size, which = np.unique(b.sizes, return_inverse=True)
    i, j, found = [], [], 0
    for size in np.unique(a.sizes).tolist():
        most = kind.differing(size, of_size)
        if not (most >= 0).any():
            continue
        limit = np.where(most >= 0, np.floor(most), -1).astype(np.int64)
        # what b shares less than all of a's counts, per word of 64 the most that it may
        less = np.where(most >= 0, np.floor(((size & _SUM) - (of_size & _SUM) + most) / 2 + 1e-6), -1).astype(np.int64)
        less = np.maximum.reduceat(np.r_[less[which], np.full(count * 64 - total, -1)], np.arange(0, count * 64, 64))
        used = np.flatnonzero(less >= 0)
        first, last = int(used[0]), int(used[-1]) + 1
        less, limits = less[first:last], np.clip(limit, -1, 128)[which]
        digits, reach = {}, int(less.max()) + 3
        for n in range(*np.searchsorted(a.sizes, [size, size + 1]).tolist()):
            row = a.dense[n]
            own = np.flatnonzero(row)
            own = 2 * own + (row[own] < 0)
            own = own[np.argsort(often[own])][: reach]
            if len(own) not in digits:
                least = np.where(less >= 0, np.maximum(len(own) - less, 0), len(own) + 1)
                digits[len(own)] = [(least >> k & 1).astype(np.uint64) - np.uint64(1) for k in range((len(own) + 1).bit_length())]
            planes = _sum([bits[f, first:last] for f in own.tolist()])
            # whether the number is no less than what it must be: the carry when the complement and one are added
            fits = None
            for k, rest in enumerate(digits[len(own)]):
                if k >= len(planes):
                    fits &= rest
                elif fits is None:
                    fits = planes[k] | rest
                else:
                    either = planes[k] ^ rest
                    fits &= either
                    fits |= np.bitwise_and(planes[k], rest, out=either)
            words = np.flatnonzero(fits)
            if not len(words):
                continue
            places = np.flatnonzero(np.unpackbits(fits[words].view(np.uint8), bitorder="little"))
            hit = (words[places >> 6] + first) * 64 + (places & 63)
            hit = hit[hit < total]
            hit = hit[(np.bitwise_count(b.low[hit] ^ a.low[n]) + np.bitwise_count(b.high[hit] ^ a.high[n])) <= limits[hit]]
            if len(hit):
                i.append(np.full(len(hit), n))
                j.append(hit)
                found += len(hit)
                if found >= VERIFIED:
                    yield np.concatenate(i), np.concatenate(j)
                    i, j, found = [], [], 0
    if found:
        yield np.concatenate(i), np.concatenate(j)


def similar_pairs(left: Column, of_left: DataFrame, right: Column, of_right: DataFrame, kind, side: int = SIDE) -> DataFrame:
    """(a, b, score): the pairs of distinct strings whose similarity of this ``kind``
    is at least its ``least``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            texts = batch.column(0).to_pylist()
            made = [kind.encode(t) for t in texts]
            yield pa.record_batch(
                [pa.array(texts, pa.string()), pa.array([m[0] for m in made], pa.int64()), pa.array([signed(m[1] & half) for m in made], pa.int64()), pa.array([signed(m[1] >> 64) for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())],
                ["text", "size", "low", "high", "extra"],
            )

    def own(df: DataFrame, column: Column) -> DataFrame:
        return stored(df.select(column.alias("text")).where("text is not null").distinct().mapInArrow(encoded, "text string, size bigint, low bigint, high bigint, extra binary"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        a, b = (Side(rows.filter(pc.equal(rows["first"], x))) for x in (True, False))
        for i, j in _near(a, b, kind):
            for at in range(0, len(i), 8192):
                x, y = i[at : at + 8192], j[at : at + 8192]
                scores = kind.scores(a, b, x, y)
                kept = np.flatnonzero(scores >= kind.least - _EPS)
                if len(kept):
                    yield pa.record_batch([pa.array([a.texts[k] for k in x[kept].tolist()], pa.string()), pa.array([b.texts[k] for k in y[kept].tolist()], pa.string()), pa.array(np.minimum(1.0, scores[kept]))], ["a", "b", "score"])

    one, other = own(of_left, left), own(of_right, right)
    columns = max(1, -(-other.count() // side))
    lines = max(1, -(-one.count() // side), -(-CELLS // columns))
    line = F.pmod(F.xxhash64("text"), F.lit(lines)).cast("int")
    column = F.pmod(F.xxhash64("text"), F.lit(columns)).cast("int")
    cells = one.withColumn("first", F.lit(True)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: line * columns + c)))
    cells = cells.unionByName(other.withColumn("first", F.lit(False)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda r: r * columns + column))))
    # merge: the pairs are many more than the size of the input tells
    return cells.repartitionById(lines * columns, "cell").mapInArrow(scan, _OUT).hint("merge")


def _packed(rows: pa.Table) -> bytes:
    """A table as one compressed value; neighbours in order of their text are alike."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.sort_by("text").combine_chunks())
    return zlib.compress(sink.getvalue(), 6)


def _unpacked(blocks: list[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(zlib.decompress(b)).read_all() for b in blocks)


def _best(n: np.ndarray, scores: np.ndarray, target: np.ndarray, close: float, most: int) -> np.ndarray:
    """Places of the pairs kept of each n (which ascend): of its ``most`` best targets
    within ``close`` of the best one, by name where they tie, the best pair each."""
    begins = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
    tops = np.repeat(np.maximum.reduceat(scores, begins), np.diff(np.r_[begins, len(n)]))
    left = np.flatnonzero(tops - scores < close + _EPS)
    left = left[np.lexsort((target[left], -scores[left], n[left]))]
    left = left[np.sort(np.unique(n[left] * (target.max() + 1) + target[left], return_index=True)[1])]
    return left[np.arange(len(left)) - np.searchsorted(n[left], n[left]) < most]


def best_pairs(windows: DataFrame, phrases: DataFrame, kind, close: float, most: int, side: int = 2 * SIDE) -> DataFrame:
    """Input (text, strict) and (text, target, loud); output (text, strict, target,
    score): of the pairs whose similarity of this ``kind`` is at least its ``least``,
    those that can be among the ``most`` best targets within ``close`` of the best one of
    a (text, strict), a few of them more than once.  A loud phrase is none for a strict text."""
    encoded = not hasattr(kind, "together")

    def blocks(df: DataFrame, parts: int) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            rows = pa.Table.from_batches(held)
            texts = rows["text"].to_pylist()
            if encoded:
                half, made = (1 << 64) - 1, [kind.encode(t) for t in texts]
                for name, values in (("size", [m[0] for m in made]), ("low", [m[1] & half for m in made]), ("high", [m[1] >> 64 for m in made])):
                    rows = rows.append_column(name, pa.array(values, pa.uint64()))
                rows = rows.append_column("extra", pa.array([m[2] for m in made], pa.binary()))
            part = np.array([zlib.crc32(t.encode()) % parts for t in texts])
            for p in np.unique(part).tolist():
                own = rows.filter(pa.array(part == p))
                for at in range(0, len(own), SIDE):
                    yield pa.record_batch([pa.array([p], pa.int32()), pa.array([_packed(own.slice(at, SIDE))], pa.binary())], ["part", "block"])

        return df.mapInArrow(pack, "part int, block binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: [], False: []}
        for batch in batches:
            for first, block in zip(batch["first"].to_pylist(), batch["block"].to_pylist()):
                held[first].append(block)
        if not held[True] or not held[False]:
            return
        a, b = (Side(_unpacked(held[x]), kind) for x in (True, False))
        del held
        strict, loud = (x.rows[c].to_numpy() for x, c in ((a, "strict"), (b, "loud")))
        rank = pc.rank(b.rows["target"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        for i, j in (_near if encoded else _near_counts)(a, b, kind):
            scores = np.minimum(1.0, np.concatenate([kind.scores(a, b, i[at : at + 8192], j[at : at + 8192]) for at in range(0, len(i), 8192)]))
            kept = np.flatnonzero((scores >= kind.least - _EPS) & ~(strict[i] & loud[j]))
            if len(kept):
                kept = kept[_best(i[kept], scores[kept], rank[j[kept]], close, most)]
                x, y = a.rows.take(i[kept]), b.rows.take(j[kept])
                yield from pa.table([x["text"], x["strict"], y["target"], pa.array(scores[kept])], ["text", "strict", "target", "score"]).to_batches()

    one, other = (stored(df.where("text is not null").distinct()) for df in (windows, phrases))
    columns = max(1, -(-other.count() // side))
    lines = max(1, -(-one.count() // side), -(-CELLS // columns))
    cells = blocks(one, lines).select(F.lit(True).alias("first"), "block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.col("part") * columns + c)).alias("cell"))
    cells = cells.unionByName(blocks(other, columns).select(F.lit(False).alias("first"), "block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda r: r * columns + F.col("part"))).alias("cell")))
    target = phrases.schema["target"].dataType.simpleString()
    return cells.repartitionById(lines * columns, "cell").mapInArrow(scan, f"text string, strict boolean, target {target}, score double")
