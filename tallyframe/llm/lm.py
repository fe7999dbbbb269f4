"""Language-model scores from an n-gram trie in Elias-Fano form (after Pibiri and Venturini, 2017).

The model: interpolated absolute discounting over whole-word n-grams, down to add-one unigrams. The trie is
dealt into shards by the word before the scored one, so that every level from 2 up of a word's contexts lies
in one shard. A shard's levels are one memory map: the contexts and the pointers to their successors as
Elias-Fano sequences, the successors' keys relative to their context (on level 2 a word's hash, further up
the place among the successors of the context that is one word shorter) and so ascending over the whole
level, again Elias-Fano, and two bytes each for a successor's discounted probability and a context's
back-off weight. Both are rounded down on a logarithmic scale, so no context gives away more than its mass.
Look-ups search the encoded sequences: a select on the high bits finds a bucket, then the packed low bits
are bisected; no sequence is decoded.

The work, each step linear in the text:
1. Words are counted (map-side, then by Spark); the TABLE most frequent ones, a fixed number, are sent along
   with the code: they travel as ranks, and words with more occurrences than a shard holds are known.
2. Tokens, with the words before them, travel to their shard in packed messages; a text that a chunk of
   documents repeats travels once. A chunk sends at most FAN messages; more shards than that are reached in
   several rounds, whose tasks merge messages of bounded size and deal them on. The contexts of a word with
   more occurrences than a shard holds are split over several shards by the scored word.
3. Shards ask by joins for the counts of rarer words, and for the totals of split contexts.
4. Shards build their trie from training tokens, look up all their tokens, and give sums for each text,
   which Spark adds up.
Only the table of words and three totals reach the driver. Occurrences of one n-gram stay together, as about
two bytes for each chunk-wise distinct text that holds it.

Cases: a null text is an empty one: one token, the end. Repeated rows are scored and counted each. A corpus
without training documents scores all with the add-one floor of nothing. Null ids count as the empty text
in the split. Empty tables give no rows. Texts are told by chunk and place in it, so the input is a table,
or anything else whose rows come in the same order when a lost task is repeated.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .blocks import BLOCK_ROWS, WordHashes, hashes, mixed, packed, tidy, unpacked
from .common import crc_mod, stored
from .common import table as read_table

#: Order of the model in op9; the code takes any from 2.
ORDER = 3
DISCOUNT = 0.75
#: Tokens of a shard, about.
SHARD_TOKENS = 3 << 20
#: Words that travel as ranks.
TABLE = 1 << 18
#: Messages of a chunk, and tokens of a task that deals messages on.
FAN, DEALT = 256, 4 << 20
#: Quantisation: a code is 1 - STEPS * log10 p, rounded up; 0 is absent. Two bytes reach down to 10^-16.
STEPS = 4000.0
#: Keys of no word: each holds white space.
END, START = b" ", b"\n"
#: Bits of a word's hash, the upper ones, that tell the words of a context.
TAIL_BITS = 40
_TAIL = np.uint64(TAIL_BITS)
_CUT = np.uint64(64 - TAIL_BITS)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Places of a byte's set bits, in order.
_BITS = np.array([[*[i for i in range(8) if b >> i & 1], *[0] * 8][:8] for b in range(256)], np.int64).ravel()


def _nth(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word's n-th set bit, from 0."""
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8):
        below = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        over = n >= below
        n = n - below * over
        step = over * width
        word = word >> step.astype(np.uint64)
        at += step
    return at + _BITS[(word & np.uint64(255)).astype(np.int64) * 8 + n]


class EliasFano:
    """An ascending sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.size, self.low_bits, self.low, self.high = size, low_bits, low.view(np.uint64), high.view(np.uint64)
        self.mask = np.uint64((1 << low_bits) - 1)
        #: the ones and the zeros before each word of the high bits
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        self.zeros = 64 * np.arange(len(self.high) + 1) - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        high = np.zeros((int(values[-1] >> np.uint64(bits)) + n) // 64 + 3 if n else 2, np.uint64)
        mask = np.uint64((1 << bits) - 1)
        for a in range(0, n, 1 << 18):  # whole words of the low bits each time
            part = values[a : a + (1 << 18)]
            if bits:
                at = np.arange(a, a + len(part), dtype=np.uint64) * np.uint64(bits)
                word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
                own = part & mask
                head = np.flatnonzero(np.diff(word, prepend=-1))
                low[word[head]] |= np.bitwise_or.reduceat(own << shift, head)
                over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
                low[word[over] + 1] |= own[over] >> (np.uint64(64) - shift[over])
            at = (part >> np.uint64(bits)) + np.arange(a, a + len(part), dtype=np.uint64)
            word = (at >> np.uint64(6)).astype(np.int64)
            head = np.flatnonzero(np.diff(word, prepend=-1))
            high[word[head]] |= np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), head)
        return cls(n, bits, low.view(np.uint8), high.view(np.uint8))

    def parts(self) -> list[np.ndarray]:
        low, high = self.low.view(np.uint8), self.high.view(np.uint8)
        return [np.array([self.size, self.low_bits, len(low), len(high)], np.int64).view(np.uint8), low, high]

    @classmethod
    def read(cls, raw: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high = raw[at : at + 32].view(np.int64).tolist()
        at += 32
        return cls(n, bits, raw[at : at + low], raw[at + low : at + low + high]), at + low + high

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        return (self.low[word] >> shift | self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        high = 64 * word + _nth(self.high[word], i - self.ones[word]) - i
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.size))

    def _zero(self, n: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, n, "right") - 1
        return 64 * word + _nth(~self.high[word], n - self.zeros[word])

    def successor(self, value: np.ndarray) -> np.ndarray:
        """The place of the first value that isn't smaller; `size` if there is none."""
        # after the last value's bucket there are empty ones
        bucket = np.minimum(value >> np.uint64(self.low_bits), np.uint64(self.zeros[-1] - 1)).astype(np.int64)
        begin = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) + 1 - bucket, 0)
        end = self._zero(bucket) - bucket
        low, live = value & self.mask, np.flatnonzero(begin < end)
        while len(live):
            middle = (begin[live] + end[live]) >> 1
            less = self._low(middle) < low[live]
            begin[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[begin[live] < end[live]]
        return begin

    def find(self, value: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The place of each value that is known and there, else -1."""
        out = np.full(len(value), -1)
        for a in range(0, len(value) if self.size else 0, 1 << 17):
            ask = a + np.flatnonzero(known[a : a + (1 << 17)])
            at = self.successor(value[ask])
            hit = at < self.size
            hit[hit] = self.get(at[hit]) == value[ask[hit]]
            out[ask[hit]] = at[hit]
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(1 + np.ceil(-STEPS * np.log10(p)), 65535), 0).astype(np.uint16)


_P = np.concatenate([[0.0], 10.0 ** (-np.arange(65535) / STEPS)])


class Shard:
    """One level of one shard: contexts, pointers, successors, codes and weights."""

    def __init__(self, raw: np.ndarray):
        self.contexts, at = EliasFano.read(raw, 0)
        self.pointers, at = EliasFano.read(raw, at)
        self.successors, at = EliasFano.read(raw, at)
        self.codes = raw[at : at + 2 * self.successors.size].view(np.uint16)
        self.weights = raw[at + 2 * self.successors.size :][: 2 * self.contexts.size].view(np.uint16)

    @staticmethod
    def build(context: np.ndarray, begin: np.ndarray, key: np.ndarray, code: np.ndarray, weight: np.ndarray) -> bytes:
        """context: ascending; begin: where each one's successors start; key: ascending within a context."""
        # each context's keys start above all keys of the contexts before it
        last = key[begin[1:] - 1] + np.uint64(1) if len(context) else key
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]]) if len(context) else key
        parts = [EliasFano.of(context).parts(), EliasFano.of(begin.astype(np.uint64)).parts(), EliasFano.of(key + np.repeat(base, np.diff(begin))).parts(), [code, weight]]
        return b"".join(np.ascontiguousarray(x).tobytes() for p in parts for x in p)

    def nodes(self, context: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places of contexts; -1 where one is not known or not there."""
        return self.contexts.find(context, known)

    def begin(self, node: np.ndarray) -> np.ndarray:
        return self.pointers.get(node).astype(np.int64)

    def ask(self, node: np.ndarray, key: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places of the successors `key` of the contexts at `node`; -1 where there is none."""
        ask = np.flatnonzero(known & (node >= 0))
        out = np.full(len(node), -1)
        for part in np.array_split(ask, max(1, len(ask) >> 17)):
            begin, end = self.begin(node[part]), self.begin(node[part] + 1)
            base = np.zeros(len(part), np.uint64)
            later = begin > 0
            base[later] = self.successors.get(begin[later] - 1) + np.uint64(1)
            at = self.successors.find(base + key[part], np.ones(len(part), bool))
            out[part] = np.where((at >= begin) & (at < end), at, -1)
        return out


def mapped(levels: list[bytes]) -> list[Shard]:
    """The levels of a shard, served from one memory map without a file."""
    whole = mmap.mmap(-1, max(1, sum(map(len, levels))))
    for raw in levels:
        whole.write(raw)
    raw, at, out = np.frombuffer(whole, np.uint8), 0, []
    for level in levels:
        out.append(Shard(raw[at : at + len(level)]))
        at += len(level)
    return out


class Table:
    """The most frequent words: hashes by rank, training counts, and over how many shards each one's contexts are split."""

    def __init__(self, word: np.ndarray, count: np.ndarray, ways: np.ndarray):
        self.word, self.count, self.ways = word, count, ways
        self.order = np.argsort(word)
        self.sorted = word[self.order]

    def rank(self, word: np.ndarray) -> np.ndarray:
        """Ranks of words; the number of ranks for those that have none."""
        none = len(self.word)
        if not none:
            return np.zeros(len(word), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, word), none - 1)
        return np.where(self.sorted[at] == word, self.order[at], none).astype(np.int32)


def shard_of(before: np.ndarray, ways: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    """By the word before; where that is split, by the word itself as well."""
    first = (before >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return ((first + mixed(word) % np.minimum(ways, shards).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


class Tokens:
    """Tokens with the words before them, in runs of one text each.

    chunk, place, length, weight: of each run; weight is how often its text trains. code: for the token, the
    word before it, and so on, the ranks in the table; rare: the hashes of those that have none, in order.
    """

    def __init__(self, chunk: np.ndarray, place: np.ndarray, length: np.ndarray, weight: np.ndarray, code: list[np.ndarray], rare: list[np.ndarray]):
        self.chunk, self.place, self.length, self.weight, self.code, self.rare = chunk, place, length, weight, code, rare

    @classmethod
    def joined(cls, parts: list[Tokens]) -> Tokens:
        def lists(name: str) -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*(getattr(p, name) for p in parts), strict=True)]

        return cls(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("chunk", "place", "length", "weight")), lists("code"), lists("rare"))

    def where(self, keep: np.ndarray, table: Table) -> Tokens:
        """Some of the tokens."""
        return next((t for _, t in self.dealt(np.where(keep, 0, 1), 1, table)), Tokens(*[np.empty(0, np.int64)] * 4, [c[:0] for c in self.code], [r[:0] for r in self.rare]))

    def hashes(self, k: int, table: Table) -> np.ndarray:
        out = np.concatenate([table.word, np.zeros(1, np.uint64)])[self.code[k]]
        out[self.code[k] == len(table.word)] = self.rare[k]
        return out

    def dealt(self, to: np.ndarray, ways: int, table: Table) -> Iterator[tuple[int, Tokens]]:
        """The tokens of each destination that has any."""
        none = len(table.word)
        order = np.argsort(to.astype(np.uint16), kind="stable")
        cut = np.searchsorted(to[order], np.arange(ways + 1))
        run = np.repeat(np.arange(len(self.length), dtype=np.int32), self.length)
        nth = [np.cumsum(c == none) - 1 for c in self.code]
        for d in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[d] : cut[d + 1]]
            own = run[at]
            head = np.flatnonzero(np.diff(own, prepend=-1))
            code = [c[at] for c in self.code]
            rare = [r[n[at[c == none]]] for r, n, c in zip(self.rare, nth, code, strict=True)]
            runs = own[head]
            yield d, Tokens(self.chunk[runs], self.place[runs], np.diff(head, append=len(at)), self.weight[runs], code, rare)

    def message(self) -> dict:
        n = sum(map(len, self.code))
        runs = b"".join(np.ascontiguousarray(x).tobytes() for x in (self.chunk.astype(np.int64), self.place.astype(np.uint16), self.length.astype(np.uint32), self.weight.astype(np.uint16)))
        planes = np.concatenate(self.code).astype(np.uint32).view(np.uint8).reshape(n, 4).T[:3]
        return {"tokens": n // len(self.code), "runs": packed(np.frombuffer(runs, np.uint8)), "codes": packed(planes), "rare": np.concatenate(self.rare).tobytes(), "texts": None}

    @classmethod
    def read(cls, row: dict, order: int, table: Table) -> Tokens:
        raw = unpacked(row["runs"], np.uint8)
        m = len(raw) // 16
        planes = unpacked(row["codes"], np.uint8).reshape(3, -1).astype(np.int32)
        code = np.split(planes[0] | planes[1] << 8 | planes[2] << 16, order)
        ends = np.cumsum([(c == len(table.word)).sum() for c in code])
        return cls(
            raw[: 8 * m].view(np.int64), raw[8 * m : 10 * m].view(np.uint16), raw[10 * m : 14 * m].view(np.uint32).astype(np.int64), raw[14 * m :].view(np.uint16).astype(np.int64),
            code, np.split(np.frombuffer(row["rare"], np.uint64), ends[:-1]),
        )


MESSAGES = "shard int, tokens long, runs binary, codes binary, rare binary, texts binary"
_MESSAGES = pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), *((n, pa.binary()) for n in ("runs", "codes", "rare", "texts"))])


class Chunk:
    """Some documents, their distinct texts, and the hashes of all their tokens."""

    def __init__(self, t: pa.RecordBatch, known: WordHashes):
        self.ids, self.keep = t.column("id").to_pylist(), t.column("keep").to_numpy(zero_copy_only=False).astype(bool)
        found: dict[bytes, int] = {}
        self.place = np.fromiter((found.setdefault(x or b"", len(found)) for x in t.column("text").to_pylist()), np.int64, len(self.ids))
        end = np.array([known[END]], np.uint64)
        docs = [np.concatenate([hashes(x, known), end]) for x in found]
        self.size = np.fromiter(map(len, docs), np.int64, len(docs))
        self.word = np.concatenate(docs)
        self.trains = np.bincount(self.place, weights=self.keep, minlength=len(docs)).astype(np.int64)
        self.times = np.bincount(self.place, minlength=len(docs))

    def before(self, values: np.ndarray, k: int, start: int) -> np.ndarray:
        """Of values of the tokens, the one k places before each; the start's, where the text has none."""
        at = np.arange(len(values))
        return np.where(at - np.repeat(np.cumsum(self.size) - self.size, self.size) >= k, values[np.maximum(at - k, 0)], values.dtype.type(start)) if k else values


def chunks(batches: Iterator[pa.RecordBatch], known: WordHashes, most: int) -> Iterator[Chunk]:
    """Parts of about `most` bytes of text and at most BLOCK_ROWS rows; a longer text is a chunk."""
    for batch in batches:
        at, total = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
            if i > at and (total + (n or 0) > most or i - at == BLOCK_ROWS):
                yield Chunk(batch.slice(at, i - at), known)
                at, total = i, 0
            total += n or 0
        if at < batch.num_rows:
            yield Chunk(batch.slice(at), known)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n: in training documents, every: in all); the start counts once for each document, but never trains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for c in chunks(batches, known, most):
            word, which = np.unique(c.word, return_inverse=True)
            n, every = (np.bincount(which, weights=np.repeat(x, c.size)).astype(np.int64) for x in (c.trains, c.times))
            word, n, every = np.append(word, np.uint64(known[START])), np.append(n, 0), np.append(every, c.times.sum())
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(every)], ["word", "n", "every"])

    most = blocks.BLOCK_BYTES
    found = docs.select("text", "keep", "id").mapInArrow(tidy(run), "word long, n long, every long")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def sent(docs: DataFrame, order: int, table: Table, shards: int, total: int, fan: int = FAN) -> DataFrame:
    """Messages of all documents, each with its shard; total: of tokens."""
    rounds, most = 1, blocks.BLOCK_BYTES
    while fan**rounds < shards:
        rounds += 1

    def group(shard: np.ndarray, done: int) -> np.ndarray:
        """Where a shard's tokens go in the round after `done`."""
        return shard // fan ** (rounds - 1 - done)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for i, c in enumerate(chunks(batches, known, most)):
            name = TaskContext.get().partitionId() << 32 | i
            word = [c.before(c.word, k, known[START]) for k in range(order)]
            rank, start = table.rank(c.word), int(table.rank(np.array([known[START]], np.uint64))[0])
            code = [c.before(rank, k, start) for k in range(order)]
            rare = [w[k == len(table.word)] for w, k in zip(word, code, strict=True)]
            every = Tokens(np.full(len(c.size), name), np.arange(len(c.size)), c.size, c.trains, code, rare)
            to = group(shard_of(word[1], np.append(table.ways, 1)[code[1]], word[0], shards), 0)
            # the ids go along to one of the shards
            at = np.argsort(c.place, kind="stable")
            texts = {"place": pa.array(c.place[at].astype(np.int32)), "doc_id": pa.array([c.ids[j] for j in at.tolist()], pa.int64()), "held_out": pa.array(~c.keep[at]), "n_tokens": pa.array(c.size[c.place[at]]), "chunk": pa.array(np.full(len(at), name))}
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, (t := pa.table(texts)).schema) as out:
                    out.write_table(t)
                own = {"shard": int(group(np.array([mixed(np.array([name], np.uint64))[0] % np.uint64(shards)]).astype(np.int64), 0)[0]), "tokens": 0, "texts": sink.getvalue().to_pybytes()}
            yield pa.RecordBatch.from_pylist([own, *({"shard": d} | m.message() for d, m in every.dealt(to, fan, table))], _MESSAGES)

    def onward(done: int):
        def deal(t: pa.Table) -> pa.Table:
            rows = t.to_pylist()
            out = []
            for r in rows:
                if r["texts"] is not None:
                    # the least shard that is reached from here
                    out.append(r | {"shard": r["shard"] * fan})
            parts = [Tokens.read(r, order, table) for r in rows if r["texts"] is None]
            if parts:
                every = Tokens.joined(parts)
                before = every.hashes(1, table)
                shard = group(shard_of(before, np.append(table.ways, 1)[every.code[1]], every.hashes(0, table), shards), done)
                low = int(shard.min())
                out += [{"shard": low + d} | m.message() for d, m in every.dealt(shard - low, int(shard.max()) - low + 1, table)]
            return pa.Table.from_pylist(out, _MESSAGES)

        return deal

    out = docs.mapInArrow(tidy(run), MESSAGES)
    for done in range(1, rounds):
        groups = -(-shards // fan ** (rounds - done))
        parts = F.pmod(F.xxhash64("runs", "texts"), F.lit(max(1, -(-total // (groups * DEALT)))))
        out = out.withColumn("part", parts).groupBy("shard", "part").applyInArrow(tidy(onward(done)), MESSAGES)
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, none of them negative, and which of them each is."""
    place = max(1, len(key) - 1).bit_length()
    if not len(key) or int(key.max()).bit_length() + place > 63:
        values, which = np.unique(key, return_inverse=True)
        return values, which.astype(np.int32)
    # values with their places behind them are sorted much faster than places by value
    both = np.sort(key.astype(np.int64) << place | np.arange(len(key)))
    key = both >> place
    new = np.diff(key, prepend=-1) > 0
    which = np.empty(len(key), np.int32)
    which[both & ((1 << place) - 1)] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], which


class Level:
    """Contexts of one length and the n-grams that they begin, each distinct one once and in ascending order.

    parent, last: of each context, the one that is one word shorter, and its farthest word; name: its hash;
    context, word, up, count: of each n-gram, its context, its word, the n-gram that is one word shorter,
    and how often it trains.
    """

    def __init__(self, parent: np.ndarray | None, last: np.ndarray, name: np.ndarray, context: np.ndarray, word: np.ndarray, up: np.ndarray | None, count: np.ndarray):
        self.parent, self.last, self.name, self.context, self.word, self.up, self.count = parent, last, name, context, word, up, count


class Grams:
    """The words of some tokens in order of their hashes, their levels, and each token's longest n-gram. Uses the tokens up."""

    def __init__(self, every: Tokens, order: int, table: Table):
        none = len(table.word)
        self.runs = every
        self.rare = np.unique(np.concatenate(every.rare))
        names = np.concatenate([table.word, self.rare])
        self.by_hash = np.argsort(names)
        self.names = names[self.by_hash]
        place = np.empty(len(names), np.int32)
        place[self.by_hash] = np.arange(len(names))
        words = []
        for code, rare in zip(every.code, every.rare, strict=True):
            code = code.copy()
            code[code == none] = none + np.searchsorted(self.rare, rare)
            words.append(place[code])
        every.code = every.rare = []
        self.word = words[0]
        trains = np.repeat(every.weight, every.length).astype(np.float64)
        self.levels: list[Level] = []
        wide = max(1, len(self.names)).bit_length()
        low = (1 << wide) - 1
        for k in range(1, order):
            if k == 1:
                parent, (last, context) = None, distinct(words[1])
                name = mixed(self.names[last])
            else:
                key, context = distinct(context.astype(np.int64) << wide | words[k])
                parent, last = key >> wide, key & low
                name = mixed(self.levels[-1].name[parent] * _GOLDEN + self.names[last])
            key, gram = distinct(context.astype(np.int64) << wide | self.word)
            up = None
            if k > 1:
                up = np.empty(len(key), np.int32)
                up[gram] = self.gram
            self.levels.append(Level(parent, last, name, key >> wide, key & low, up, np.bincount(gram, weights=trains, minlength=len(key))))
            self.gram = gram
        self.split = np.append(table.ways, np.ones(len(self.rare), np.int64))[self.by_hash] > 1

    def splits(self) -> Iterator[tuple[Level, np.ndarray]]:
        """Each level, and which of its contexts are split over shards."""
        of = None
        for level in self.levels:
            of = self.split[level.last] if level.parent is None else of[level.parent]
            yield level, of

    def sums(self, level: Level) -> tuple[np.ndarray, np.ndarray]:
        """Of each context: training tokens, and distinct ones, in this shard."""
        return np.bincount(level.context, weights=level.count, minlength=len(level.last)), np.bincount(level.context, weights=level.count > 0, minlength=len(level.last))

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, n, d): this shard's part of split contexts."""
        rows = []
        for level, split in self.splits():
            n, d = self.sums(level)
            own = split & (n > 0)
            rows.append((level.name[own], n[own], d[own]))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))

    def trie(self, name: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: float) -> list[bytes]:
        """The levels; name: ascending, of split contexts, with their totals and distinct words over all shards."""
        out = []
        for k, (level, split) in enumerate(self.splits()):
            n, d = self.sums(level)
            own = np.flatnonzero(split & (n > 0))
            at = np.searchsorted(name, level.name[own])
            n[own], d[own] = total[at], kinds[at]
            seen = np.flatnonzero(level.count > 0)
            of = level.context[seen]
            used, begin = np.unique(of, return_index=True)
            begin = np.append(begin, len(seen))
            code, weight = quantised((level.count[seen] - discount) / n[of]), quantised(discount * d[used] / n[used])
            if k == 0:
                context, key = self.names[level.last[used]], self.names[level.word[seen]] >> _CUT
            else:
                context = node[level.parent[used]].astype(np.uint64) << _TAIL | self.names[level.last[used]] >> _CUT
                key = (place[level.up[seen]] - first[level.parent[of]]).astype(np.uint64)
            out.append(Shard.build(context, begin, key, code, weight))
            node, first, place = np.full(len(level.last), -1), np.zeros(len(level.last), np.int64), np.full(len(level.count), -1)
            node[used], first[used], place[seen] = np.arange(len(used)), begin[:-1], np.arange(len(seen))
        return out

    def probabilities(self, trie: list[Shard], plain: np.ndarray) -> np.ndarray:
        """Of each n-gram of the last level; plain: of each word by itself."""
        for k, (level, shard) in enumerate(zip(self.levels, trie, strict=True)):
            tails = self.names[level.last] >> _CUT
            if k == 0:
                new = shard.nodes(self.names[level.last], np.ones(len(tails), bool))
                key, known, lower = self.names[level.word] >> _CUT, np.ones(len(level.word), bool), plain[level.word]
            else:
                parent = node[level.parent]
                new = shard.nodes(np.maximum(parent, 0).astype(np.uint64) << _TAIL | tails, parent >= 0)
                at = place[level.up]
                key, known, lower = np.maximum(at - first[level.parent[level.context]], 0).astype(np.uint64), at >= 0, p[level.up]
            node = new
            place = shard.ask(node[level.context], key, known)
            first = np.zeros(len(node), np.int64)
            first[node >= 0] = shard.begin(node[node >= 0])
            weight = np.zeros(len(node), np.uint16)
            weight[node >= 0] = shard.weights[node[node >= 0]]
            code = np.zeros(len(place), np.uint16)
            code[place >= 0] = shard.codes[place[place >= 0]]
            weight = weight[level.context]
            p = np.where(weight > 0, np.minimum(_P[code] + _P[weight] * lower, 1.0), lower)
        return p


class Model:
    """The words' counts, the messages of all documents, and the answers to what shards ask."""

    def __init__(self, df: DataFrame, train: Column, order: int, doc_id: str, text: str, shard_tokens: int = SHARD_TOKENS, fan: int = FAN, ranked: int = TABLE):
        if order < 2:
            raise ValueError("order is 2 at least")
        docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("keep"))
        self.order, self.words = order, stored(word_counts(docs))
        n, v, every = self.words.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.sum("every")).first()
        self.n, self.v = n or 0, v
        top = self.words.orderBy(F.desc("every"), "word").limit(ranked).toArrow()
        word, count, times = (top.column(x).to_numpy() for x in ("word", "n", "every"))
        self.table = Table(word.view(np.uint64), count, -(-times // shard_tokens))
        self.shards = max(1, -(-(every or 0) // shard_tokens))
        self.messages = sent(docs, order, self.table, self.shards, every or 0, fan)
        self.answers = self._answers()

    def reader(self):
        """A function of a shard's messages: those that hold texts, and the tokens, if there are any."""
        order, table = self.order, self.table

        def read(t: pa.Table) -> tuple[list[dict], Tokens | None]:
            rows = t.to_pylist()
            parts = [Tokens.read(r, order, table) for r in rows if r["texts"] is None]
            return [r for r in rows if r["texts"] is not None], Tokens.joined(parts) if parts else None

        return read

    def _answers(self) -> DataFrame:
        """(shard, key, n, d): of rarer words the training count (d: 0), of split contexts the totals."""
        read, order, table = self.reader(), self.order, self.table
        ways = np.append(table.ways, 1)

        def run(key: tuple, t: pa.Table) -> pa.Table:
            _, tokens = read(t)
            rows = []
            if tokens:
                rare = np.unique(tokens.rare[0])
                rows = [(rare, np.zeros(len(rare)), np.zeros(len(rare)))]
                split = tokens.where(ways[tokens.code[1]] > 1, table)
                if len(split.length):
                    rows.append(Grams(split, order, table).parts())
            name, n, d = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.uint64), np.empty(0), np.empty(0))
            return pa.table({"shard": pa.array(np.full(len(name), key[0].as_py(), np.int32)), "key": pa.array(name.view(np.int64)), "n": pa.array(n.astype(np.int64)), "d": pa.array(d.astype(np.int64))})

        asks = self.messages.groupBy("shard").applyInArrow(tidy(run), "shard int, key long, n long, d long")
        counts = self.words.where("n > 0").select(F.lit(None).cast("int").alias("shard"), F.col("word").alias("key"), "n", F.lit(0).cast("long").alias("d"))
        # a word's count comes from one row, a context's totals from those of its shards: at most one row a shard and key
        key = Window.partitionBy("key")
        return asks.unionByName(counts).select("shard", "key", F.sum("n").over(key).alias("n"), F.sum("d").over(key).alias("d")).where("shard is not null")

    def tried(self, run, schema: str) -> DataFrame:
        """run(texts, grams, answers, shard) of each shard."""
        read, order, table = self.reader(), self.order, self.table

        def call(key: tuple, t: pa.Table, got: pa.Table) -> pa.Table:
            texts, tokens = read(t)
            return run(texts, Grams(tokens, order, table) if tokens else None, *(got.column(x).to_numpy() for x in ("key", "n", "d")), key[0].as_py())

        return self.messages.groupBy("shard").cogroup(self.answers.groupBy("shard")).applyInArrow(tidy(call), schema)


def by_name(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Hashes, which travel as signed numbers, and values in their order."""
    name = key.view(np.uint64)
    order = np.argsort(name)
    return [name[order], *(x[order] for x in values)]


def trie_of(g: Grams, key: np.ndarray, n: np.ndarray, d: np.ndarray, discount: float) -> list[bytes]:
    context = d > 0
    return g.trie(*by_name(key[context], n[context], d[context]), discount)


def tries(df: DataFrame, train: Column, order: int = 2, discount: float = DISCOUNT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The model itself: (level, shard, trie), as Shard reads it. Level 1, dealt by word, has one context and add-one probabilities."""
    model = Model(df, train, order, doc_id, text)
    n, v = model.n, model.v

    def words(key: tuple, t: pa.Table) -> pa.Table:
        name, count = by_name(t.column("word").to_numpy(), t.column("n").to_numpy())
        raw = Shard.build(np.zeros(1, np.uint64), np.array([0, len(name)]), name >> _CUT, quantised((count + 1) / (n + v + 1)), np.zeros(1, np.uint16))
        return pa.table({"level": pa.array([1], pa.int32()), "shard": pa.array([key[0].as_py()], pa.int32()), "trie": pa.array([raw], pa.binary())})

    def levels(texts: list, g: Grams | None, key: np.ndarray, n: np.ndarray, d: np.ndarray, shard: int) -> pa.Table:
        raw = trie_of(g, key, n, d, discount) if g else []
        return pa.table({"level": pa.array(range(2, 2 + len(raw)), pa.int32()), "shard": pa.array([shard] * len(raw), pa.int32()), "trie": pa.array(raw, pa.binary())})

    first = model.words.where("n > 0").withColumn("shard", F.pmod("word", F.lit(model.shards)).cast("int")).groupBy("shard").applyInArrow(words, "level int, shard int, trie binary")
    return first.unionByName(model.tried(levels, "level int, shard int, trie binary"))


_PARTS = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("texts", pa.binary()), ("sums", pa.binary())])
_SUMS = np.dtype([("place", np.uint16), ("known", np.uint32), ("base", np.float64), ("score", np.float64)])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, train: Column, order: int = 2, discount: float = DISCOUNT, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """Scores of all documents by the model of those where `train` holds. sizes: shard_tokens, fan and ranked words, which don't change results."""
    model = Model(df, train, order, doc_id, text, **sizes)
    n, v = model.n, model.v
    floor = float(np.log10(float(n + v + 1)))
    table = model.table

    def run(texts: list, g: Grams | None, key: np.ndarray, count: np.ndarray, d: np.ndarray, shard: int) -> pa.Table:
        """Sums of this shard's tokens, for each chunk those of its texts."""
        out = [{"chunk": pa.ipc.open_stream(r["texts"]).read_all().column("chunk")[0].as_py(), "texts": r["texts"]} for r in texts]
        if g:
            trie = mapped(trie_of(g, key, count, d, discount))
            # of words: the table's counts and the answers, in order of hashes
            name, found = by_name(key[d == 0], count[d == 0])
            at = np.minimum(np.searchsorted(name, g.rare), max(0, len(name) - 1))
            rare = np.where(name[at] == g.rare, found[at], 0) if len(name) else np.zeros(len(g.rare), np.int64)
            seen = np.concatenate([table.count, rare])[g.by_hash]
            logs = np.log10(g.probabilities(trie, (seen + 1) / (n + v + 1)))[g.gram]
            runs = g.runs
            begin = np.cumsum(runs.length) - runs.length
            sums = np.empty(len(begin), _SUMS)
            sums["place"], sums["known"] = runs.place, np.add.reduceat((seen > 0)[g.word].astype(np.int64), begin)
            sums["base"], sums["score"] = np.add.reduceat(np.log10(seen + 1.0)[g.word], begin), np.add.reduceat(logs, begin)
            names, of = np.unique(runs.chunk, return_inverse=True)
            sums = sums[np.argsort(of, kind="stable")]
            ends = np.cumsum(np.bincount(of))
            out += [{"chunk": c, "shard": shard, "sums": sums[b:e].tobytes()} for c, b, e in zip(names.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.Table.from_pylist(out, _PARTS)

    def total(t: pa.Table) -> pa.Table:
        """The documents of a chunk with the sums of their texts over all shards."""
        rows = t.to_pylist()
        docs = pa.ipc.open_stream(next(r["texts"] for r in rows if r["texts"])).read_all()
        place = docs.column("place").to_numpy()
        sums = np.concatenate([np.frombuffer(r["sums"], _SUMS) for r in sorted((r for r in rows if r["sums"]), key=lambda r: r["shard"])])
        known, base, score = (np.bincount(sums["place"], weights=sums[x], minlength=place.max() + 1)[place] for x in ("known", "base", "score"))
        size = docs.column("n_tokens").to_numpy()
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": docs.column("n_tokens"), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), n, np.int64)), "base_score": pa.array(base - size * floor), "score": pa.array(score),
        })

    return model.tried(run, "chunk long, shard int, texts binary, sums binary").groupBy("chunk").applyInArrow(tidy(total), SCORES)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2, order=ORDER)
