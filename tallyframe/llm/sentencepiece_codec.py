"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text becomes pieces of a given vocabulary. Of all segmentations, one is drawn with probability
proportional to the product of its pieces' weights: forward sums over the lattice of pieces, then pieces
drawn backwards from the end. Pieces never cross the start of a run of spaces, so the lattice of a text
is a chain of independent lattices, one for each word with the spaces before it. Each distinct word is
filtered once in a task; all words of a batch then step backwards together, in array operations.

Draws are a counter-based hash of (seed, row key, word number, step): a row gives the same pieces in any
partitioning and any rerun. The vocabulary file holds merge ranks, not probabilities; a piece of rank r
weighs (r + 1) ** -alpha, and each byte of a character that is not in the vocabulary `byte_weight`. The larger alpha, the
more the draws prefer common pieces.

Lossless: spaces become the space mark, and one is put before the text; a literal space mark in the text
is spelled in bytes, as is every character outside the vocabulary, so decoding restores each text exactly.

Cases: a null text has null ids and decodes to null; an empty one has no ids. A null key is a key of its
own. Repeated rows get the same ids. Very long words are sampled like others, in time linear in their
length. Empty tables give no rows. Extra columns pass through unless named like a result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mixed, release
from .common import fresh, table

MARK = "▁"
#: Stands for a space mark that the text itself holds; valid text holds no lone surrogate.
_OWN_MARK = "\ud800"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, ALPHA, BYTE_WEIGHT = 1, 1.0, 1e-6
#: Characters of distinct words whose lattices a task remembers; beyond them it starts again.
REMEMBERED_CHARS = 2 << 20
#: Words that step backwards together, about.
TOGETHER = 1 << 17
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Upper bits of a piece's hash that index it directly; the few that share them are neighbours.
_SLOT_BITS = 16
_SLOT_SHIFT = np.uint64(64 - _SLOT_BITS)


def model_bytes(path: str = MODEL) -> bytes:
    """The vocabulary file; about 0.5 MB, read where the job is declared and sent along with the code."""
    with open(path, "rb") as f:
        return f.read()


def _rolled(chars: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points; the hash of a longer piece follows from that of its start."""
    h = np.zeros(len(chars), np.uint64)
    for column in chars.T:
        h = (h ^ column) * _GOLDEN
    return h


class Vocabulary:
    """Pieces, weights, and the bytes that each id decodes to."""

    def __init__(self, model: bytes, alpha: float = ALPHA, byte_weight: float = BYTE_WEIGHT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = {sp.id_to_piece(i): (i, float(i - plain[0] + 1) ** -alpha) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.alpha = alpha
        self.by_length = []  # of each length: hashes of the pieces, ascending, with their ids and weights, and where each hash's upper bits point
        for size in range(1, self.longest + 1):
            own = [(p, *x) for p, x in self.pieces.items() if len(p) == size]
            h = _rolled(np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64).reshape(len(own), size))
            order = np.argsort(h)
            assert len(np.unique(h)) == len(h)
            h = h[order]
            slot = (h >> _SLOT_SHIFT).astype(np.int64)
            table = np.zeros(1 << _SLOT_BITS, np.int32)
            table[slot[::-1]] = np.arange(len(h))[::-1]  # the first of a slot
            most = int(np.bincount(slot).max()) if len(h) else 0
            self.by_length.append((h, np.array([x[1] for x in own], np.int32)[order], np.array([x[2] for x in own])[order], table, most))
        self.byte_weight = byte_weight
        spelled = [b""] * n
        for p, (i, _) in self.pieces.items():
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            spelled[i] = bytes([b])
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many id lists laid end to end, and where each list's bytes end."""
        long = self.length[ids]
        end = np.cumsum(long)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.start[ids] - (end - long), long) + np.arange(total)
        return self.letters[at], np.concatenate([[0], end])[ends]

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of one list of ids, without the space that encoding put before it."""
        if ids is None:
            return None
        raw = self.spell(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes()
        return raw[1:].decode() if ids else ""


class Lattices:
    """Forward sums of the words met so far: for each node its edges, likeliest first, with cumulated shares."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, int] = {}  # a word's last node
        self.edge = array("i", [0])  # a node's first edge; the node of a word's start has no edges
        self.share, self.back, self.piece = array("f"), array("B"), array("i")  # back: the piece's length; piece: an id, or ~k for spelled[k]
        self.spelled: list[bytes] = []
        self.chars = 0

    def add(self, word: str) -> int:
        v, n = self.v, len(word)
        self.chars += n + 4
        first = len(self.edge) - 1
        self.edge.append(len(self.share))
        sums = [1.0] + [0.0] * n
        get, longest = v.pieces.get, v.longest
        for end in range(1, n + 1):
            edges, known = [], False
            for start in range(max(0, end - longest), end):
                if (p := get(word[start:end])) is not None:
                    edges.append((sums[start] * p[1], end - start, p[0]))
                    known = start == end - 1
            if not known:
                raw = MARK.encode() if word[end - 1] == _OWN_MARK else word[end - 1].encode()
                edges.append((sums[end - 1] * v.byte_weight ** len(raw), 1, ~len(self.spelled)))
                self.spelled.append(raw)
            total = sum(e[0] for e in edges)
            sums[end] = total
            if total < 1e-150:  # only ratios count: raise all that later nodes reach
                for k in range(max(0, end - longest), end + 1):
                    sums[k] *= 1e150
            edges.sort(reverse=True)
            so_far = 0.0
            for w, back, piece in edges:
                so_far += w / total
                self.share.append(so_far)
                self.back.append(back)
                self.piece.append(piece)
            self.share[-1] = 2.0  # the last edge takes what rounding left
            self.edge.append(len(self.share))
        self.word[word] = first + n
        return first + n

    def add_many(self, words: list[str]) -> None:
        """add() for many words at once; those that are long or mostly spelled in bytes go one by one, with their sums kept in range."""
        v = self.v
        short = [w for w in words if len(w) <= 32] if v.alpha <= 1 else []
        for w in words if v.alpha > 1 else [w for w in words if len(w) > 32]:
            self.add(w)
        for at in range(0, len(short), 1 << 14):
            self._add_short(short[at : at + (1 << 14)])

    def _add_short(self, short: list[str]) -> None:
        v = self.v
        size = np.fromiter(map(len, short), np.int64, len(short))
        end = np.cumsum(size)
        begin = end - size
        chars = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(short)), size)
        left = (end[word] - np.arange(len(chars))).astype(np.int64)  # characters from here to the word's end
        h, at = np.zeros(len(chars), np.uint64), np.arange(len(chars))
        found = []
        for n, (keys, ids, weights, slots, most) in enumerate(v.by_length, 1):
            stay = left[at] >= n
            at, h = at[stay], h[stay]
            h = (h ^ chars[at + n - 1]) * _GOLDEN
            if not len(keys):
                continue
            k = slots[(h >> _SLOT_SHIFT).astype(np.int64)]
            hit = np.flatnonzero(keys[k] == h)
            hits, which = [hit], [k[hit]]
            for _ in range(1, most):
                k = np.minimum(k + 1, len(keys) - 1)
                near = np.flatnonzero(keys[k] == h)
                hits.append(near)
                which.append(k[near])
            hit, which = np.concatenate(hits), np.concatenate(which)
            found.append((at[hit], n, ids[which], weights[which]))
        known = np.zeros(len(chars), bool)
        known[found[0][0]] = True
        odd = np.flatnonzero(~known)
        many = np.bincount(word[odd], minlength=len(short)) > 4
        if many.any():
            if not many.all():
                self._add_short([w for w, m in zip(short, many.tolist(), strict=True) if not m])
            for w, m in zip(short, many.tolist(), strict=True):
                if m:
                    self.add(w)
            return
        if len(odd):
            raw = [MARK.encode() if c == _OWN_MARK else c.encode() for c in map(chr, chars[odd].tolist())]
            found.append((odd, 1, ~np.arange(len(self.spelled), len(self.spelled) + len(odd), dtype=np.int32), v.byte_weight ** np.array([len(r) for r in raw], np.float64)))
            self.spelled += raw
        found.reverse()  # longer pieces first: they are likelier
        source = np.concatenate([f[0] for f in found])
        target = np.concatenate([f[0] + f[1] for f in found]) + word[source]
        source, piece, weight = source + word[source], np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        order = np.argsort(target, kind="stable")
        source, target, piece, weight = source[order], target[order], piece[order], weight[order]
        first = begin + np.arange(len(short))  # a word of n characters has n + 1 nodes
        nodes = len(chars) + len(short)
        place = np.arange(nodes) - np.repeat(first, size + 1)
        by_place = np.argsort(place[target].astype(np.uint8), kind="stable")
        bounds = np.searchsorted(place[target][by_place], np.arange(1, int(size.max()) + 2))
        sums, value = np.zeros(nodes), np.empty(len(target))
        sums[first] = 1.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = by_place[a:b]
            value[e] = sums[source[e]] * weight[e]
            to = target[e]
            head = np.flatnonzero(np.diff(to, prepend=-1))
            sums[to[head]] = np.add.reduceat(value[e], head)
        count = np.bincount(target, minlength=nodes)
        stop = np.cumsum(count)
        running = np.cumsum(value / sums[target])
        share = running - np.concatenate([[0.0], running])[(stop - count)[target]]
        share[stop[count > 0] - 1] = 2.0  # the last edge takes what rounding left
        base, edges = len(self.edge) - 1, len(self.share)
        self.edge.frombytes((stop + edges).astype(np.int32).tobytes())
        self.share.frombytes(share.astype(np.float32).tobytes())
        self.back.frombytes((target - source).astype(np.uint8).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        self.word.update(zip(short, (first + size + base).tolist(), strict=True))
        self.chars += len(chars) + 4 * len(short)

    def sample(self, node: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end, and how many each has. key: a 64-bit hash for each word."""
        edge, share = np.frombuffer(self.edge, np.int32), np.frombuffer(self.share, np.float32)
        back, piece = np.frombuffer(self.back, np.uint8), np.frombuffer(self.piece, np.int32)
        live, at, steps = np.arange(len(node)), node, []
        while len(live):
            draw = (mixed(key[live] + np.uint64((len(steps) + 1) * int(_GOLDEN) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = edge[at].copy()
            over = np.flatnonzero(draw >= share[e])
            while len(over):
                e[over] += 1
                over = over[draw[over] >= share[e[over]]]
            steps.append((live, piece[e]))
            at = at - back[e]
            more = at != start[live]
            live, at = live[more], at[more]
        count = np.zeros(len(node), np.int64)
        for t, (who, _) in enumerate(steps):
            count[who] = t + 1
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int32)
        for t, (who, what) in enumerate(steps):
            out[last[who] - t] = what
        if (odd := out < 0).any():  # characters in bytes
            long = np.ones(len(out), np.int64)
            raw = [self.spelled[~k] for k in out[odd].tolist()]
            long[odd] = [len(r) for r in raw]
            wide = np.repeat(out, long)
            wide[np.repeat(odd, long)] = self.v.byte[np.frombuffer(b"".join(raw), np.uint8)]
            count = np.add.reduceat(long, np.cumsum(count) - count) if len(count) else count
            out = wide
        return out, count


_KEPT: dict[tuple, Lattices] = {}


def lattices(model: bytes, alpha: float, byte_weight: float) -> Lattices:
    """One per worker and setting."""
    name = (xxhash.xxh64_intdigest(model), alpha, byte_weight)
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Lattices(Vocabulary(model, alpha, byte_weight))
    return _KEPT[name]


def encode_texts(texts: list[str | None], keys: list[str], known: Lattices, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, and where each text's ids end (null: none)."""
    ends, parts, done = np.zeros(len(texts), np.int64), [], 0
    cut, hashes, sizes = [], [], []

    def flush(upto: int, frm: int) -> None:
        nonlocal done
        known.add_many(list(set(chain.from_iterable(cut)) - known.word.keys()))
        node = np.fromiter(map(known.word.__getitem__, chain.from_iterable(cut)), np.int32, sum(sizes))
        long = np.fromiter(map(len, chain.from_iterable(cut)), np.int32, sum(sizes))
        ids, count = known.sample(node, node - long, np.concatenate(hashes))
        total = np.concatenate([[0], np.cumsum(count)])
        ends[frm:upto] = done + total[np.cumsum(sizes)]
        done += len(ids)
        parts.append(ids)
        for x in (cut, hashes, sizes):
            x.clear()
        if known.chars > REMEMBERED_CHARS:
            known.clear()

    frm, waiting = 0, 0
    for i, (text, key) in enumerate(zip(texts, keys, strict=True)):
        found = _WORDS.findall(MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)) if text else []
        cut.append(found)
        row = np.uint64(xxhash.xxh64_intdigest(key, seed=seed))
        with np.errstate(over="ignore"):
            hashes.append(mixed(row + np.arange(len(found), dtype=np.uint64) * _GOLDEN))
        sizes.append(len(found))
        waiting += len(found)
        if waiting >= TOGETHER:
            flush(i + 1, frm)
            frm, waiting = i + 1, 0
    if frm < len(texts):
        flush(len(texts), frm)
    return np.concatenate(parts) if parts else np.empty(0, np.int32), ends


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, model: str = MODEL, seed: int = SEED, alpha: float = ALPHA, byte_weight: float = BYTE_WEIGHT, copies: bool = False) -> DataFrame:
    """`keep` columns (all, if not given) with ids array<int>, n_pieces, text_crc32, and decoded_crc32 of what the ids decode to.

    With `copies`, a row that repeats the key and text of the row before it draws anew, by its number in the run as well.
    """
    proto = model_bytes(model)
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in ("ids", "n_pieces", "text_crc32", "decoded_crc32")]
    (own,) = fresh(df, "key")
    rows = df.select(*names, *([] if text in names else [text]), F.coalesce(F.col(key).cast("string"), F.lit("\0null")).alias(own))
    schema = df.select(*names).schema.add("n_pieces", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType())).add("text_crc32", T.LongType()).add("decoded_crc32", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = lattices(proto, alpha, byte_weight), [None, None, 0]
        try:
            for batch in batches:
                for piece in pieces_of(batch):
                    yield from one(piece, known, last)
        finally:
            known.clear()
            release()

    def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Parts of at most about 4 MB of text, or one row."""
        at, total = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if total and total + (n or 0) > 4 << 20:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)

    def one(batch: pa.RecordBatch, known: Lattices, last: list) -> Iterator[pa.RecordBatch]:
        texts, keys = batch.column(text).to_pylist(), batch.column(own).to_pylist()
        if copies:
            for i, pair in enumerate(zip(keys, texts, strict=True)):
                last[:] = [*pair, last[2] + 1 if tuple(last[:2]) == pair else 0]
                keys[i] = f"{pair[0]}\0{last[2]}" if last[2] else pair[0]
        ids, ends = encode_texts(texts, keys, known, seed)
        null = np.array([t is None for t in texts], bool)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([null, [False]])) if null.any() else pa.array(offsets), pa.array(ids))
        letters, stops = known.v.spell(ids, ends)
        back, raw, begin = [], letters.tobytes(), 0
        for t, stop in zip(texts, stops.tolist(), strict=True):
            back.append(None if t is None else zlib.crc32(raw[begin + 1 : stop]))
            begin = stop
        plain = [None if t is None else zlib.crc32(t.encode()) for t in texts]
        pieces = pa.array(np.diff(offsets), pa.int32(), mask=null)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pieces, lists, pa.array(plain, pa.int64()), pa.array(back, pa.int64())], names=[*names, "n_pieces", "ids", "text_crc32", "decoded_crc32"])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text of its ids."""
    proto = model_bytes(model)

    @F.pandas_udf("string")
    def texts(column):
        v = lattices(proto, ALPHA, BYTE_WEIGHT).v
        return column.map(lambda x: None if x is None else v.decode(list(x)))

    return df.withColumn(out, texts(F.col(ids)))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
