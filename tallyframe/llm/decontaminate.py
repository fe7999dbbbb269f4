"""Benchmark decontamination by generalised suffix automata of the normalised test items.

1. Items are cut into words (A-Z lowered) and dealt into parts of bounded size; one suffix automaton is built
   for each part, on the executors. Each state knows the state of its last `window` words, the next state up
   its suffix links that is a whole short item, and the items that hold those words.
2. Documents stream through the automata of a pass: words become numbers by the automaton's vocabulary, runs of
   words whose pairs all occur in items are walked token by token, and the longest match that ends at each
   token says which words lie inside an occurrence of a window. Texts don't move; there is no shuffle.
3. GROUP parts make a pass. Benchmarks of more words than a pass holds take several; between passes the documents
   are written with what was found so far.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.

Cases: a null text has no words; a text without words has none hit. Rows of the same item_id are one item; items
with a null id or text, or without words, take no part. Repeated rows each get their result. Extra columns of
documents stay, whatever their names, but those that this operator adds. Empty tables: no items hit nothing, no
documents give no rows. Items longer than a part are cut into pieces that overlap by window - 1 words.
"""

from __future__ import annotations

import pickle
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import release
from .common import fresh, stored, table

#: Words of an item: anything but ASCII that is neither digit nor small letter, A-Z lowered before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of an automaton, about; words of a piece of a long item; automata of a pass.
PART_WORDS, PIECE_WORDS, GROUP = 1 << 19, 1 << 15, 8
#: Bytes of text that are cut into words at a time.
SLICE = 1 << 20
#: Steps that a worker remembers for each automaton.
REMEMBERED = 1 << 18
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOUND = "struct<n_words: bigint, first: array<bigint>, last: array<bigint>, items: array<string>, longest: bigint>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_SPACES).split()


class Automaton:
    """A generalised suffix automaton over sequences of numbers below `base`; sequences are added one by one."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _copy(self, p: int, token: int, q: int) -> int:
        """Splits q so that what p reaches by token has a state of its own."""
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for token in sequence:
            q = self.next[last].get(token)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._copy(last, token, q)
                continue
            new, p = len(self.length), last
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            self.next.append({})
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, token, q)
            last = new


def built(items: list[tuple[str, list[bytes]]], window: int) -> dict:
    """The automaton of the items as arrays. Steps are sorted by state * base + token."""
    vocabulary: dict[bytes, int] = {}
    coded = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in ws]) for name, ws in items]
    names = {name: n for n, name in enumerate(sorted({name for name, _ in coded}))}
    a, base = Automaton(), max(1, len(vocabulary))
    for _, ws in coded:
        a.add(ws)
    length, link = np.array(a.length, np.int32), np.array(a.link, np.int32)
    order = np.argsort(length, kind="stable")
    held: set[tuple[int, int]] = set()
    short = np.zeros(len(length), bool)
    whole = np.full(len(length), -1, np.int32)  # the state of the last `window` words
    for s in order[1:].tolist():
        up = a.link[s]
        whole[s] = whole[up] if whole[up] >= 0 else s if a.length[s] >= window else -1
    for name, ws in coded:
        state = 0
        for n, token in enumerate(ws, 1):
            state = a.next[state][token]
            if n >= window:
                held.add((int(whole[state]), names[name]))
        if len(ws) < window:
            short[state] = True
            held.add((state, names[name]))
    above = np.full(len(length), -1, np.int32)  # the next short item among the proper suffixes
    for s in order[1:].tolist():
        up = a.link[s]
        above[s] = up if short[up] else above[up]
    steps = sorted((s * base + token, target) for s, nexts in enumerate(a.next) for token, target in nexts.items())
    pairs = {x * base + y for _, ws in coded for x, y in zip(ws, ws[1:])}
    of = np.array(sorted(held), np.int64).reshape(-1, 2)
    return {
        "vocabulary": list(vocabulary), "names": list(names), "base": base, "window": window, "least": min((min(len(ws), window) for _, ws in coded), default=window),
        "length": length, "link": link, "whole": whole, "short": short, "above": above, "key": np.array([k for k, _ in steps], np.int64), "target": np.array([t for _, t in steps], np.int32),
        "pairs": np.array(sorted(pairs), np.int64), "at": np.searchsorted(of[:, 0], np.arange(len(length) + 1)), "items": of[:, 1].astype(np.int32),
    }


class Matcher:
    """Finds a part's windows in sequences of words."""

    def __init__(self, blob: bytes) -> None:
        p = pickle.loads(blob)
        self.ids = {w: n for n, w in enumerate(p["vocabulary"])}
        self.names, self.base, self.window, self.least = p["names"], p["base"], p["window"], p["least"]
        self.length, self.link, self.whole, self.short, self.above = (p[x] for x in ("length", "link", "whole", "short", "above"))
        self.key, self.target, self.at, self.items = p["key"], p["target"], p["at"], p["items"]
        self.bits = max(16, int(len(p["pairs"]) * 16).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(p["pairs"])] = True
        self.steps: dict[int, int] = {}

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs [i, j) of known words whose neighbours are pairs of items (or look so), no shorter than the least window."""
        known = ids >= 0
        if not known.any():
            return []
        tied = known[:-1] & known[1:]
        at = np.flatnonzero(tied)
        tied[at] = self.seen[self._slot(ids[at] * self.base + ids[at + 1])]
        begin = np.flatnonzero(known & ~np.concatenate(([False], tied)))
        end = np.flatnonzero(known & ~np.concatenate((tied, [False]))) + 1
        keep = end - begin >= self.least
        return list(zip(begin[keep].tolist(), end[keep].tolist()))

    def step(self, state: int, token: int) -> int:
        """The state after token, -1 if there is none."""
        k = state * self.base + token
        got = self.steps.get(k)
        if got is None:
            if len(self.steps) >= REMEMBERED:
                self.steps.clear()
            n = int(np.searchsorted(self.key, k))
            got = self.steps[k] = int(self.target[n]) if n < len(self.key) and self.key[n] == k else -1
        return got

    def walk(self, tokens: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """After each token, the state and length of the longest match that ends there."""
        state, size, states, sizes, length, link, step = 0, 0, [], [], self.length, self.link, self.step
        for token in tokens:
            to = step(state, token)
            while to < 0 and state:
                state = int(link[state])
                size = int(length[state])
                to = step(state, token)
            if to >= 0:
                state, size = to, size + 1
            states.append(state)
            sizes.append(size)
        return np.array(states, np.int64), np.array(sizes, np.int64)

    def match(self, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], set[str], int]:
        """First and last words (inclusive) of occurrences of windows, the items that have them, and the longest match."""
        first, last, states, longest = [], [], [], 0
        for i, j in self.runs(ids):
            state, size = self.walk(ids[i:j].tolist())
            longest = max(longest, int(size.max(initial=0)))
            full = np.flatnonzero(size >= self.window)
            first.append(i + full - size[full] + 1)
            last.append(i + full)
            states.append(self.whole[state[full]].astype(np.int64))
            here = np.where(self.short[state] & (size == self.length[state]), state, self.above[state])
            at = np.arange(len(here))
            while (on := here >= 0).any():
                here, at = here[on], at[on]
                first.append(i + at - self.length[here] + 1)
                last.append(i + at)
                states.append(here)
                here = self.above[here]
        hit = np.unique(np.concatenate(states)) if states else np.empty(0, np.int64)
        return first, last, {self.names[x] for s in hit.tolist() for x in self.items[self.at[s] : self.at[s + 1]].tolist()}, longest if len(hit) else 0


@lru_cache(maxsize=1)
def _matchers(parts: tuple) -> list[Matcher]:
    return [Matcher(p.blob) for p in parts]


class Part:
    """A broadcast automaton, known by its number."""

    def __init__(self, held) -> None:
        self.held, self.name = held, held.value[0]

    blob = property(lambda self: self.held.value[1])
    __hash__ = lambda self: hash(self.name)
    __eq__ = lambda self, other: self.name == other.name


def slices(text: bytes):
    """The text in pieces of about SLICE bytes, cut where no word is."""
    text = text.translate(_SPACES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and adjoining stretches made one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > reach[:-1] + 1)) if len(first) else np.empty(0, bool)
    return first[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))] if len(first) else reach


def finder(parts: list[Part]):
    """A column of what the parts' automata find in texts, added to what was found before."""
    parts = tuple(parts)

    def find(texts: pa.Array, before: pa.Array) -> pa.Array:
        matchers, rows = _matchers(parts), []
        for text, old in zip(texts.cast(pa.large_binary()), before, strict=True):
            text, old = text.as_py() or b"", old.as_py() or {"first": [], "last": [], "items": [], "longest": 0}
            ids = [[] for _ in matchers]
            for piece in slices(text):
                found = piece.split()
                for m, into in zip(matchers, ids, strict=True):
                    into.append(m.numbers(found))
            whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ids]
            first, last, items, longest = [np.array(old["first"], np.int64)], [np.array(old["last"], np.int64)], set(old["items"]), old["longest"]
            for m, x in zip(matchers, whole, strict=True):
                a, b, names, most = m.match(x)
                first += a
                last += b
                items |= names
                longest = max(longest, most)
            a, b = spans(np.concatenate(first), np.concatenate(last))
            rows.append((len(whole[0]), a.tolist(), b.tolist(), sorted(items), longest))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())
        out = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_words", "first", "last", "items", "longest"])
        release()
        return out

    return F.arrow_udf(find, _FOUND)


def build(group: pa.Table) -> pa.Table:
    """The automaton of one part's pieces."""
    at = range(group.num_rows)
    pieces = sorted((group["item"][i].as_py(), group["n"][i].as_py(), group["words"][i].as_py()) for i in at)
    blob = pickle.dumps(built([(i, [w.encode() for w in ws]) for i, _, ws in pieces], group["window"][0].as_py()), protocol=5)
    return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


def automata(items: DataFrame, item: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(part, blob): the automata of all items, each over PART_WORDS words or fewer but for chance."""
    ascii_lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(ascii_lower, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    step = PIECE_WORDS
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.lit(window)), F.lit(step)))
    pieces = cut.where(F.size("words") > 0).select("item", "words", at.alias("n")).select("item", "n", F.slice("words", F.col("n") + 1, step + window - 1).alias("words")).distinct()
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // (PART_WORDS // 2)) if total > PART_WORDS else 1
    dealt = pieces.select("item", "n", "words", F.lit(window).alias("window"), F.pmod(F.xxhash64("item", "n", "words"), F.lit(parts)).cast("int").alias("part"))
    return stored(dealt.groupBy("part").applyInArrow(build, "part int, blob binary"))


def matches(docs: DataFrame, items: DataFrame, text: str = "text", found: str = "found", item: str = "item_id", window: int = 10) -> DataFrame:
    """docs with `found`: n_words, first and last (spans of hit words, by number from 0, inclusive), items (ids as strings, sorted), longest (words of the longest match, 0 if no window was hit)."""
    sc = docs.sparkSession.sparkContext
    (before,) = fresh(docs, "before")
    out = docs.withColumn(before, F.lit(None).cast(_FOUND))
    tables = automata(items, item, "text", window)
    numbers = sorted(r.part for r in tables.select("part").collect())  # one number for each PART_WORDS words of the items
    for at in range(0, max(1, len(numbers)), GROUP):
        now = numbers[at : at + GROUP]
        parts = [Part(sc.broadcast((f"{tables.inputFiles()[0]}:{r.part}", r.blob))) for r in tables.where(F.col("part").isin(now)).toLocalIterator()] if now else []
        if not parts:
            parts = [Part(sc.broadcast(("none", pickle.dumps(built([], window), protocol=5))))]
        out = out.withColumn(before, finder(parts)(F.col(text), F.col(before)))
        if at + GROUP < len(numbers):
            out = stored(out)
    return out.withColumn(found, F.col(before)).drop(before) if found not in docs.columns else out.drop(found).withColumnRenamed(before, found)


def without(texts: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Texts without the words of the spans and what stands between those."""
    out = []
    for text, a, b in zip(texts.cast(pa.large_binary()), first, last, strict=True):
        text = text.as_py()
        if text is not None:
            where = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_SPACES))]
            kept, at = [], 0
            for i, j in zip(a.as_py(), b.as_py(), strict=True):
                kept.append(text[at : where[i][0]])
                at = where[j][1]
            text = b"".join([*kept, text[at:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", window: int = 10, most: float = 0.5) -> DataFrame:
    """docs without the spans that occur in items; a document with more than the share `most` of its words in such spans goes."""
    (found,) = fresh(docs, "found")
    got = matches(docs, items, text, found, item, window)
    n = F.aggregate(F.zip_with(f"{found}.last", f"{found}.first", lambda b, a: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    clean = F.when(n > 0, F.arrow_udf(without, "string")(F.when(n > 0, F.col(text)), f"{found}.first", f"{found}.last")).otherwise(F.col(text))
    return got.where(n <= F.col(f"{found}.n_words") * most).withColumn(text, clean).drop(found)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = matches(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("found.last", "found.first", lambda b, a: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH w AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item, ws, least(len(ws), 10) AS n FROM w WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, list_slice(ws, p, p + n - 1) AS win FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
pos AS (SELECT r, n, p, list_slice(ws, p, p + n - 1) AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows))),
m AS (SELECT r, pos.n, p, item FROM pos JOIN windows ON pos.win = windows.win AND pos.n = windows.n),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, n, p FROM m)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
