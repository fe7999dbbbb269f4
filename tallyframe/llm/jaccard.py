"""Exact near-duplicate join of word-shingle sets: size-banded tiles, bitmap bounds, sorted-array intersection.

Two documents link when their sets of hashed five-word shingles have a Jaccard similarity of 0.75 or more;
the result is each document's set size and the least id that links reach.

1. All shingles are counted: blocks of documents ask hash shards in how many documents each of their
   shingles occurs (its frequency class, a power of two; shingles are told by 40 bits here, which can only
   coarsen the order below, not lose a link).
2. In the order (class, hash), which is the same for all, two linked sets share one of their first
   n - ceil(0.75 n) + 1 shingles. Only those that occur in two documents at least are kept, so the text
   of an ordinary document leaves nothing, and what many documents share comes last.
3. Documents with equal sets are one node. Nodes that share a kept shingle form candidate groups
   (connected components; ids only are moved).
4. A candidate group is one tile; a large one is cut into bands of size, so that linked sets lie in equal
   or neighbouring bands, and into parts of bounded bytes. In a tile, each set meets the smaller ones
   within the size ratio that aren't connected with it yet; a hashed bitmap's differing bits bound the
   overlap from above, and what passes is decided by exact intersection of sorted arrays.
5. Tiles of a large group first meet the group's pivots (one set per band), which connects true copies;
   only if several components remain do pairs of tiles meet, and then only unconnected sets are compared.

No pairs of a group are ever emitted, only the links that connect it; nothing is capped or dropped.

Cases: a null or wordless text has an empty set and links with nothing; with fewer than five words the
sequence itself is the one shingle. Repeated rows and equal texts link. Null ids are kept; they are never
the least. Very long texts only make larger sets. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import WordHashes, blocked, from_gaps, gaps, hashes, in_order, packed, shingles, tidy, unpacked
from .common import stored, table
from .graph import SPREAD, components, with_least

WIDTH, PERCENT = 5, 75
#: Bits by which shingles are told apart when they are counted.
COUNTED_BITS = 40
#: Messages that a block sends at most; where there are more shards, FAN blocks' messages are merged on the way.
ROUTES, FAN = 256, 256
#: Bytes of sets, and sets, in a tile.
TILE_BYTES, TILE_SETS = 8 << 20, 1024
#: Bytes of sets of small whole groups in one task.
BIN_BYTES = 1 << 20

_QUESTIONS = "shard int, block int, values binary, counts binary"
_ANSWERS = "shard int, block int, classes binary"
_SETS = "id long, h long, n long, k binary, tokens array<long>, shingles binary"


def sets_of(t: pa.Table, width: int) -> list[np.ndarray]:
    """The ascending distinct shingles of each document."""
    known = WordHashes()
    return [np.unique(shingles(hashes(x, known), width)) if x else np.empty(0, np.uint64) for x in t.column("text").to_pylist()]


def counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct truncated shingles, where each document's fall, and in how many of its documents they occur."""
    every = (np.concatenate(sets) if sets else np.empty(0, np.uint64)) >> np.uint64(64 - COUNTED_BITS)
    return np.unique(every, return_inverse=True, return_counts=True)


def asker(width: int, shards: int):
    def ask(key: tuple, t: pa.Table) -> pa.Table:
        values, _, counts = counted(sets_of(in_order(t), width))
        cut = np.searchsorted(values, (np.arange(1, shards, dtype=np.uint64) << np.uint64(COUNTED_BITS)) // np.uint64(shards))
        parts = list(zip(np.split(values, cut), np.split(counts, cut), strict=True))
        rows = [{"shard": s, "block": key[0].as_py(), "values": gaps(v), "counts": packed(c.astype(np.uint32))} for s, (v, c) in enumerate(parts) if len(v)]
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())]))

    return ask


def answer(t: pa.Table) -> pa.Table:
    """For each block's shingles of a shard, in its order: the class of the number of documents that hold it, 0 for one alone."""
    every, which, total, lengths = merged(t.to_pylist())
    classes = np.ceil(np.log2(total)).astype(np.uint8)[which] if len(every) else np.empty(0, np.uint8)
    parts = np.split(classes, np.cumsum(lengths)[:-1])
    return pa.table({"shard": t.column("shard"), "block": t.column("block"), "classes": pa.array([packed(p) for p in parts], pa.binary())})


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct values of several messages, where each message's fall, their summed counts, and the messages' lengths."""
    asked = [from_gaps(r["values"]) for r in rows]
    every, which = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([unpacked(r["counts"], np.uint32) for r in rows]))
    return every, which, total.astype(np.uint32), [len(a) for a in asked]


def by_block(t: pa.Table) -> list[dict]:
    return sorted(t.to_pylist(), key=lambda r: r["block"])


def forwarder(routes: int, each: int):
    def forward(key: tuple, t: pa.Table) -> pa.Table:
        """The merged messages of a party of blocks to one route, cut for the route's shards; the party stands for the block."""
        route, party = (x.as_py() for x in key)
        every, _, total, _ = merged(by_block(t))
        inner = np.arange(route * each + 1, (route + 1) * each, dtype=np.uint64)
        cut = np.searchsorted(every, (inner << np.uint64(COUNTED_BITS)) // np.uint64(routes * each))
        parts = list(zip(np.split(every, cut), np.split(total, cut), strict=True))
        rows = [{"shard": route * each + i, "block": party, "values": gaps(v), "counts": packed(c)} for i, (v, c) in enumerate(parts) if len(v)]
        return pa.Table.from_pylist(rows, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("values", pa.binary()), ("counts", pa.binary())]))

    return forward


def hand_back(t: pa.Table, got: pa.Table) -> pa.Table:
    """A party's answers, dealt to the blocks that asked."""
    rows = by_block(t)
    _, which, _, lengths = merged(rows)
    classes = np.concatenate([unpacked(r["classes"], np.uint8) for r in sorted(got.to_pylist(), key=lambda r: r["shard"])])[which]
    parts = np.split(classes, np.cumsum(lengths)[:-1])
    return pa.table({"shard": pa.array([r["shard"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int32()), "classes": pa.array([packed(p) for p in parts], pa.binary())})


def exchange(docs: DataFrame, width: int, shards: int, routes: int, fan: int) -> DataFrame:
    """(shard, block, classes): what the shards answer the blocks.

    Up to `routes` shards are asked at once. Where there are more, a block asks `routes` ranges of shards, and
    `fan` blocks' messages to a range are merged before they are cut for its shards; the answers come back the
    same way. So a block sends a bounded number of messages, and the second hop a fan-th of blocks times shards.
    """
    asked = docs.groupBy("block").applyInArrow(tidy(asker(width, min(shards, routes))), _QUESTIONS)
    if shards <= routes:
        return asked.groupBy("shard").applyInArrow(tidy(answer), _ANSWERS)
    each = -(-shards // routes)
    asked = stored(asked.withColumn("party", F.floor(F.col("block") / fan).cast("int")))
    forward = asked.groupBy("shard", "party").applyInArrow(tidy(forwarder(routes, each)), _QUESTIONS)
    answered = forward.groupBy("shard").applyInArrow(tidy(answer), _ANSWERS)
    back = answered.select(F.floor(F.col("shard") / each).cast("int").alias("route"), F.col("block").alias("party"), "shard", "classes")
    return asked.groupBy("shard", "party").cogroup(back.groupBy("route", "party")).applyInArrow(tidy(hand_back), _ANSWERS)


def keeper(width: int, percent: int):
    def keep(t: pa.Table, got: pa.Table) -> pa.Table:
        t = in_order(t)
        sets = sets_of(t, width)
        _, which, _ = counted(sets)
        parts = [unpacked(r["classes"], np.uint8) for r in sorted(got.to_pylist(), key=lambda r: r["shard"])]
        classes = (np.concatenate(parts) if parts else np.empty(0, np.uint8))[which]
        at, tokens, names, raw = 0, [], [], []
        for s in sets:
            own = classes[at : at + len(s)]
            at += len(s)
            head = np.lexsort((s, own))[: len(s) - -(-percent * len(s) // 100) + 1]
            head = head[own[head] > 0]
            tokens.append(s[head].view(np.int64))
            names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            raw.append(s.tobytes() if len(head) else None)
        sizes = [len(s) for s in sets]
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32), np.concatenate(tokens) if tokens else np.empty(0, np.int64))
        return pa.table({"id": t.column("id").cast(pa.int64()), "h": t.column("h"), "n": pa.array(sizes, pa.int64()), "k": pa.array(names, pa.binary()), "tokens": lists, "shingles": pa.array(raw, pa.binary())})

    return keep


def shingle_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, routes: int = ROUTES, fan: int = FAN) -> DataFrame:
    """Steps 1 and 2: (id, h: the text's hash, n, k: the set's name, tokens: its kept shingles, shingles: the set, if any is kept)."""
    docs, blocks = blocked(df, doc_id, text)
    answered = exchange(docs, width, max(1, blocks // 3), routes, fan)
    return docs.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(tidy(keeper(width, percent)), _SETS)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of about two bits for each shingle of the largest set, 256 to 65,536."""
    bits = min(1 << 16, max(256, 1 << (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        at = (s >> np.uint64(20)) & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))
    return out.view(np.uint64)


def links_within(names: list[bytes], sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[bytes, bytes]]:
    """What links connect, beyond what bears one label already: each name with the least one of its class."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    names, sets, label = [names[i] for i in order], [sets[i] for i in order], label[order].copy()
    size = np.array([len(s) for s in sets])
    bits, linked = bitmaps(sets), set()
    for i in range(1, len(sets)):
        low = np.searchsorted(size[:i], -(-percent * size[i] // 100))
        near = low + np.flatnonzero(label[low:i] != label[i])
        if not len(near):
            continue
        differ = np.concatenate([np.bitwise_count(bits[near[a : a + 512]] ^ bits[i]).sum(axis=1, dtype=np.int64) for a in range(0, len(near), 512)])
        both = size[near] + size[i]
        near = near[(100 + percent) * (both - differ) >= 2 * percent * both]
        for j in near[::-1].tolist():  # the nearest in size first
            if label[j] != label[i]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    linked.add(int(label[i]))
                    label[label == label[j]] = label[i]
    least: dict[int, bytes] = {}
    for name, own in zip(names, label.tolist(), strict=True):
        least[own] = min(name, least.get(own, name))
    touched = {int(x) for x in linked}
    return [(name, least[own]) for name, own in zip(names, label.tolist(), strict=True) if name != least[own] and own in touched]


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def tiler(percent: int):
    def tile(t: pa.Table) -> pa.Table:
        """Rows of one tile, or of several whole groups, with (component, k, shingles, label)."""
        out: list[tuple[bytes, bytes]] = []
        groups: dict[bytes, dict[bytes, tuple[bytes, bytes]]] = {}
        for r in t.select(["component", "k", "shingles", "label"]).to_pylist():
            groups.setdefault(r["component"], {})[r["k"]] = (r["shingles"], r["label"])
        for members in groups.values():
            if len(members) > 1:
                label = np.unique([x[1] for x in members.values()], return_inverse=True)[1]
                out += links_within(list(members), [np.frombuffer(x[0], np.uint64) for x in members.values()], label, percent)
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return tile


def links(nodes: DataFrame, groups: DataFrame, percent: int = PERCENT, tile_bytes: int = TILE_BYTES, tile_sets: int = TILE_SETS) -> DataFrame:
    """Steps 4 and 5. nodes: (k, n, shingles); groups: (node, component). (node, component) of what links connect."""
    whole = nodes.join(groups, nodes["k"] == groups["node"]).select("k", "n", "shingles", "component")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")
    placed = stored(whole.withColumn("band", band).withColumn("deal", F.pmod(F.xxhash64("k"), F.lit(SPREAD))))
    # a large group meets its few figures in SPREAD parts
    sizes = placed.groupBy("component", "band").agg(F.count("*").alias("c"), F.sum(F.col("n") * 8).alias("bytes"), F.collect_set("deal").alias("deals"))
    parts = F.greatest(F.ceil(F.col("bytes") / F.lit(tile_bytes)), F.ceil(F.col("c") / F.lit(tile_sets))).cast("int")
    of_group = sizes.groupBy("component").agg(F.sum("c").alias("all_c"), F.sum("bytes").alias("all_bytes"))
    is_large = (F.col("all_c") > tile_sets) | (F.col("all_bytes") > tile_bytes)
    kinds = stored(sizes.withColumn("parts", parts).join(of_group, "component").select("component", "band", "parts", is_large.alias("large"), "all_bytes", "deals"))
    total = kinds.where("not large").agg(F.sum("all_bytes")).first()[0] or 0
    tile = tidy(tiler(percent))
    named = placed.join(kinds.select("component", "band", "parts", "large", F.explode("deals").alias("deal")), ["component", "band", "deal"])
    # whole small groups, many to a task
    small = named.where("not large").withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(max(1, -(-int(total) // BIN_BYTES)))))
    found = small.withColumn("label", F.col("k")).groupBy("bin").applyInArrow(tile, "a binary, b binary")
    done = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    done = stored(done.unionByName(done.select(F.col("component").alias("node"), "component").distinct()))
    if kinds.where("large").isEmpty():
        return done
    large = named.where("large").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).select("component", "band", "part", "k", "shingles")
    tiles = kinds.where("large").select("component", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pivots = large.groupBy("component", "band").agg(F.min_by("shingles", "k").alias("shingles"), F.min("k").alias("k"))
    near = pivots.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(tiles, ["component", "band"])
    first = large.unionByName(near.select(large.columns)).withColumn("label", F.col("k"))
    found = stored(first.groupBy("component", "band", "part").applyInArrow(tile, "a binary, b binary"))
    labels = components(found)
    marked = large.join(labels, large["k"] == labels["node"], "left").select(large["*"], F.coalesce(labels["component"], large["k"]).alias("label"))
    marked = stored(marked)
    split = marked.groupBy("component").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("component")
    if split.isEmpty():
        return done.unionByName(labels)
    left = tiles.select("component", F.col("band").alias("b1"), F.col("part").alias("p1"))
    right = tiles.select("component", F.col("band").alias("b2"), F.col("part").alias("p2"))
    pairs = left.join(right, "component").where(((F.col("b2") == F.col("b1")) & (F.col("p2") > F.col("p1"))) | (F.col("b2") == F.col("b1") + 1)).join(split, "component", "left_semi")
    sides = pairs.select("component", "b1", "p1", "b2", "p2", F.explode(F.array(F.struct(F.col("b1").alias("band"), F.col("p1").alias("part")), F.struct(F.col("b2").alias("band"), F.col("p2").alias("part")))).alias("t")).select("component", "b1", "p1", "b2", "p2", "t.band", "t.part")
    second = marked.join(sides, ["component", "band", "part"]).groupBy("component", "b1", "p1", "b2", "p2").applyInArrow(tile, "a binary, b binary")
    return done.unionByName(components(found.unionByName(second)))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, tile_bytes: int = TILE_BYTES, tile_sets: int = TILE_SETS) -> tuple[DataFrame, DataFrame]:
    """(id, h, n, k) of every row, and (k, class) of every set: the sets that links connect have one class."""
    sets = stored(shingle_sets(df, doc_id, text, width, percent))
    nodes = stored(sets.where(F.size("tokens") > 0).groupBy("k").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("shingles").alias("shingles")))
    kept = nodes.select("k", F.explode("tokens").alias("token"))
    edges = with_least(kept, "token", "k").where(F.col("k") != F.col("m")).select(F.col("k").alias("a"), F.col("m").alias("b")).distinct()
    linked = links(nodes.select("k", "n", "shingles"), components(edges), percent, tile_bytes, tile_sets)
    names = sets.where(F.col("k").isNotNull()).select("k").distinct()
    return sets.select("id", "h", "n", "k"), names.join(linked, names["k"] == linked["node"], "left").select("k", F.coalesce("component", "k").alias("class"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sets, of = classes(df, doc_id, text, **sizes)
    least = sets.where(F.col("k").isNotNull()).groupBy("k").agg(F.min("id").alias("least")).join(of, "k")
    reached = least.groupBy("class").agg(F.min("least").alias("component_id"))
    by_set = least.join(reached, "class").select("k", "component_id")
    return sets.join(by_set, "k", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """One row of df of each class: that with the least id (null ids last), then the least hash of the text.

    Rows are told by id and text, so rows that share an id only are kept or dropped by themselves. Of rows that
    repeat both, one stays. Rows without words link with nothing and all stay. df's columns, whatever their names.
    """
    sets, of = classes(df, doc_id, text, **sizes)
    place = F.struct(F.col("id").isNull(), "id", "h")
    per_set = sets.where(F.col("k").isNotNull()).groupBy("k").agg(F.min(place).alias("p"))
    first = per_set.join(of, "k").groupBy("class").agg(F.min("p").alias("p")).select("p.id", "p.h").withColumn("first", F.lit(True))
    plain = sets.where(F.col("k").isNull()).select("id", "h").distinct().withColumn("first", F.lit(False))
    keep = first.unionByName(plain)
    row = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    met = row.join(keep, row["id"].eqNullSafe(keep["id"]) & (row["h"] == keep["h"])).select("row", row["id"], row["h"], "first")
    ones = met.where("first").groupBy("id", "h").agg(F.first("row").alias("row")).select("row.*")
    return ones.unionByName(met.where("not first").select("row.*"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, UNNEST(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT r.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, MIN(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, n.n
"""
