"""Small frames that hold every awkward case, and brute-force versions."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r + (None, None))[:4] for r in rows]
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in full], DOCS)


def save(frame, folder, name="documents"):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def near_copy(text: str, seed: int, changes: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Plain, copied, nearly copied, short, blank, null, long and non-Latin documents; one passage in many."""
    base = " ".join(words(1, 200))
    passage = " ".join(words(2, 60))
    rows = [(10, base), (11, base), (12, near_copy(base, 3, 2)), (13, near_copy(base, 4, 3)), (14, " ".join(words(5, 150)))]
    rows += [(100 + i, passage + " " + " ".join(words(50 + i, 180, 5000))) for i in range(12)]
    rows += [(200, None), (201, ""), (202, "  \n\t "), (203, "Hello World"), (204, "hello world"), (205, "a b c d e"), (206, "A B C D E f"), (207, "漢字 🎉 ▁ naïve\x00"), (208, " ".join(words(9, 20000)))]
    rows += [(209, "x" * 30000)]
    return rows


def brute_components(rows, width=5, percent=75):
    sets = {}
    for i, t in rows:
        w = [] if t is None else t.encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_line_dedup(rows, width=3):
    seen, cuts = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if any(x.strip() for x in w):
                if w in seen:
                    cuts.setdefault(i, set()).update(range(p, p + width))
                seen.setdefault(w, (i, p))
    return {i: t if t is None or i not in cuts else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cuts[i]) for i, t in rows}
