"""Synthetic cards: positioned text as a recogniser would return it, clean or damaged, one card or many."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.model import OBSERVATIONS

GUTTER, LEFT, RIGHT, TOP, PITCH, HEIGHT = 0.020, 0.170, 0.980, 0.140, 0.062, 0.026


@dataclass(frozen=True)
class Row:
    """One line of a card: a label, a text for each hole (None: nothing written), and texts for OUT, IN, TOT."""

    label: str
    values: tuple[str | None, ...]
    confidence: float = 0.95
    scale: float = 1.0
    jitter: float = 0.0
    totals: tuple[str | None, str | None, str | None] = (None, None, None)

    @classmethod
    def printed(cls, label: str, values: Sequence, totals: Sequence = (None, None, None)) -> Row:
        return cls(label, tuple(None if v is None else str(v) for v in values), totals=tuple(None if t is None else str(t) for t in totals))

    @classmethod
    def handwritten(cls, label: str, values: Sequence, totals: Sequence = (None, None, None), confidence: float = 0.55) -> Row:
        return replace(cls.printed(label, values, totals), confidence=confidence, scale=1.15, jitter=0.28)

    def corrupting(self, hole: int, text: str | None) -> Row:
        return replace(self, values=tuple(text if i == hole else v for i, v in enumerate(self.values, 1)))

    def dropping(self, hole: int) -> Row:
        return self.corrupting(hole, None)


@dataclass(frozen=True)
class Card:
    rows: tuple[Row, ...]
    holes: int = 18
    titles: tuple[str, ...] = ()
    stacked: bool = False
    skew: float = 0.0
    header: tuple[str | None, ...] | None = None
    extra: tuple = field(default=())


def observations(card: Card, card_id: str = "card") -> list[tuple]:
    """Rows of the observation schema."""
    out: list[tuple[str, float, float, float, float, float]] = []

    def cell(text: str, cx: float, cy: float, height: float, conf: float) -> None:
        w = 0.011 * len(text) + 0.006
        out.append((text, cx - w / 2, cy - height / 2, w, height, conf))

    def label(text: str, cy: float, height: float, conf: float) -> None:
        if text:
            out.append((text, GUTTER, cy - height / 2, min(0.142, 0.017 * max(2, len(text))), height, conf))

    def band(first: int, last: int, top: float, names: list[tuple[str, int]]) -> None:
        slots = [(h, None) for h in range(first, min(last, 9) + 1)] + [(n, i) for n, i in names if n == "OUT"] + [(h, None) for h in range(max(first, 10), last + 1)] + [(n, i) for n, i in names if n != "OUT"]
        width = (RIGHT - LEFT) / len(slots)
        centre = [LEFT + width * (s + 0.5) for s in range(len(slots))]
        label("HOLE", top, HEIGHT, 0.94)
        for s, (what, total) in enumerate(slots):
            text = what if total is not None else (card.header[what - 1] if card.header else str(what))
            if text:
                cell(text, centre[s], top, HEIGHT, 0.94)
        for r, row in enumerate(card.rows):
            y = top + PITCH * (r + 1)
            label(row.label, y, HEIGHT * row.scale, row.confidence)
            for s, (what, total) in enumerate(slots):
                text = row.totals[total] if total is not None else row.values[what - 1]
                if text:
                    wobble = 1 + row.jitter * (((s * 37 + (r + 1) * 11) % 7) / 6 - 0.5) * 2
                    cell(text, centre[s], y, HEIGHT * row.scale * wobble, row.confidence)

    for i, title in enumerate(card.titles):
        y = max(0.001, TOP - PITCH * (len(card.titles) - i) - 0.012)
        out.append((title, LEFT, y, min(0.55, 0.022 * len(title)), HEIGHT * 1.4, 0.88))
    if card.stacked and card.holes > 9:
        band(1, 9, TOP, [("OUT", 0)])
        band(10, card.holes, TOP + PITCH * (len(card.rows) + 2), [("IN", 1), ("TOT", 2)])
    else:
        band(1, card.holes, TOP, [("OUT", 0), *([("IN", 1)] if card.holes > 9 else []), ("TOT", 2)])
    out += list(card.extra)
    c, s = math.cos(math.radians(card.skew)), math.sin(math.radians(card.skew))
    made = []
    for n, (text, x, y, w, h, conf) in enumerate(out):
        dx, dy = x + w / 2 - 0.5, y + h / 2 - 0.5
        made.append((card_id, n, text, 0.5 + dx * c - dy * s - w / 2, 0.5 + dx * s + dy * c - h / 2, w, h, conf, "synthetic", []))
    return made


def frame(spark: SparkSession, cards: dict[str, Card]) -> DataFrame:
    return spark.createDataFrame([o for name, card in cards.items() for o in observations(card, name)], OBSERVATIONS)


def many(spark: SparkSession, cards: dict[str, Card], copies: int) -> DataFrame:
    """Each card `copies` times, made on the executors from one small broadcast frame."""
    base = frame(spark, cards)
    each = spark.range(copies).withColumnRenamed("id", "_copy")
    return each.crossJoin(F.broadcast(base)).withColumn("card_id", F.concat_ws("#", "card_id", F.col("_copy").cast("string"))).drop("_copy")


# A golden score row, and the printed totals of the golden card.
GOLDEN_SCORES = (5, 4, 3, 4, 3, 6, 3, 4, 3, 4, 5, 3, 3, 4, 5, 4, 3, 4)
GOLDEN_TOTALS = {"BLACK": (2021, 1821, 3842), "WHITE": (1811, 1586, 3397), "RED": (1484, 1350, 2834), "PAR": (31, 30, 61)}


def golden_card(scores: Sequence | None = GOLDEN_SCORES, player: str = "J. PEARLMAN", stacked: bool = False, skew: float = 0.0, confidence: float = 0.55, totals: Sequence = (None, None, None)) -> Card:
    from tallyframe.sources.catalog import GOLDEN_INDEX, GOLDEN_PARS, GOLDEN_YARDS

    rows = [Row.printed(name.upper(), GOLDEN_YARDS[name], GOLDEN_TOTALS[name.upper()]) for name in GOLDEN_YARDS]
    rows += [Row.printed("PAR", GOLDEN_PARS, GOLDEN_TOTALS["PAR"]), Row.printed("HCP", GOLDEN_INDEX)]
    if scores is not None:
        rows.append(Row.handwritten(player, scores, totals, confidence))
    return Card(tuple(rows), titles=("STEEL CANYON GOLF CLUB", "SANDY SPRINGS, GEORGIA"), stacked=stacked, skew=skew)
