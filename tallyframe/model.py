"""Constants, configuration and schemas: the single place where thresholds live."""

from __future__ import annotations

from dataclasses import dataclass, field

# Provenances of a field.
PROVENANCES = ("verifiedCourseTemplate", "ocr", "inferredFromLayout", "multimodalFallback", "solvedFromSubtotal", "userEdited", "none")
# Severities of a warning, lowest first.
SEVERITIES = ("info", "warning", "blocking")

# Plausible ranges, both ends included.
SCORE_RANGE = (1, 15)
PAR_RANGE = (3, 6)
INDEX_RANGE = (1, 18)
YARDAGE_RANGE = (40, 750)
NINE_TOTAL_RANGE = (9, 135)
PAR_TOTAL_RANGE = (20, 120)
# The box that accepted coordinates lie in.
LATITUDES = (30.355, 35.001)
LONGITUDES = (-85.605, -80.751)

OBSERVATIONS = "card_id string, obs_seq int, text string, x double, y double, w double, h double, confidence double, pass string, alternatives array<string>"
FIELD = "struct<value:int,confidence:double,provenance:string,raw_text:string>"


@dataclass(frozen=True)
class Clustering:
    row_tolerance: float = 0.62
    overlap: float = 0.40
    max_skew: float = 0.21
    min_skew: float = 0.0035
    neighbour_gap: float = 0.14
    neighbour_overlap: float = 0.35
    floor: float = 0.004
    default_height: float = 0.02
    least_angles: int = 3
    least_observations: int = 4


@dataclass(frozen=True)
class Grid:
    header_run: int = 6
    edge: float = 0.6
    refine: float = 0.34
    default_pitch: float = 0.05
    aggregate: float = 0.6
    samples: int = 2
    label_slack: float = 0.25


@dataclass(frozen=True)
class Reading:
    substitution: float = 0.25
    rank: float = 0.1
    static_penalty: float = 0.5
    score_penalty: float = 0.6
    interpolated: float = 0.75
    high_score: float = 0.7
    reject: float = 0.30
    least_holes: int = 2


@dataclass(frozen=True)
class Matching:
    name: float = 0.30
    par: float = 0.28
    yards: float = 0.20
    index: float = 0.14
    name_floor: float = 0.62
    least_compared: int = 5
    least_yards: int = 4
    tee_bonus: float = 0.08
    hole_mismatch: float = 0.55
    total_par: float = 0.08
    plausible: float = 0.34
    confident: float = 0.72
    margin: float = 0.07
    evidence: float = 0.40
    strong_name: float = 0.85
    kept: int = 5


@dataclass(frozen=True)
class Checksum:
    known: float = 0.55
    solved: float = 0.93


@dataclass(frozen=True)
class Evaluation:
    ready: float = 0.80
    floor: float = 0.72
    course: float = 0.25
    static: float = 0.25
    scores: float = 0.50
    lift: float = 0.97
    contradicted: float = 0.6


@dataclass(frozen=True)
class Remote:
    corroborated: float = 0.95
    unverifiable: float = 0.80
    contradicted: float = 0.45
    local_subtotal: float = 0.6
    least: float = 0.6
    margin: float = 0.15
    default: float = 0.5
    subtotal: float = 0.85
    row: float = 0.9
    name: float = 0.7


@dataclass(frozen=True)
class Config:
    clustering: Clustering = field(default_factory=Clustering)
    grid: Grid = field(default_factory=Grid)
    reading: Reading = field(default_factory=Reading)
    matching: Matching = field(default_factory=Matching)
    checksum: Checksum = field(default_factory=Checksum)
    evaluation: Evaluation = field(default_factory=Evaluation)
    remote: Remote = field(default_factory=Remote)
