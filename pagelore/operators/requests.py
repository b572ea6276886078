"""Requests, policies and the plan of a run: checked before anything is read."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field


def _require(good: bool, message: str) -> None:
    if not good:
        raise ValueError(message)


def _share(name: str, value: float | None) -> None:
    _require(value is None or (math.isfinite(value) and 0 <= value <= 1), f"{name} must lie in 0 to 1")


def _positive(name: str, value: float | None) -> None:
    _require(value is None or (math.isfinite(value) and value > 0), f"{name} must be positive")


@dataclass(frozen=True)
class Stages:
    detection: bool = True
    classification: bool = True
    recognition: bool = True

    def check(self, words: bool) -> None:
        _require(self.detection or self.classification or self.recognition, "a request needs a stage")
        _require(not words or self.recognition, "words need recognition")


@dataclass(frozen=True)
class Tiles:
    width: int
    height: int
    overlap: int = 0

    def check(self) -> None:
        _require(self.width > 0 and self.height > 0 and 0 <= self.overlap < min(self.width, self.height), "tiles need sides, and an overlap below them")


@dataclass(frozen=True)
class Formulas:
    enabled: bool = False
    model: str | None = None
    confidence: float = 0.25
    overlap: float = 0.7
    min_area_ratio: float = 0.0
    max_regions: int = 64

    def check(self) -> None:
        if self.enabled:
            _require(self.model is not None, "formulas need a model")
            for name in ("confidence", "overlap", "min_area_ratio"):
                _share(name, getattr(self, name))
            _require(self.max_regions > 0, "max_regions must be positive")


@dataclass(frozen=True)
class Request:
    stages: Stages = field(default_factory=Stages)
    words: bool = False
    roi: tuple[int, int, int, int] | None = None
    scale_hint: float | None = None
    max_pixels: int = 100_000_000
    max_bytes: int = 64 << 20
    max_side: int | None = None
    min_text_scale: float | None = None
    box_threshold: float | None = None
    text_score: float | None = None
    unclip_ratio: float | None = None
    tiles: Tiles | None = None
    formulas: Formulas = field(default_factory=Formulas)

    def check(self) -> Request:
        self.stages.check(self.words)
        self.formulas.check()
        _require(not (self.formulas.enabled and self.roi), "formulas are placed on the whole image: no region of interest")
        _require(not (self.formulas.enabled and self.tiles), "formulas can't be found in tiles")
        for name in ("max_pixels", "max_bytes", "max_side", "min_text_scale", "scale_hint", "unclip_ratio"):
            _positive(name, getattr(self, name))
        _share("box_threshold", self.box_threshold)
        _share("text_score", self.text_score)
        if self.tiles:
            self.tiles.check()
        return self


@dataclass(frozen=True)
class EngineSettings:
    """Settings of an engine. from_dict takes no key that it doesn't know."""

    text_score: float = 0.5
    min_height: int = 30
    min_side: int = 30
    max_side: int = 2000
    width_height_ratio: float = 8.0
    detection_threshold: float = 0.3
    box_threshold: float = 0.5
    max_candidates: int = 1000
    unclip_ratio: float = 1.6
    batch: int = 6
    line_shape: tuple[int, int, int] = (3, 48, 320)

    @classmethod
    def from_dict(cls, values: dict) -> EngineSettings:
        unknown = set(values) - set(cls.__dataclass_fields__)
        _require(not unknown, f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values).check()

    @classmethod
    def from_text(cls, text: str) -> EngineSettings:
        """Settings written as YAML, or as JSON where there is no library for YAML."""
        try:
            import yaml

            values = yaml.safe_load(text)
        except ImportError:
            import json

            values = json.loads(text)
        _require(isinstance(values, dict), "settings are names and values")
        return cls.from_dict({k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def check(self) -> EngineSettings:
        for name in ("text_score", "detection_threshold", "box_threshold"):
            _share(name, getattr(self, name))
        for name in ("min_height", "min_side", "max_side", "width_height_ratio", "max_candidates", "unclip_ratio", "batch"):
            _positive(name, getattr(self, name))
        _require(self.min_side <= self.max_side, "min_side must not exceed max_side")
        _require(self.line_shape[0] == 3 and 0 not in self.line_shape, "lines have three channels and no empty side")
        return self


@dataclass(frozen=True)
class Provider:
    requested: str
    selected: str
    fell_back: bool


def decide_provider(requested: str, available: bool, strict: bool) -> Provider:
    """The one asked for if it is there; else an error if that was asked for, else the CPU."""
    if requested == "cpu" or available:
        return Provider(requested, requested, False)
    _require(not strict, f"{requested} is not available")
    return Provider(requested, "cpu", True)


def require_requested(provider: Provider) -> Provider:
    _require(not provider.fell_back, f"{provider.requested} is not available, and no other will do")
    return provider


@dataclass(frozen=True)
class Threads:
    budget: int
    intra: int | None
    inter: int | None
    pool: int | None
    sessions: int

    @classmethod
    def plan(cls, classifier: bool, *, budget: int | None = None, auto: bool = True, intra: int | None = None, pool: int | None = None) -> Threads:
        n = max(1, budget or os.cpu_count() or 1)
        return cls(n, intra or (n if auto else None), 1 if auto or intra else None, pool or (min(max(n // 4, 1), 8) if auto else None), 3 if classifier else 2)


@dataclass(frozen=True)
class Tensor:
    name: str
    kind: str
    shape: tuple[int | None, ...]

    def check(self, rank: int, kind: str, fixed: dict[int, int] | None = None) -> None:
        _require(len(self.shape) == rank and self.kind == kind, f"{self.name}: expected rank {rank} of {kind}")
        for at, size in (fixed or {}).items():
            _require(self.shape[at] in (None, size), f"{self.name}: side {at} must be {size}")


def check_formula_model(inputs: list[Tensor], outputs: list[Tensor], side: int = 384) -> None:
    """One image tensor in, one row of token ids out."""
    _require(len(inputs) == len(outputs) == 1, "a formula model has one input and one output")
    inputs[0].check(4, "float32", {2: side, 3: side})
    outputs[0].check(2, "int64")


@dataclass(frozen=True)
class ServiceLimits:
    """Limits of a service as they are given: megabytes and seconds; as bytes and milliseconds once checked."""

    body_mb: int = 64
    result_mb: int = 32
    export_mb: int = 64
    download_mb: int = 2048
    queue_text: int = 32
    queue_formula: int = 8
    text_in_a_row: int = 4
    formula_in_a_row: int = 1
    retained: int = 200
    retained_mb: int = 512
    tombstones: int = 1000
    cases: int = 1000
    ttl_seconds: int = 3600

    def check(self) -> dict[str, int]:
        out = {}
        for name in self.__dataclass_fields__:
            value = getattr(self, name)
            _require(isinstance(value, int) and value > 0, f"{name} must be a positive whole number")
            own, factor = (name[:-3] + "_bytes", 1 << 20) if name.endswith("_mb") else ("ttl_ms", 1000) if name == "ttl_seconds" else (name, 1)
            _require(value * factor < 1 << 64, f"{name} is too large")
            out[own] = value * factor
        return out


def request_rules() -> dict:
    """The rules of a request as conditions that break them, for requests that lie in a table (columns as the fields of Request)."""
    from pyspark.sql import functions as F

    share = lambda c: ~F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.col(c).isNull())
    positive = lambda c: ~F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c).isNull())
    return {
        "stage": ~(F.col("detection") | F.col("classification") | F.col("recognition")),
        "words": F.col("words") & ~F.col("recognition"),
        "formula model": F.col("formulas") & F.col("formula_model").isNull(),
        "formulas in a region": F.col("formulas") & F.col("roi"),
        "formulas in tiles": F.col("formulas") & F.col("tile_width").isNotNull(),
        "tiles": F.col("tile_width").isNotNull() & ~((F.col("tile_width") > 0) & (F.col("tile_height") > 0) & (F.col("tile_overlap") >= 0) & (F.col("tile_overlap") < F.least("tile_width", "tile_height"))),
        **{c: share(c) for c in ("box_threshold", "text_score")},
        **{c: positive(c) for c in ("max_side", "scale_hint", "unclip_ratio")},
    }
