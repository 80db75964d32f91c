"""Per-item scoring rules as column expressions (R-01 to R-18); no shuffle, no UDF.

Scores of the transformed versions come as a list of columns, of which some may be null,
or as one array column with nulls left out. Lists give plain arithmetic, which stays in
generated code; arrays need higher-order functions, which are interpreted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fusion weights, consistency references, bands
RGB = (0.7, 0.3)
WHOLE_PATCH = (0.6, 0.2, 0.2)
FREQUENCY = (0.5, 0.3, 0.2)
STD_REFERENCE, RANGE_REFERENCE = 0.20, 0.60
LOW_SEVERITY, MEDIUM_SEVERITY = 0.95, 0.85
CONFIDENCE_WEIGHTS = (0.4, 0.3, 0.3)
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.70, 0.45


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """For values that are never null: greatest and least skip nulls, see ``unit``."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def logit(p: Column) -> Column:
    """R-01; null stays null."""
    return F.when(p.isNotNull(), F.ln(clip(p, 1e-6, 1 - 1e-6) / clip(1.0 - p, 1e-6, 1.0)))


def sigmoid(x: Column) -> Column:
    """R-02, R-17 for one logit: the argument is clipped to ±60."""
    return 1.0 / (1.0 + F.exp(-clip(x, -60.0, 60.0)))


def calibrated(p: Column, scale: float, bias: float) -> Column:
    """R-02: clip(sigmoid(scale * logit(p) + bias))."""
    return clip(sigmoid(scale * logit(p) + bias))


def softmax(logits: Column, place: int) -> Column:
    """R-17: the probability of one of several classes (places count from 1)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.exp(F.element_at(logits, place) - top) / total


Scores = Column | Sequence[Column]


def joined(clean: Column, versions: Scores) -> Scores:
    """The clean score before the others, in their form."""
    return F.concat(F.array(clean), versions) if isinstance(versions, Column) else [clean, *versions]


def size(a: Scores) -> Column:
    if isinstance(a, Column):
        return F.size(a)
    return sum((x.isNotNull().cast("int") for x in a), F.lit(0))


def array_sum(a: Scores) -> Column:
    if isinstance(a, Column):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return sum((F.coalesce(x, F.lit(0.0)) for x in a), F.lit(0.0))


def array_mean(a: Scores) -> Column:
    """Null for an empty array."""
    return F.try_divide(array_sum(a), size(a).cast("double"))


def array_std(a: Scores) -> Column:
    """Population standard deviation in two passes."""
    if isinstance(a, Column):
        squares = let(array_mean(a), lambda mean: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)))
    else:
        # the mean is taken once and not for each score
        squares = let(array_mean(a), lambda mean: array_sum([(x - mean) * (x - mean) for x in a]))
    return F.sqrt(F.try_divide(squares, size(a).cast("double")))


def spread(a: Scores) -> Column:
    """Highest less lowest."""
    if isinstance(a, Column):
        return F.array_max(a) - F.array_min(a)
    return F.greatest(*a) - F.least(*a) if len(a) > 1 else a[0] - a[0]


def share_above(a: Scores, threshold: float) -> tuple[Column, Column]:
    """(how many reach the threshold, how many there are)."""
    if isinstance(a, Column):
        return F.size(F.filter(a, lambda x: x >= threshold)), F.size(a)
    return sum((F.when(x >= threshold, 1).otherwise(0) for x in a), F.lit(0)), size(a)


def weighted(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """R-04: missing terms drop out and the other weights are scaled up to 1."""
    if len(values) != len(weights):
        raise ValueError("one weight per value")
    total, mass = F.lit(0.0), F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        total = total + F.coalesce(v * w, F.lit(0.0))
        mass = mass + F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
    return F.try_divide(total, mass)


def unit(x: Column | None) -> Column:
    """A value in [0, 1]; null stays null."""
    return F.lit(None).cast("double") if x is None else F.when(x.isNotNull(), clip(x))


def rgb_transform(clean: Column, versions: Scores, weights: Sequence[float] = RGB) -> Column:
    """R-03: clean and the mean of the transformed versions; clean alone without any."""
    return weighted([clip(clean), unit(array_mean(versions))], weights)


def whole_patch_transform(clean: Column, patch: Column, versions: Scores, weights: Sequence[float] = WHOLE_PATCH) -> Column:
    """R-04."""
    return weighted([clip(clean), unit(patch), unit(array_mean(versions))], weights)


def frequency_fusion(clean: Column, versions: Scores, frequency: Column, consistency: Column, weights: Sequence[float] = FREQUENCY) -> Column:
    """R-05: R-03's result, frequency and inconsistency; R-03 alone where a term is missing."""
    missing = frequency.isNull() | consistency.isNull()
    more = lambda base: (base * weights[0] + clip(frequency) * weights[1] + (1.0 - clip(consistency)) * weights[2]) / sum(weights)
    base = rgb_transform(clean, versions)
    return F.when(missing, base).otherwise(clip(more(base)))


def variants(clean: Column, versions: Scores, patch: Column) -> dict[str, Column]:
    """R-06: four systems from one set of cached scores; null where a term is missing."""
    mean = array_mean(versions)
    return {
        "clean_only": clip(clean),
        "transform_mean": unit(mean),
        "rgb_transform": F.when(mean.isNotNull(), rgb_transform(clean, versions)),
        "whole_patch_transform": F.when(patch.isNotNull(), whole_patch_transform(clean, patch, versions)),
    }


def consistency(scores: Scores, w_std: float = 0.5, w_range: float = 0.5) -> Column:
    """R-07: 1 for a single value."""
    found = array_std(scores) / STD_REFERENCE * w_std + spread(scores) / RANGE_REFERENCE * w_range
    return F.when(size(scores) <= 1, F.lit(1.0)).otherwise(clip(1.0 - found / (w_std + w_range)))


def severity(score: Column) -> Column:
    """R-09."""
    return F.when(score >= LOW_SEVERITY, "low").when(score >= MEDIUM_SEVERITY, "medium").otherwise("high")


def agreement(scores: Scores, reference: Column, threshold: float) -> Column:
    """A-22: share of scores on the reference's side; the caller says which reference it is."""
    side = reference >= threshold
    one = lambda x: F.when((x >= threshold) == side, 1.0).otherwise(0.0)
    same = F.aggregate(scores, F.lit(0.0), lambda s, x: s + one(x)) if isinstance(scores, Column) else sum(map(one, scores), F.lit(0.0))
    return F.try_divide(same, size(scores).cast("double"))


def three_way(score: Column, authentic_max: float = 0.40, ai_min: float = 0.60) -> Column:
    """P-04: half-open bands."""
    if authentic_max > ai_min:
        raise ValueError("the bands overlap")
    return F.when(score < authentic_max, "Likely Authentic").when(score >= ai_min, "Likely AI-Generated").otherwise("Uncertain")


def decisiveness(score: Column) -> Column:
    """R-10."""
    return clip(F.abs(score - 0.5) * 2.0)


def confidence(score: Column, consistency_: Column, agreement_: Column, patch: Column | None = None, patch_weight: float = 0.0) -> Column:
    """R-10: missing terms drop out."""
    values, weights = [decisiveness(score), unit(consistency_), unit(agreement_)], list(CONFIDENCE_WEIGHTS)
    if patch is not None and patch_weight > 0:
        values, weights = [*values, unit(patch)], [*weights, patch_weight]
    return clip(weighted(values, weights))


def confidence_level(value: Column, label: Column) -> Column:
    """R-11: an uncertain label is Medium at most."""
    high = (value >= HIGH_CONFIDENCE) & (label != "Uncertain")
    return F.when(high, "High").when(value >= MEDIUM_CONFIDENCE, "Medium").otherwise("Low")


def statement(label: Column, level: Column) -> Column:
    """R-12."""
    return F.concat(label, F.lit(" with "), F.lower(level), F.lit(" confidence"))


def patch_agreement(evidence: Column, clean: Column, limit: float = 0.25) -> dict[str, Column]:
    """R-15: A without the term, B always, C only where evidence and clean score are near."""
    gap = F.abs(evidence - clean)
    return {"A": F.lit(None).cast("double"), "B": unit(1.0 - gap), "C": F.when(gap <= limit, clip(1.0 - gap))}


def evidence(patches: Column, how: str = "topk", k: int = 3) -> Column:
    """R-16, T-04: mean of the k highest patch scores, the highest one, or the mean."""
    if how == "max":
        return F.array_max(patches)
    if how == "mean":
        return array_mean(patches)
    return array_mean(F.slice(F.sort_array(patches, asc=False), 1, k))


@dataclass(frozen=True)
class AbstentionRules:
    """R-13: limits; a rule whose input is null does not fire."""

    enabled: bool = True
    margin: float = 0.05
    max_drift: float = 0.25
    min_consistency: float = 0.30
    min_agreement: float = 0.60
    min_coverage: float = 0.25
    crossing: float = 0.20
    on_errors: bool = False
    rules: tuple[str, ...] = field(default=("borderline", "drift", "consistency", "crossing", "agreement", "coverage", "errors"))

    def __post_init__(self):
        unknown = set(self.rules) - set(type(self).__dataclass_fields__["rules"].default)
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")

    def flags(self, threshold: float, fused: Column, clean: Column, versions: Scores, consistency_: Column, agreement_: Column,
              coverage: Column | None = None, errors: Column | None = None) -> dict[str, Column]:
        above, n = share_above(joined(clean, versions), threshold)
        minority = F.try_divide(F.least(above, n - above).cast("double"), n.cast("double"))
        flags = {
            "borderline": F.abs(fused - threshold) < self.margin,
            "drift": (clean >= threshold) & (clean - array_mean(versions) > self.max_drift),
            "consistency": consistency_ < self.min_consistency,
            "crossing": (above > 0) & (above < n) & (minority >= self.crossing),
            "agreement": agreement_ < self.min_agreement,
        }
        if coverage is not None:
            flags["coverage"] = coverage < self.min_coverage
        if self.on_errors and errors is not None:
            flags["errors"] = F.size(F.filter(errors, lambda stage: stage != "patches")) > 0
        return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items() if k in self.rules}

    def apply(self, flags: dict[str, Column]) -> tuple[Column, Column]:
        """(abstains, the names of the rules that fired)."""
        fired = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()])) if flags else F.array().cast("array<string>")
        return (F.size(fired) > 0) & F.lit(self.enabled), fired


def degradation_flip(clean: Column, versions: Scores, threshold: float, max_drift: float) -> Column:
    """R-14."""
    mean = array_mean(versions)
    return (clean >= threshold) & (mean < threshold) & (clean - mean > max_drift)


def threshold_bands(threshold: float, margin: float = 0.10) -> tuple[float, float]:
    """R-20: the label bands around a threshold."""
    return max(0.0, threshold - margin), min(1.0, threshold + margin)


def effective_threshold(override: float | None, operating_points: dict | None, point: str = "balanced", configured: float | None = None) -> float:
    """R-20: an override, the calibrated operating point, the balanced one, the configured value, or 0.5."""
    points = operating_points or {}
    for value in (override, points.get(point), points.get("balanced"), configured):
        if value is not None:
            return float(value)
    return 0.5
