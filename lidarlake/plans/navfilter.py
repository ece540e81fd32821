"""Cleaning the clouds of stored maps for navigation."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lidarlake.operators.clouds import transform_points
from lidarlake.operators.descriptors import polar_descriptors, submap_descriptors
from lidarlake.operators.mapcheck import (
    classify_point,
    emptied_keyframes,
    filter_counts,
    kept_removed_split,
)


@dataclass
class NavFilterResult:
    """Kept points (body frame), removed points (map frame), counts, keyframes left empty."""

    kept: DataFrame
    removed: DataFrame
    counts: DataFrame
    emptied: DataFrame


def nav_filter(points: DataFrame, keyframes: DataFrame, rules=None) -> NavFilterResult:
    """Split the points of all keyframes by the filter rules."""
    classified = classify_point(points, rules)
    kept, removed = kept_removed_split(classified)
    counts = filter_counts(classified)
    return NavFilterResult(kept, transform_points(removed, keyframes), counts, emptied_keyframes(counts))


def filtered_descriptors(result: NavFilterResult, keyframes: DataFrame):
    """Descriptors of the kept points; refuses maps in which a keyframe would become empty."""
    refused = result.emptied.select("map_id").distinct()
    kept = result.kept.join(refused, ["map_id"], "left_anti")
    frames = keyframes.join(refused, ["map_id"], "left_anti")
    return polar_descriptors(kept), submap_descriptors(frames, kept)


def require_no_empty_keyframes(result: NavFilterResult) -> None:
    """Raise if the filter would remove every point of some keyframe."""
    first = result.emptied.limit(5).collect()
    if first:
        ids = ", ".join(f"{r.map_id}/{r.kf_id}" for r in first)
        raise ValueError(f"filter leaves keyframes without points: {ids}")

