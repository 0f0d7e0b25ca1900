"""Stage configurations from JSON: known keys make a dataclass, keys with a leading underscore are comments."""

from __future__ import annotations

import json
import warnings
from dataclasses import fields

from pyspark.sql import SparkSession

from geomosaic.operators.detect import DetectionConfig
from geomosaic.operators.spatial_join import CorrelationConfig, HeuristicConfig
from geomosaic.operators.tiling import QuadtreeConfig, WindowConfig

KINDS = {"sahi": WindowConfig, "quadtree_dom": QuadtreeConfig, "detection": DetectionConfig, "heuristic": HeuristicConfig, "correlation_clustering": CorrelationConfig}


def parsed(kind: str, text: str):
    """The configuration of a kind; unknown keys are left out with a warning, missing ones keep their defaults."""
    if kind not in KINDS:
        raise ValueError(f"unknown configuration {kind!r}; known: {', '.join(KINDS)}")
    found = {k: v for k, v in json.loads(text).items() if not k.startswith("_")}
    known = {f.name for f in fields(KINDS[kind])}
    if unknown := sorted(set(found) - known):
        warnings.warn(f"{kind}: keys without effect: {', '.join(unknown)}", stacklevel=2)
    return KINDS[kind](**{k: v for k, v in found.items() if k in known})


def load(spark: SparkSession, kind: str, path: str):
    """From a file of any store that Spark reads; an absent one is an error."""
    return parsed(kind, spark.read.text(path, wholetext=True).head()[0])
