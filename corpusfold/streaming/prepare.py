"""The steps before clustering on a stream of arriving documents.

They keep no state, so there is no watermark to set; clusters, votes and names stay batch work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from corpusfold.operators.filters import classify_ext, drop_noise, exclude_globs, unit_key
from corpusfold.operators.text import weighted_text


def prepare_stream(files: DataFrame, path_weight: int = 2, skip_noise: bool = True,
                   exclude_patterns: Sequence[str] = ()) -> DataFrame:
    """``rel_path, unit, name, ext, kind, text`` of a streaming (or batch) ``rel_path, content``."""
    kept = exclude_globs(drop_noise(files, skip_noise), exclude_patterns)
    return (weighted_text(classify_ext(unit_key(kept)), path_weight, path="name")
            .select("rel_path", "unit", "name", "ext", "kind", "text"))
