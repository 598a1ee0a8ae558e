"""Rescoring of flagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histmerge.functions.score import decayed_score


def rescore(places: DataFrame, now_us: int) -> DataFrame:
    """New score for rows flagged for it, and the flag taken back.

    A projection: no row moves, and it is fused into whatever reads the table.
    """
    flagged = F.col("recalc_frecency") == 1
    return places.withColumns(
        {
            "frecency": F.when(flagged, decayed_score(now_us)).otherwise(F.col("frecency")),
            "recalc_frecency": F.when(
                flagged, F.lit(0).cast(places.schema["recalc_frecency"].dataType)
            ).otherwise(F.col("recalc_frecency")),
        }
    )
