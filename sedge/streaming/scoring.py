"""Scoring of rows as they arrive; stateless, with everything fitted beforehand."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from sedge.operators.proxies import weighted_proxies
from sedge.operators.scaling import Bounds
from sedge.operators.sweep import predict


def score_stream(
    arriving: DataFrame,
    model: Transformer,
    bounds: Bounds,
    drivers: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Predict and add the weighted proxies, scaled by the bounds of the training table.

    A running minimum would change the scale of rows already emitted, so the
    bounds stay frozen; refit and restart to move them.
    """
    return weighted_proxies(predict(model, arriving), bounds=bounds, drivers=drivers)
