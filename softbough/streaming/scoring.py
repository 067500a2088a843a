"""Scoring of streams: the model's transform is a stateless projection."""
from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, model, sink: str = "memory", name: str = "scored", tnorm: str | None = None, checkpoint: str | None = None, **options):
    """Starts a query that appends class confidences and the predicted class of every row to a sink."""
    scored = model.predict_class(model.transform(stream, tnorm), tnorm)
    writer = scored.writeStream.outputMode("append").format(sink).queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.options(**options).start()
