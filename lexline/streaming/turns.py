"""Chat turns as a stream: requests, the replies to them, and what was said before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.operators import chat


def chat_turn_stream(
    requests: DataFrame,
    events: DataFrame,
    messages: DataFrame | None = None,
    *,
    wait: str = "10 minutes",
    lateness: str = "1 minute",
    asked_at: str = "asked_at",
    ts: str = "ts",
) -> DataFrame:
    """The classified reply to each request: the last one of its conversation within ``wait``.

    ``requests`` (``conv_id, question, path, agent, asked_at``) and ``events`` (as for ``fold_events``, with
    ``ts``) may be streams; both have a watermark, so state holds the requests that still wait and
    the events of that span. A request is answered when its time is over: by then all its events have come,
    or there are none and it gets the fallback text. ``messages`` is a table of what was said before. Two
    requests of a conversation within ``wait`` share the replies that lie in the time of both. Frames that
    are no streams give the same rows.
    """
    asked = chat.chat_prompt(requests).select("conv_id", F.col(asked_at).alias("asked_at"), "prompt")
    replies = chat.kept_events(events, ts).select(
        F.col("conv_id").alias("_conv_id"), F.col(ts).alias("_at"), "seq", "content", "agent"
    )
    in_time = (
        (F.col("conv_id") == F.col("_conv_id"))
        & (F.col("_at") >= F.col("asked_at"))
        & (F.col("_at") < F.col("asked_at") + F.expr(f"INTERVAL {wait}"))
    )
    folded = (
        asked.withWatermark("asked_at", lateness)
        .join(replies.withWatermark("_at", lateness), in_time, "left_outer")
        .groupBy("conv_id", "asked_at", "prompt")
        .agg(F.max_by(F.struct("content", "agent"), "seq").alias("last"))
    )
    answered = folded.select(
        "conv_id",
        "asked_at",
        "prompt",
        F.coalesce("last.content", F.lit(K.FALLBACK_REPLY)).alias("content"),
        F.coalesce("last.agent", F.lit(K.SUPERVISOR)).alias("agent"),
    )
    turns = chat.classify_response(answered)
    return turns if messages is None else chat.with_history(turns, messages)
