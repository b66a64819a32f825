"""Chat turns: history, prompts, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexline import constants as K
from lexline.functions import chat as C


def chat_normalize(messages: DataFrame) -> DataFrame:
    """Messages with the roles ``human`` and ``ai``; other roles are dropped."""
    return (
        messages.withColumn("role", C.message_role(F.col("role")))
        .where(F.col("role").isNotNull())
        .withColumn("content", F.coalesce("content", F.lit("")))
    )


def chat_history(messages: DataFrame) -> DataFrame:
    """Ordered messages of each conversation, whole: a history is what one prompt can hold."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    shown = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return chat_normalize(messages).groupBy("conv_id").agg(shown.alias("messages"))


def chat_prompt(requests: DataFrame) -> DataFrame:
    """Add ``prompt``: the question with the notes on uploaded file and wanted agent."""
    return requests.withColumn("prompt", C.prompt(F.col("question"), F.col("path"), F.col("agent")))


def classify_response(replies: DataFrame) -> DataFrame:
    """Type, cleaned content, agent short name and announced file of replies (``content, agent``)."""
    kind = C.response_type(F.col("content"))
    path = F.when(F.col("response_type") == "FILE", C.saved_path(F.col("content")))
    return (
        replies.withColumn("response_type", kind)
        .withColumn("server_path", path)
        .withColumn("filename", C.base_name(F.col("server_path")))
        .withColumn("content", C.cleaned_content(F.col("content"), F.col("response_type")))
        .withColumn("agent", C.agent_short_name(F.col("agent")))
    )


def with_history(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``messages``: what was said before in the conversation, then the ``prompt`` as the user's."""
    asked = F.array(F.struct(F.lit(C.HUMAN).alias("role"), F.col("prompt").alias("content")))
    before = chat_history(messages).select("conv_id", F.col("messages").alias("_before"))
    joined = turns.join(before, "conv_id", "left")
    return joined.withColumn("messages", F.coalesce(F.concat("_before", asked), asked)).drop("_before")


def kept_events(events: DataFrame, *extra: str) -> DataFrame:
    """Step events that can be the reply: AI messages with a text that is not a routing word. Columns
    named in ``extra`` are kept too."""
    routing = [name for name, _ in K.AGENTS] + [K.SUPERVISOR]
    return events.where(
        (F.col("msg_type") == "ai") & (F.col("content") != "") & ~F.col("content").isin(*routing)
    ).select(
        "conv_id",
        "seq",
        "content",
        F.coalesce(F.nullif(F.col("msg_name"), F.lit("")), F.col("agent")).alias("agent"),
        *extra,
    )


def fold_events(events: DataFrame) -> DataFrame:
    """The last reply of each conversation, batch or stream; one row of state per conversation."""
    return (
        kept_events(events)
        .groupBy("conv_id")
        .agg(F.max_by(F.struct("content", "agent"), "seq").alias("last"))
        .select("conv_id", "last.content", "last.agent")
    )


def with_fallback(requests: DataFrame, folded: DataFrame) -> DataFrame:
    """Reply of each requested conversation, the fallback text where there is none."""
    return requests.select("conv_id").join(folded, "conv_id", "left").select(
        "conv_id",
        F.coalesce("content", F.lit(K.FALLBACK_REPLY)).alias("content"),
        F.coalesce("agent", F.lit(K.SUPERVISOR)).alias("agent"),
    )
