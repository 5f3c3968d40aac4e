"""Framed message streams as tables: sessions, routing, reassembly, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.sources import compress

#: Payload bytes that a frame may have.
LIMIT = 4 << 20
#: Bytes that the frames of one session may have together to be put into one row.
BODY = 256 << 20


def open_sessions(opens: DataFrame, registry: DataFrame, connection: str = "conn_id", order: str = "seq", draining: Column | None = None) -> DataFrame:
    """Open frames with session_id (1, 2, ... per connection, accepted ones only) and reject ("" if accepted).

    A session needs a registered (package, service, call) of the same kind, and
    a connection that is not draining.
    """
    known = F.broadcast(registry.select(F.col("package").alias("_p"), F.col("service").alias("_s"), F.col("call").alias("_c"), F.col("kind").alias("_k"))) if registry.limit(100_001).count() <= 100_000 else registry.select(F.col("package").alias("_p"), F.col("service").alias("_s"), F.col("call").alias("_c"), F.col("kind").alias("_k"))
    rows = opens.join(known, (F.col("package") == F.col("_p")) & (F.col("service") == F.col("_s")) & (F.col("call") == F.col("_c")), "left")
    drain = F.coalesce(draining, F.lit(False)) if draining is not None else F.lit(False)
    reject = F.when(drain, "draining").when(F.col("_k").isNull(), "unregistered").when(F.col("_k") != F.col("kind"), "type mismatch").otherwise("")
    rows = rows.withColumn("reject", reject).drop("_p", "_s", "_c", "_k")
    place = F.sum(F.when(F.col("reject") == "", 1).otherwise(0)).over(W.partitionBy(connection).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("session_id", F.when(F.col("reject") == "", place))


def demux(frames: DataFrame, sessions: DataFrame, on: list[str]) -> DataFrame:
    """Frames of known sessions; others are dropped."""
    return frames.join(sessions.select(*on).distinct(), on, "left_semi")


def size_limit(frames: DataFrame, payload: str = "payload", limit: int = LIMIT) -> DataFrame:
    """Frames with ``dropped``: why a receiver does not deliver it, "" if it does."""
    return frames.withColumn("dropped", F.when(F.octet_length(payload) > limit, "oversize").otherwise(""))


def delivered(frames: DataFrame, codecs: list[str], payload: str = "payload", codec: str = "codec", limit: int = LIMIT) -> DataFrame:
    """Frames with ``body``, the payload as its codec reads it, and ``dropped``: "oversize", "unknown codec", "undecodable" or "".

    Frames that a receiver drops keep their payload, so that nothing is lost in
    silence; their body is null.
    """
    rows = size_limit(frames, payload, limit)
    for i, name in enumerate(codecs):
        rows = rows.withColumn(f"_body{i}", compress.try_decompressed(F.when((F.col(codec) == name) & (F.col("dropped") == ""), F.col(payload)), name))
    body = F.coalesce(*[F.col(f"_body{i}") for i in range(len(codecs))])
    rows = rows.withColumn("body", body).drop(*[f"_body{i}" for i in range(len(codecs))])
    fine = (F.col("dropped") != "") | F.col("body").isNotNull() | F.col(payload).isNull()
    return rows.withColumn("dropped", F.when(fine, F.col("dropped")).when(F.col(codec).isin(codecs), "undecodable").otherwise("unknown codec"))


def match_requests(requests: DataFrame, responses: DataFrame, on: list[str]) -> DataFrame:
    """Requests with their responses; a request without one keeps nulls."""
    return requests.join(responses, on, "left")


def reassemble(frames: DataFrame, session: str, seq: str, payload: str, end: str | None = None, joiner: str = "", most: int = BODY) -> DataFrame:
    """(session, n, body): payloads in order up to the first end frame; an empty end frame adds nothing.

    A session of over ``most`` bytes is counted, but its payloads are not
    gathered: its body is null.
    """
    rows = frames
    if end:
        before = F.coalesce(F.sum(F.col(end).cast("int")).over(W.partitionBy(session).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_before", before).where("_before = 0").where(~F.coalesce(F.col(end), F.lit(False)) | (F.octet_length(payload) > 0))
    rows = rows.withColumn("_fits", F.coalesce(F.sum(F.octet_length(payload).cast("long")).over(W.partitionBy(session)), F.lit(0)) <= most)
    parts = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(F.col(seq).alias("s"), F.col(payload).alias("p")))))
    body = F.when(F.bool_and("_fits"), F.array_join(F.transform(parts, lambda x: x["p"]), joiner))
    return rows.groupBy(session).agg(F.count("*").alias("n"), body.alias("body"))


def not_cancelled(frames: DataFrame, cancels: DataFrame, session: str) -> DataFrame:
    return frames.join(cancels.select(session).distinct(), session, "left_anti")


def past_deadline(start: Column, end: Column, deadline_ms: Column) -> Column:
    """Whether a call ran over its relative deadline; 0 is none."""
    took = (end.cast("double") - start.cast("double")) * 1000
    return F.when(deadline_ms > 0, took > deadline_ms).otherwise(F.lit(False))


def idle_gaps(frames: DataFrame, session: str, ts: str, seconds: int = 30) -> DataFrame:
    """Extension: frames that follow an idle time of over ``seconds``, when a ping would have been sent."""
    at = F.col(ts).cast("timestamp").cast("double")
    gap = at - F.lag(at).over(W.partitionBy(session).orderBy(ts, *[c for c in frames.columns if c not in (session, ts)]))
    return frames.withColumn("gap_s", gap).where(F.col("gap_s") > seconds)
