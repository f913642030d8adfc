"""Connection state: who is connected, handshakes, and the effect of deleting a device."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.payload import compute_once, not_null, payload_fields, truthy
from tidemark.operators.history import time_literal
from tidemark.operators.joins import lookup

HANDSHAKE_LIMIT = "INTERVAL '20' SECOND"  # Fixed value: time a connection may wait unauthenticated.

# Texts of handshake replies.
BAD_KEY = "Secret key tidak valid"
SEND_AUTH = 'Kirim {"action":"auth","key":"..."} untuk authenticating'


def connection_steps(events: DataFrame) -> DataFrame:
    """Last open, auth and close time per connection.

    Maxima of fixed-width columns: a hash aggregate with a map-side part, and associative, so partial
    results of batches can be reduced again.
    """
    def last(event: str):
        return F.max(F.when(F.col("event") == event, F.col("ts"))).alias(f"{event}_ts")
    return events.groupBy("conn_key").agg(last("open"), last("auth"), last("close"))


def reduce_connection_steps(steps: DataFrame) -> DataFrame:
    """Steps per connection from partial ones."""
    return steps.groupBy("conn_key").agg(*[F.max(c).alias(c) for c in ("open_ts", "auth_ts", "close_ts")])


def connection_state(steps: DataFrame) -> DataFrame:
    """State after the latest step; at equal times auth follows open and close follows both."""
    started = F.greatest("open_ts", "auth_ts")
    closed = F.coalesce(F.col("close_ts") >= F.coalesce(started, F.col("close_ts")), F.lit(False))
    authenticated = F.coalesce(F.col("auth_ts") >= F.coalesce("open_ts", "auth_ts"), F.lit(False))
    return steps.select(
        "conn_key", F.when(closed, "closed").when(authenticated, "authenticated").otherwise("open").alias("state"),
        F.when(closed, F.col("close_ts")).otherwise(started).alias("since"))


def newest_connections(connections: DataFrame, mode: str = "single", as_of: datetime | None = None) -> DataFrame:
    """Authenticated device connections that remain; with ``as_of`` only those open at that time.

    ``single``: a device keeps only the connection that authenticated last; ``coexist``: all remain.
    """
    live = connections.where((F.col("conn_type") == "device") & F.col("auth_at").isNotNull())
    if as_of is not None:
        now = time_literal(connections, as_of, "opened_at")
        live = live.where((F.col("opened_at") <= now) & (F.col("closed_at").isNull() | (F.col("closed_at") > now)))
    if mode == "coexist":
        return live
    if mode != "single":
        raise ValueError(f"unknown mode: {mode}")
    newest = Window.partitionBy("device_id").orderBy(F.desc("auth_at"), F.desc("conn_key"))
    return live.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= 1).drop("_rank")


def auth_attempts(handshakes: DataFrame, registry: DataFrame) -> DataFrame:
    """Messages of waiting connections: is it an auth request, and does its key exist.

    ``handshakes`` holds conn_key, ts and raw. Text that is not JSON is ignored without a reply.
    """
    parsed = payload_fields(handshakes, "raw", "action", "key").where("is_json")
    action, key = F.col("_action"), F.col("_key")
    asks = F.coalesce(not_null(action) & (action.cast("string") == "auth") & truthy(key), F.lit(False))
    known = registry.select("secret_key", "device_id", "device_name").withColumn("key_ok", F.lit(True))
    asked = (compute_once(parsed, {"is_auth": asks, "secret_key": F.when(asks, key.cast("string"))})
             .drop("is_json", "_action", "_key"))
    return (lookup(asked, known, "secret_key", "conn_key").drop("secret_key")
            .withColumn("key_ok", F.coalesce("key_ok", F.lit(False))))


def handshake_steps(opens: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per connection: open time, first accepted and first refused auth request.

    ``opens`` holds conn_key and opened_at. One hash aggregate over both inputs; associative.
    """
    nothing = F.lit(None).cast(opens.schema["opened_at"].dataType)
    rows = (opens.select("conn_key", "opened_at", nothing.alias("good_ts"), nothing.alias("bad_ts"))
            .unionByName(attempts.where(F.col("is_auth")).select(
                "conn_key", nothing.alias("opened_at"),
                F.when(F.col("key_ok"), F.col("ts")).alias("good_ts"),
                F.when(~F.col("key_ok"), F.col("ts")).alias("bad_ts"))))
    return reduce_handshake_steps(rows)


def reduce_handshake_steps(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conn_key").agg(F.min("opened_at").alias("opened_at"),
                                        F.min("good_ts").alias("good_ts"), F.min("bad_ts").alias("bad_ts"))


def handshake_verdicts(steps: DataFrame, as_of: datetime) -> DataFrame:
    """Outcome per connection at the given time: accepted, bad_key, timeout or pending.

    A refused key closes at once; without an accepted one the connection closes at the limit.
    """
    limit = F.col("opened_at") + F.expr(HANDSHAKE_LIMIT)
    now = time_literal(steps, as_of, "opened_at")
    known = steps.where(F.col("opened_at").isNotNull()).withColumns({
        f"_{c}": F.when((F.col(c) < limit) & (F.col(c) <= now), F.col(c)) for c in ("good_ts", "bad_ts")})
    bad = F.col("_bad_ts").isNotNull() & (F.col("_good_ts").isNull() | (F.col("_bad_ts") < F.col("_good_ts")))
    verdict = (F.when(bad, "bad_key").when(F.col("_good_ts").isNotNull(), "accepted")
               .when(limit <= now, "timeout").otherwise("pending"))
    return (known.withColumn("verdict", verdict)
            .select("conn_key", "opened_at", "verdict",
                    F.when(F.col("verdict") == "bad_key", F.col("_bad_ts"))
                     .when(F.col("verdict") == "accepted", F.col("_good_ts"))
                     .when(F.col("verdict") == "timeout", limit).alias("decided_at")))


def handshake_replies(attempts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Reply to each message of a waiting connection.

    With ``verdicts``, one row per connection, only messages up to the deciding one are answered, and none at or after
    the limit: then the socket is closed, or messages are data.
    """
    if verdicts is not None:
        decided = verdicts.select("conn_key", "verdict", "decided_at")
        late = F.when(F.col("verdict") == "timeout", F.col("ts") >= F.col("decided_at")).otherwise(
            F.col("ts") > F.col("decided_at"))
        attempts = attempts.join(decided, "conn_key").where(~F.coalesce(late, F.lit(False)))
    good = F.col("is_auth") & F.col("key_ok")
    return attempts.select(
        "conn_key", "ts", F.when(good, "success").otherwise("error").alias("status"),
        F.when(good, F.concat(F.lit('Terauthentikasi sebagai "'), F.col("device_name"), F.lit('"')))
         .when(F.col("is_auth"), BAD_KEY).otherwise(SEND_AUTH).alias("message"),
        F.when(good, F.col("device_id")).alias("device_id"))


def delete_results(requests: DataFrame, table: DataFrame, id_column: str) -> DataFrame:
    """Outcome of owner-checked delete requests, in order of request_id.

    The first request by the owner succeeds with 200; later ones, and those of anyone else, get 404.
    """
    keys = [id_column, "user_id"]
    owned = requests.join(table.select(*keys), keys, "left_semi")
    first = owned.groupBy(id_column).agg(F.min("request_id").alias("request_id")).select("request_id", F.lit(200).alias("_done"))
    return (requests.join(first, "request_id", "left")
            .select("request_id", *keys, F.coalesce("_done", F.lit(404)).alias("status")))


def deleted_ids(results: DataFrame, id_column: str) -> DataFrame:
    return results.where(F.col("status") == 200).select(id_column)


def without(table: DataFrame, deleted: DataFrame, id_column: str) -> DataFrame:
    """The table after the deletes. Rows of other tables that refer to them stay."""
    return table.join(deleted, id_column, "left_anti")


def revoked_keys(registry: DataFrame, deleted: DataFrame) -> DataFrame:
    """Registry entries that go with the deleted devices."""
    return registry.join(deleted, "device_id", "left_semi")


def close_events(connections: DataFrame, deleted: DataFrame, as_of: datetime) -> DataFrame:
    """Close event for every open authenticated device connection of a deleted device."""
    from tidemark.operators.routing import is_authenticated, is_open
    now = time_literal(connections, as_of, "opened_at")
    return (connections.where((F.col("conn_type") == "device") & is_open(connections, as_of)
                              & is_authenticated(connections, as_of))
            .join(deleted, "device_id", "left_semi")
            .select("conn_key", F.lit("close").alias("event"), now.alias("ts"), "device_id"))
