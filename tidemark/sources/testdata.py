"""The logical tables, derived by Spark from the given test tables.

FIXTURES.md holds the same definitions as SQL text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sensors of a device page (index, sensor, widget kind, declared type).
PAGE_WIDGETS = [
    (1, "signup", "text", "string"),
    (2, "purchase", "gauge", "integer"),
    (3, "error", "toggle", "boolean"),
    (4, "view", "slider", "integer"),
    (5, "click", "graph", "float"),
    (6, "view", "gauge", "float"),
]


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def seconds(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), count)


class TestTables:
    """Lazy access to every logical table and request set over one test-data folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("long").alias("user_id"),
            F.col("n_name").alias("username"),
            F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"))

    @cached_property
    def devices(self) -> DataFrame:
        key = F.col("c_custkey")
        return (self.raw("customer").select(
            key.alias("device_id"),
            F.col("c_nationkey").cast("long").alias("user_id"),
            F.when(key % 10 == 0, "Shared").otherwise(F.col("c_name")).alias("device_name"),
            F.md5(F.concat(F.lit("a"), text(key))).alias("api_key"),
            F.when(key % 50 == 7, F.lit(None)).when(key % 50 == 8, "")
             .otherwise(F.md5(F.concat(F.lit("s"), text(key)))).alias("secret_key"),
            F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("dev-"), text(key)))
             .alias("public_slug")))

    @cached_property
    def readings(self) -> DataFrame:
        value = (F.when(F.col("event_type") == "error",
                        F.when(F.col("value") >= 25, "true").otherwise("false"))
                 .when(F.col("event_id") % 97 == 0, "")
                 .otherwise(text("value")))
        # Readings of a device that is not registered.
        device = F.when(F.col("event_id") % 53 == 0, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id"))
        return self.raw("events").select(
            (F.col("event_id") + 1).alias("data_id"), device.alias("device_id"),
            F.col("event_type").alias("sensor_type"), value.alias("value"), "ts")

    @cached_property
    def widgets(self) -> DataFrame:
        kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(s).alias("sensor_type"),
                                   F.lit(w).alias("widget_type"), F.lit(d).alias("data_type"))
                          for i, s, w, d in PAGE_WIDGETS])
        segment, idx = F.col("c_mktsegment"), F.col("idx")
        owner = F.col("c_nationkey").cast("long")
        return (self.raw("customer")
                .select("c_custkey", "c_nationkey", "c_mktsegment", F.inline(kinds))
                .where(~((segment == "FURNITURE") & (idx == 1)) & ~((segment == "HOUSEHOLD") & (idx == 5))
                       & ((idx < 6) | (segment == "MACHINERY")))
                .select((F.col("c_custkey") * 10 + idx).alias("widget_id"),
                        F.when(idx == 6, (owner + 1) % 25).otherwise(owner).alias("user_id"),
                        F.col("c_custkey").alias("device_id"), "sensor_type", "widget_type", "data_type",
                        F.when(F.col("widget_type") == "toggle", "false")
                         .when(F.col("widget_type") == "slider", "0").otherwise("")
                         .alias("current_value")))

    @cached_property
    def connections(self) -> DataFrame:
        """Connections within the time of the messages; a device may have several at once and none at times."""
        key = F.col("o_orderkey")
        after = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1992-01-01"))) % 30 * 86400 + key * 7919 % 86400
        day = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + seconds(after)
        return (self.raw("orders")
                .join(self.devices, F.col("o_custkey") == F.col("device_id"))
                .select(key.alias("conn_key"),
                        F.when(key % 4 == 0, "dashboard").when(key % 4 == 3, "public")
                         .otherwise("device").alias("conn_type"),
                        "device_id", "user_id", F.col("public_slug").alias("slug"),
                        day.alias("opened_at"),
                        F.when(F.col("o_orderstatus") != "P", day + seconds(key % 30)).alias("auth_at"),
                        F.when(F.col("o_orderstatus") == "F", day + seconds(F.lit(3600)))
                         .alias("closed_at")))

    @cached_property
    def messages(self) -> DataFrame:
        kind, value, user = F.col("event_type"), text("value"), F.col("user_id")
        shape = F.col("event_id") % 12
        parts = {
            0: ('{"sensor_type":"', kind, '","value":"', value, '"}'),
            1: ('{"var":"', kind, '"}'),
            2: ('{"var":"', kind, '","val":null,"value":3}'),
            3: ('{"var":"","sensor_type":"', kind, '","val":1}'),
            4: ("not json ", kind),
            5: ('{"device_id":', text(user), ',"var":"', kind, '","val":"true"}'),
            6: ('{"device_id":', text(user + 1), ',"var":"', kind, '","val":"true"}'),
            7: ('{"type":"command","var":"', kind, '","val":', value, "}"),
            8: ('{"var":null,"sensor_type":"', kind, '","val":true}'),
            9: ('{"device_id":"","var":"', kind, '","val":', value, "}"),
            10: ('{"device_id":', text(user), ',"sensor_type":"', kind, '","current_value":"true"}'),
            11: ('{"var":"', kind, '","val":', value, "}"),
        }
        raw = F.lit(None).cast("string")
        for number, pieces in parts.items():
            joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
            raw = F.when(shape == number, joined).otherwise(raw)
        return self.raw("events").select(
            F.col("event_id").alias("msg_id"), "ts",
            F.when(F.col("event_id") % 41 == 0, "no-such-key")
             .otherwise(F.md5(F.concat(F.lit("s"), text(user)))).alias("secret_key"),
            raw.alias("raw"))

    # Request sets: one row per call a client would make.

    @cached_property
    def registrations(self) -> DataFrame:
        key, balance = F.col("c_custkey"), F.col("c_acctbal")
        name = (F.when(balance < 0, "")
                .when(balance > 8000, F.concat(F.lit("NATION_"), text("c_nationkey")))
                .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("-"), text("c_nationkey"))))
        return self.raw("customer").select(
            key.alias("request_id"), name.alias("username"),
            F.concat(F.lower(name), F.lit("@example.com")).alias("email"),
            (key % 9 + 3).alias("password_length"), (key % 13 != 0).alias("password_match"))

    @cached_property
    def device_requests(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self.raw("customer").select(
            F.col("c_custkey").alias("request_id"), F.col("c_nationkey").cast("long").alias("user_id"),
            F.when(balance < 0, "").when(balance > 9500, F.lit(None)).otherwise(F.col("c_name"))
             .alias("device_name"))

    @cached_property
    def widget_requests(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("request_id"), (key % 25).alias("user_id"),
            F.when(F.col("o_totalprice") > 490000, F.lit(None)).otherwise(F.col("o_custkey")).alias("device_id"),
            F.when(F.col("o_totalprice") < 10000, "").otherwise(F.col("o_orderpriority")).alias("sensor_type"),
            F.when(key % 5 == 0, "toggle").when(key % 5 == 1, "slider").when(key % 5 == 2, "gauge")
             .when(key % 5 == 3, "graph").otherwise("text").alias("widget_type"),
            F.when(F.col("o_orderstatus") == "P", "integer").otherwise("string").alias("data_type"))

    @cached_property
    def slug_requests(self) -> DataFrame:
        key = F.col("o_orderkey")
        slug = (F.when(key % 6 == 0, F.concat(F.lit("dev-"), text("o_custkey")))
                .when(key % 6 == 1, F.concat(F.lit("page_"), text(F.floor(F.col("o_totalprice") / 100))))
                .when(key % 6 == 2, "bad slug").when(key % 6 == 3, "")
                .when(key % 6 == 4, F.lit(None))
                .otherwise(F.concat(F.lit("ok-"), text(key))))
        return self._owned_requests().select(
            "request_id", "device_id", "user_id", slug.alias("custom_slug"))

    @cached_property
    def delete_requests(self) -> DataFrame:
        """Every order asks; those that are not urgent come from someone else and are refused."""
        user = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("user_id")).otherwise((F.col("user_id") + 2) % 25)
        return self._owned_requests().select("request_id", "device_id", user.alias("user_id"))

    def _owned_requests(self) -> DataFrame:
        """Requests about a device; those of pending orders come from someone else."""
        owner = F.col("c_nationkey").cast("long")
        return (self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
                .withColumn("request_id", F.col("o_orderkey")).withColumn("device_id", F.col("o_custkey"))
                .withColumn("user_id", F.when(F.col("o_orderstatus") == "P", (owner + 1) % 25).otherwise(owner)))

    @cached_property
    def lookup_requests(self) -> DataFrame:
        balance = F.col("c_acctbal")
        return self.raw("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.when(balance > 9800, F.lit(None))
             .otherwise(F.concat(F.lit("NATION_"), text("c_nationkey"))).alias("username"),
            F.when(balance < -900, "").when(F.col("c_mktsegment") == "FURNITURE", "Shared")
             .otherwise(F.col("c_name")).alias("device_name"))

    @cached_property
    def page_requests(self) -> DataFrame:
        """Visited page paths; many requests may name the same page."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("request_id"),
            F.concat(F.when(F.col("o_orderstatus") == "F", "/").otherwise("/api/public/view/"),
                     F.lit("dev-"), text("o_custkey")).alias("path"))

    @cached_property
    def handshakes(self) -> DataFrame:
        """First message of every connection that opened without credentials."""
        key, day = F.col("o_orderkey"), F.col("o_orderdate")
        secret = F.when(F.col("o_totalprice") > 400000, "wrong").otherwise(
            F.md5(F.concat(F.lit("s"), text("o_custkey"))))
        auth = F.concat(F.lit('{"action":"auth","key":"'), secret, F.lit('"}'))
        return self.raw("orders").select(
            key.alias("conn_key"), day.alias("opened_at"),
            (day + seconds(key % 30)).alias("ts"),
            F.when(F.col("o_orderstatus") == "P", '{"var":"x","val":1}').otherwise(auth).alias("raw"))

    @cached_property
    def client_commands(self) -> DataFrame:
        shape = F.col("msg_id") % 6
        return self.messages.select(
            "msg_id",
            F.when(shape == 0, F.concat(F.lit("CONNECT:ws://hub.example.com/?key="), F.col("secret_key")))
             .when(shape == 1, "STATUS:").when(shape == 2, "CLEAR").when(shape == 3, "CLEAR ")
             .otherwise(F.concat(F.lit("SEND:"), F.col("raw"))).alias("command"))
