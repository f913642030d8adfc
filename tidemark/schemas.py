"""Fixed schemas of the logical tables and of the incoming streams."""

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
])

DEVICES = T.StructType([
    T.StructField("device_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("api_key", T.StringType()),
    T.StructField("secret_key", T.StringType()),
    T.StructField("public_slug", T.StringType()),
])

WIDGETS = T.StructType([
    T.StructField("widget_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("sensor_type", T.StringType()),
    T.StructField("widget_type", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("current_value", T.StringType()),
])

READINGS = T.StructType([
    T.StructField("data_id", T.LongType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("sensor_type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

CONNECTIONS = T.StructType([
    T.StructField("conn_key", T.LongType()),
    T.StructField("conn_type", T.StringType()),
    T.StructField("device_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("slug", T.StringType()),
    T.StructField("opened_at", T.TimestampNTZType()),
    T.StructField("auth_at", T.TimestampNTZType()),
    T.StructField("closed_at", T.TimestampNTZType()),
])

CONNECTION_EVENTS = T.StructType([
    T.StructField("conn_key", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

MESSAGES = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("secret_key", T.StringType()),
    T.StructField("raw", T.StringType()),
])

TABLES = {
    "users": USERS, "devices": DEVICES, "widgets": WIDGETS, "sensor_data": READINGS,
    "connections": CONNECTIONS, "connection_events": CONNECTION_EVENTS, "messages": MESSAGES,
}
