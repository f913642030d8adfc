"""Reading loosely typed JSON payloads with variant functions.

Every function maps columns to columns. A missing field is SQL NULL; an explicit JSON null is a
variant null, so the two stay distinguishable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def compute_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read instead of repeating their expressions.

    A one-row generator keeps the optimizer from copying the expressions into every use, which for
    payload parsing multiplies the work and outgrows the size limit of generated code.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(raw: Column) -> Column:
    """Variant document of a JSON text; NULL when the text is JSON null or not exactly one JSON value.

    The parser stops after the first value, so ``{"a":1} x`` would pass. Wrapping the text as an
    object member and as the only array item leaves trailing text no way to stay valid JSON. The
    member is kept as ``$.m``; :func:`fields` reads below it. A text that starts with a brace and ends with its only
    closing one cannot close the wrapper, so the costlier look as an array is left to all others.
    """
    member = F.try_parse_json(F.concat(F.lit('{"m":'), raw, F.lit("}")))
    flat = raw.startswith("{") & (F.instr(raw, "}") == F.char_length(raw))
    single = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    return F.when(flat | ((F.btrim(raw, F.lit(" \t\r\n")) != "null") & single), member)


def fields(document: Column, names: tuple[str, ...], kind: str = "variant") -> Column:
    """Struct of the named fields, found in one walk over the document; NULL when it is no object."""
    return F.try_variant_get(document, "$.m", f"struct<{', '.join(f'`{n}`: {kind}' for n in names)}>")


def present(value: Column) -> Column:
    """The field exists, possibly as JSON null."""
    return value.isNotNull()


def not_null(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def as_text(value: Column) -> Column:
    """Text of a value as a browser would print it; NULL for JSON null or a missing field."""
    return value.cast("string")


def as_number_text(value: Column, plain: Column | None = None) -> Column:
    """Like :func:`as_text`, with every number as a browser prints it: the shortest digits of the double, in full
    from 1e-6 up to 1e21, else with an exponent.

    Texts that can differ from that form are those with an exponent, ending in ``.0``, of 16 or more characters,
    below 1e-6, and ``-0``; the costlier look at the type and the digits is limited to them. ``plain`` is the value's text, if
    it is at hand.
    """
    plain = as_text(value) if plain is None else plain
    is_number = F.schema_of_variant(value).rlike("^(DOUBLE|DECIMAL|BIGINT)")
    unusual = plain.rlike(r"^-?(?:[0-9.]{16,}|0\.000000[0-9]*|[0-9.]+E-?[0-9]+|[0-9]+\.0|Infinity)$|^-0$")
    return F.when(unusual, F.when(is_number, browser_number(plain.try_cast("double"))).otherwise(plain)).otherwise(plain)


def browser_number(number: Column) -> Column:
    """A double as a browser prints it, by moving the point within the digits of its text."""
    text = number.cast("string")
    whole = F.regexp_extract(text, r"^-?([0-9]*)", 1)
    every = F.concat(whole, F.regexp_extract(text, r"\.([0-9]*)", 1))
    leading = F.regexp_extract(every, "^(0*)", 1)
    digits = F.regexp_replace(every, "^0+|0+$", "")
    exponent = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    n, k = F.length(whole) + exponent - F.length(leading), F.length(digits)  # the point stands after n digits
    zeros = lambda count: F.repeat(F.lit("0"), count)
    rest = F.substring(digits, 2, 2**31 - 1)
    size = (F.when((k <= n) & (n <= 21), F.concat(digits, zeros(n - k)))
            .when((0 < n) & (n <= 21), F.concat(digits.substr(F.lit(1), n), F.lit("."), digits.substr(n + 1, k)))
            .when((-6 < n) & (n <= 0), F.concat(F.lit("0."), zeros(-n), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""),
                                F.when(n > 0, "e+").otherwise("e"), (n - 1).cast("string"))))
    return (F.when(number == 0, "0").when(text.rlike("^-?[0-9]"), F.concat(F.when(number < 0, "-").otherwise(""), size))
            .otherwise(text))


def truthy(value: Column, plain: Column | None = None) -> Column:
    """False for a missing field, null, empty text, false and zero; true for everything else."""
    plain = as_text(value) if plain is None else plain
    return (F.when(plain.isNull() | (plain == ""), False)
            .when(plain.isin("0", "-0", "0.0", "-0.0", "false"), F.schema_of_variant(value) == "STRING")
            .otherwise(True))


def allow_repeated_keys(spark: SparkSession) -> None:
    """Let the last one of repeated JSON keys count, as clients expect; a session that forbids it is an error."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    if setting not in spark.conf.getAll:
        spark.conf.set(setting, "true")
    if spark.conf.get(setting) != "true":
        raise RuntimeError(f"{setting} is off: payloads with a repeated key would pass for malformed")


def payload_fields(messages: DataFrame, raw: str, *names: str) -> DataFrame:
    """Add ``is_json`` and the named payload fields as variants ``_name``."""
    allow_repeated_keys(messages.sparkSession)
    parsed = compute_once(messages, {"_document": parse(F.col(raw))})
    read = compute_once(parsed, {"is_json": F.col("_document").isNotNull(), "_fields": fields(F.col("_document"), names)})
    return read.withColumns({f"_{n}": F.col(f"_fields.{n}") for n in names}).drop("_document", "_fields")


def is_command_type(kind: Column) -> Column:
    return F.coalesce(kind.cast("string") == "command", F.lit(False))


def with_fields(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the normalised payload fields.

    ``sensor_type``: ``var``, or ``sensor_type`` when ``var`` is null or missing.
    ``value``: ``val``, or ``value`` only when ``val`` is missing; an explicit null stays null.
    ``payload_value``: the value in its JSON type, to be sent on as it came.
    ``target_text``: the addressed device, NULL when missing, null or empty.
    """
    sources = ("var", "sensor_type", "val", "value", "type", "device_id")
    known = payload_fields(messages, raw, *sources)
    chosen = compute_once(known, {
        "_name": F.when(not_null(F.col("_var")), F.col("_var")).otherwise(F.col("_sensor_type")),
        "payload_value": F.when(present(F.col("_val")), F.col("_val")).otherwise(F.col("_value")),
    })
    # Texts are made once; every further question is asked of them.
    texts = compute_once(chosen, {
        "_name_text": as_text(F.col("_name")),
        "_plain": as_text(F.col("payload_value")),
        "_device": as_text(F.col("_device_id")),
    })
    value, name, device = F.col("payload_value"), F.col("_name"), F.col("_device_id")
    target = F.nullif(F.col("_device"), F.lit(""))
    return compute_once(texts, {
        "name_ok": truthy(name, F.col("_name_text")),
        "sensor_type": F.col("_name_text"),
        "value_present": present(value),
        "value": as_number_text(value, F.col("_plain")),
        "target_text": target,
        "target_truthy": truthy(device, F.col("_device")),
        "is_command": is_command_type(F.col("_type")) | target.isNotNull(),
    }).drop("_name", "_name_text", "_plain", "_device", *[f"_{n}" for n in sources])


def priority(conn_type: Column, is_command: Column) -> Column:
    """Dashboard messages and device commands go first (1), device data second (0)."""
    return F.when((conn_type == "dashboard") | is_command, 1).otherwise(0)


def message_class(conn_type: Column, is_command: Column) -> Column:
    return (F.when(conn_type == "dashboard", "dashboard-command")
            .when(is_command, "device-command").otherwise("device-data"))


def auto_route(messages: DataFrame, own_device: str, raw: str = "raw") -> DataFrame:
    """Turn a var+val message without a target into a command for the sender's own device.

    Adds ``auto_routed`` and ``routed_raw``; every other payload passes unchanged.
    """
    known = payload_fields(messages, raw, "var", "val", "type", "device_id")
    kind = F.col("_type")
    routed = (present(F.col("_var")) & present(F.col("_val")) & ~present(F.col("_device_id"))
              & F.col(own_device).isNotNull() & (kind.isNull() | is_command_type(kind)))
    body = F.rtrim(F.regexp_replace(F.col(raw), r"\}\s*$", ""))
    extra = F.concat(F.when(kind.isNull(), ',"type":"command"').otherwise(""),
                     F.lit(',"device_id":'), F.col(own_device).cast("string"), F.lit("}"))
    return (compute_once(known, {"auto_routed": F.coalesce(routed, F.lit(False))})
            .withColumn("routed_raw", F.when(F.col("auto_routed"), F.concat(body, extra))
                        .otherwise(F.col(raw)))
            .drop("is_json", "_var", "_val", "_type", "_device_id"))


def frame_head(document: Column) -> Column:
    """What :func:`frame_class` reads of a parsed server frame."""
    return fields(document, ("status", "type"), "string")


def frame_class(document: Column, head: Column | None = None) -> Column:
    """Kind of a parsed server frame: ACK, ERROR, DATA, JSON, or RAW when it is not a JSON value.

    ``head`` is its :func:`frame_head`, if it is at hand.
    """
    head = frame_head(document) if head is None else head
    status, kind = head["status"], head["type"]
    return (F.when(document.isNull(), "RAW")
            .when(status.isin("success", "ack"), "ACK")
            .when(status == "error", "ERROR")
            .when(kind == "dataUpdate", "DATA")
            .otherwise("JSON"))


def command_word(command: Column) -> Column:
    """Kind of a client command line, NULL when it is none."""
    return (F.when(command.startswith("CONNECT:"), "CONNECT")
            .when(command.startswith("SEND:"), "SEND")
            .when(command.startswith("STATUS:"), "STATUS")
            .when(command == "CLEAR", "CLEAR"))


def command_argument(command: Column) -> Column:
    """Text after the prefix of CONNECT and SEND."""
    return (F.when(command.startswith("CONNECT:"), F.substring(command, 9, 2**31 - 1))
            .when(command.startswith("SEND:"), F.substring(command, 6, 2**31 - 1)))
