"""Hand-computed payload cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import payload


def fields(spark, *raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "msg_id long, raw string")
    return payload.with_fields(rows).orderBy("msg_id").collect()


@pytest.mark.parametrize("raw, name, value, present", [
    ('{"var":"a","val":null,"value":3}', "a", None, True),
    ('{"var":"a"}', "a", None, False),
    ('{"var":"a","value":3}', "a", "3", True),
    ('{"var":null,"sensor_type":"b","val":1}', "b", "1", True),
    ('{"var":"a","val":25.0}', "a", "25", True),
    ('{"var":"a","val":25.50}', "a", "25.5", True),
    ('{"var":"a","val":1e3}', "a", "1000", True),
    ('{"var":"a","val":1.25e-3}', "a", "0.00125", True),
    ('{"var":"a","val":1e-7}', "a", "1e-7", True),
    ('{"var":"a","val":1e21}', "a", "1e+21", True),
    ('{"var":"a","val":5e20}', "a", "500000000000000000000", True),
    ('{"var":"a","val":1.2345678901234567e-5}', "a", "0.000012345678901234568", True),
    ('{"var":"a","val":-1.5e-7}', "a", "-1.5e-7", True),
    ('{"var":"a","val":0.0000001}', "a", "1e-7", True),
    ('{"var":"a","val":12345678901234567890}', "a", "12345678901234567000", True),
    ('{"var":"a","val":"12345678901234567890"}', "a", "12345678901234567890", True),
    ('{"var":"a","val":123.456e1}', "a", "1234.56", True),
    ('{"var":"a","val":0e0}', "a", "0", True),
    ('{"var":"a","val":true}', "a", "true", True),
    ('{"var":"a","val":""}', "a", "", True),
    ('{"var":"a","val":{"x":1}}', "a", '{"x":1}', True),
    ('{"var":"a","val":1,"val":2}', "a", "2", True),
])
def test_names_and_values(spark, raw, name, value, present):
    row, = fields(spark, raw)
    assert (row.is_json, row.name_ok, row.sensor_type, row.value, row.value_present) == (True, True, name, value, present)


@pytest.mark.parametrize("raw", ["nojson", "null", "", '{"a":1} x', '{"a":1}}', '[1] junk', "1} junk", "1,2", '1, "b":2',
                                 "{a:1}", '{"var":"a","val":NaN}'])
def test_not_one_json_value(spark, raw):
    assert fields(spark, raw)[0].is_json is False


@pytest.mark.parametrize("raw", ['5', '"text"', '[1]', ' {"val":1} '])
def test_json_without_a_name_is_json_but_invalid(spark, raw):
    row, = fields(spark, raw)
    assert row.is_json and not row.name_ok


@pytest.mark.parametrize("name, ok", [('""', False), ("0", False), ("0.0", False), ("false", False), ("null", False),
                                      ('"0"', True), ('"false"', True), ("true", True), ("7", True), ("{}", True),
                                      ("[]", True), ("0e5", False)])
def test_empty_names(spark, name, ok):
    assert fields(spark, '{"var":%s,"val":1}' % name)[0].name_ok is ok


@pytest.mark.parametrize("raw, target, command", [
    ('{"device_id":0,"var":"a","val":1}', "0", True),
    ('{"device_id":"","var":"a","val":1}', None, False),
    ('{"device_id":null,"var":"a","val":1}', None, False),
    ('{"type":"command","var":"a","val":1}', None, True),
    ('{"type":"other","var":"a","val":1}', None, False),
    ('{"device_id":"12","var":"a","val":1}', "12", True),
])
def test_targets(spark, raw, target, command):
    row, = fields(spark, raw)
    assert (row.target_text, row.is_command) == (target, command)


@pytest.mark.parametrize("raw, device, routed", [
    ('{"var":"a","val":1}', 5, '{"var":"a","val":1,"type":"command","device_id":5}'),
    ('{"var":"a","val":1,"type":"command"}', 5, '{"var":"a","val":1,"type":"command","device_id":5}'),
    ('{"var":"a","val":null}', 5, '{"var":"a","val":null,"type":"command","device_id":5}'),
    ('{"var":"a","val":1,"device_id":null}', 5, None),
    ('{"var":"a","val":1,"type":"other"}', 5, None),
    ('{"var":"a","val":1,"type":null}', 5, None),
    ('{"var":"a","val":1}', None, None),
    ('{"sensor_type":"a","value":1}', 5, None),
    ("nojson", 5, None),
])
def test_auto_route(spark, raw, device, routed):
    rows = spark.createDataFrame([(raw, device)], "raw string, own long")
    row = payload.auto_route(rows, "own").first()
    assert (row.auto_routed, row.routed_raw) == (routed is not None, routed or raw)


def test_frames(spark):
    cases = {'{"status":"ack"}': "ACK", '{"status":"success","device_id":1}': "ACK", '{"status":"error"}': "ERROR",
             '{"type":"dataUpdate","var":"a"}': "DATA", '{"type":"command"}': "JSON", "5": "JSON", "null": "RAW",
             "hello": "RAW", '{"status":"ack","type":"dataUpdate"}': "ACK"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    raw = F.col("raw")
    got = rows.select("raw", payload.frame_class(payload.parse(raw)).alias("c")).collect()
    assert {r.raw: r.c for r in got} == cases


def test_command_lines(spark):
    cases = {"CONNECT:ws://x": ("CONNECT", "ws://x"), "SEND:{}": ("SEND", "{}"), "SEND:": ("SEND", ""),
             "STATUS:": ("STATUS", None), "STATUS": (None, None), "CLEAR": ("CLEAR", None), "CLEAR ": (None, None)}
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    got = rows.select("c", payload.command_word(F.col("c")), payload.command_argument(F.col("c"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases


def test_repeated_keys_need_the_setting(spark):
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "false")
        with pytest.raises(RuntimeError):
            fields(spark, '{"var":"a"}')
        spark.conf.unset(setting)
        assert fields(spark, '{"var":"a","val":1,"val":2}')[0].value == "2"
    finally:
        spark.conf.set(setting, before)


def test_flat_texts_are_parsed_like_all_others(spark):
    """Texts around the short cut of ``parse`` against its rule: a value as a member and as the only array item."""
    raws = ['{"a":1}', "{}", '{"a":1}}', '{"a":1} x', '{"a":1},"m":{"b":2}', '{"a":1},{"b":2}', ' {"a":1}', '{"a":1}\n',
            '{"a":"}"}', '{"a":"x}', '{"a":"x\\"}', '{"a":"{"}', '{"a":{"b":1}', '{"a":{"b":1}}', '{"a":[1}', '{"a":[1]}',
            '{"a":1', "{a}", "{}}", "}", "{", "null", " null ", "1}", "1", "[1]", "[1]]", '"x"', "", " ", None]
    raw = F.col("raw")
    member = F.try_parse_json(F.concat(F.lit('{"m":'), raw, F.lit("}")))
    single = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    rule = F.when((F.btrim(raw, F.lit(" \t\r\n")) != "null") & single, member)
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select(
        "raw", F.to_json(payload.parse(raw)).alias("got"), F.to_json(rule).alias("want")).collect()
    assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]
    assert sum(r.got is not None for r in rows) == 11


def test_fields_are_found_in_one_walk(spark):
    rows = spark.createDataFrame([('{"var":"a","val":1}',)], "raw string")
    for frame in (payload.payload_fields(rows, "raw", "var", "val", "type"),
                  payload.compute_once(rows, {"head": payload.frame_head(payload.parse(F.col("raw")))})):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") == 1
