"""Request bodies: what is readable, what it means, and names that must match as a whole."""

import pytest

from duewatch.operators import lifecycle as LC
from duewatch.sources.requests import parse_complete_requests, parse_create_requests

READABLE = {
    '{"id":"abc"}': ("abc", None, None, None),
    ' \t{"id":"abc","deadline":12,"tags":[],"context":{}}\n ': ("abc", 12, [], {}),
    '{"id":7,"deadline":"12"}': ("7", 12, None, None),
    '{"id":null,"deadline":null,"tags":null,"context":null}': (None, None, None, None),
    '{"id":"a]}","tags":[{"key":"k","value":"}"}],"other":[{}]}': ("a]}", None, [("k", "}")], None),
    '{"id":"a","context":{"n":1,"o":{"p":[1,2]},"q":null}}': ("a", None, None, {"n": "1", "o": '{"p":[1,2]}', "q": None}),
    '{"id":"a","deadline":-9223372036854775808}': ("a", -(1 << 63), None, None),
    '{"id":"a","tags":[{"key":"k"}]}': ("a", None, [("k", None)], None),
    "{}": (None, None, None, None),
}
UNREADABLE = [
    None, "", "  ", "{", "null", "[]", '"x"', "7", "{broken", "[1]",
    '{"id":"a"} trailing', '{"id":"a"}]', '{"id":"a"}}', '{"id":"a"},{"id":"b"}', '{"id":"a"}{"id":"b"}', '{"id":"a"}],[', '{"id":"a"}}, {',
    '{"id":"a"}] }', '{"id":"a"},"c":{', '{"id":"a"},',
    '{"id":["a"]}', '{"id":{"a":1}}', '{"id":"a","deadline":"soon"}', '{"id":"a","deadline":1.5}', '{"id":"a","deadline":true}',
    '{"id":"a","deadline":[1]}', '{"id":"a","deadline":9223372036854775808}', '{"id":"a","deadline":""}', '{"id":"a","deadline":"1\\n"}',
    '{"id":"a","tags":{"key":"k","value":"v"}}', '{"id":"a","tags":"zz"}', '{"id":"a","tags":[1]}', '{"id":"a","tags":["x"]}',
    '{"id":"a","tags":[{"key":["k"],"value":"v"}]}', '{"id":"a","tags":[{"key":"k","value":{}}]}', '{"id":"a","tags":[[]]}',
    '{"id":"a","context":[1]}', '{"id":"a","context":"c"}', '{"id":"a","context":3}',
]


def rows(spark, bodies):
    df = spark.createDataFrame([(i, "n", b) for i, b in enumerate(bodies)], "i int, name string, body string")
    return df.withColumn("received_at", df["i"].cast("timestamp"))


def test_readable_create_bodies(spark):
    got = parse_create_requests(rows(spark, list(READABLE))).orderBy("i").collect()
    for r, (body, want) in zip(got, READABLE.items(), strict=True):
        tags = None if r.tags is None else [tuple(t) for t in r.tags]
        assert not r.unreadable and (r.id, r.deadline, tags, r.context) == want, body


def test_unreadable_create_bodies(spark):
    parsed = parse_create_requests(rows(spark, UNREADABLE))
    got = parsed.withColumn("reason", LC.validate_create(parsed)).orderBy("i").collect()
    for r, body in zip(got, UNREADABLE, strict=True):
        assert r.unreadable and (r.id, r.deadline, r.tags, r.context) == (None,) * 4 and r.reason == "body_unreadable", body


@pytest.mark.parametrize("body, want", [
    (None, "COMPLETED"), ("", "COMPLETED"), (" ", "COMPLETED"), ("{}", "COMPLETED"), ('{"status":null}', "COMPLETED"), ('{"status":"FAILED"}', "FAILED"),
    ('{"status":"DONE","x":1}', "DONE"), ('{"status":["FAILED"]}', None), ('{"status":5}', None), ('{"status":"FAILED"} x', None),
    ('{"status":"FAILED"}}', None), ('{"status":"FAILED"}]', None), ("null", None), ('"FAILED"', None), ("[]", None)])
def test_complete_bodies(spark, body, want):
    r = parse_complete_requests(rows(spark, [body])).first()
    assert (r.status, r.unreadable) == (want, want is None)


def test_name_is_matched_whole(spark):
    names = ["n", "n\n", "\nn", "a b", "a-b_C9", "n\r", "n ", ""]
    df = spark.createDataFrame([(n, "user", None, None) for n in names], "name string, id string, deadline long, tags array<struct<key:string,value:string>>")
    got = [r.reason for r in df.select(LC.validate_edge(df).alias("reason")).collect()]
    assert got == [None, "name_pattern", "name_pattern", "name_pattern", None, "name_pattern", "name_pattern", "name_required"]
