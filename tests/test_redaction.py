import json
import random

from panelwright.operators.quality import redacted

CASES = {
    '{"token": 12345}': '{"token": "***"}',
    '{"auth_token": "a"}': '{"auth_token": "***"}',
    '{"a": {"b": [{"Password": "x\\"y", "c": 1}]}}': '{"a": {"b": [{"Password": "***", "c": 1}]}}',
    '{"secret": {"deep": {"er": ["}", "]", "\\""]}}, "k": 1}': '{"secret": "***", "k": 1}',
    '{"note": "Bearer abc.def-1 and more"}': '{"note": "*** and more"}',
    '{"password": "rest \\" of it': '{"password": "***"',
    '{"password": "ends in a backslash\\': '{"password": "***"',
    '{"api_key": [1, 2': '{"api_key": "***"',
    '{"API-KEY": null, "apiKey": true, "x": false}': '{"API-KEY": null, "apiKey": "***", "x": false}',
    "not json, \"token\" : 'x', \"b\":2": 'not json, "token" : "***", "b":2',
    '{"tok": "kept", "passw": 1}': '{"tok": "kept", "passw": 1}',
    "": "",
    None: None,
}


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "text string")
    assert {r.text: r.out for r in df.select("text", redacted(df.text).alias("out")).collect()} == CASES


def test_against_a_walk_over_parsed_values(spark):
    """Documents made at random; long and deep ones among them."""
    rng = random.Random(8)
    words = ["name", "token", "x_secret_y", "k", "Authorization", "list", 'q"uote', "back\\slash"]

    def made(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return {rng.choice(words): made(depth - 1) for _ in range(rng.randrange(4))}
        if kind == 5:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return rng.choice([rng.random(), None, True, rng.choice(["plain", 'with "quotes"', "}{][", "a\\"])])

    def walked(x):
        if isinstance(x, dict):
            return {k: "***" if any(s in k.lower() for s in ("token", "secret", "authorization")) else walked(v) for k, v in x.items()}
        return [walked(v) for v in x] if isinstance(x, list) else x

    docs = [{"top": made(5), "n": i} for i in range(300)] + [{"token": ["x" * 50] * 3000, "list": list(range(20000))}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, text string")
    got = {r.i: json.loads(r.out) for r in df.select("i", redacted(df.text).alias("out")).collect()}
    assert all(got[i] == walked(d) for i, d in enumerate(docs))
