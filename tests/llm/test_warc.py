import random

from pyspark.sql import functions as F

from polysem.llm import warc

SCHEMA = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, part string, full string"


def brute(rows):
    out = []
    for rid, url, ts, kind, _, headers, *_ in rows:
        if kind != "revisit":
            continue
        headers = headers or {}
        full = [
            r for r in rows
            if r[3] == "response" and r[4] == 200 and url and r[1] == url and r[2] is not None and ts is not None and r[2] < ts
        ]
        if not full:
            out.append((rid, None, None, "orphan", None))
            continue
        target = max(full, key=lambda r: (r[2], r[0] if r[0] is not None else -1))
        theirs, outcome = target[5] or {}, "unverified"
        for name in warc.VALIDATORS:
            a, b = headers.get(name), theirs.get(name)
            if a is not None and b is not None:
                outcome = "resolved" if a.removeprefix("W/") == b.removeprefix("W/") else "mismatch"
                break
        merged = {**theirs, **{k: v for k, v in headers.items() if k in warc.PERMITTED}} if outcome == "resolved" else None
        out.append((rid, target[0], ts - target[2], outcome, merged))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = "a.com/hot" if rng.random() < 0.4 else f"a.com/{rng.randrange(8)}"
        headers = {k: rng.choice(["x", "W/x", "y"]) for k in ("etag", "last-modified", "warc-payload-digest", "date", "content-length") if rng.random() < 0.5}
        rows.append((
            rng.choice([i, i, 5]), url if rng.random() < 0.97 else None, rng.randrange(60) if rng.random() < 0.97 else None,
            rng.choice(["response", "revisit", "revisit", "request", None]), rng.choice([200, 200, 404, None]),
            headers if rng.random() < 0.95 else None, "clash", "clash",
        ))
    return rows


def test_against_brute_force(spark):
    for seed, n in ((1, 400), (2, 3), (3, 0)):
        rows = rows_of(seed, n)
        got = warc.resolve(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
        # Of responses that share URL, time and id any may be the target.
        assert len(got) == sum(r[3] == "revisit" for r in rows)
        plain = brute(rows)
        short = lambda r: (r[0], r[1], r[2])
        found = sorted(((r["record_id"], r["target_id"], r["age"]) for r in got), key=str)
        assert found == sorted(map(short, plain), key=str)


def test_outcomes_and_headers(spark):
    rows = [r for r in rows_of(4, 400)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]  # ids that decide ties
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted(((r["record_id"], r["target_id"], r["age"], r["outcome"], r["merged"]) for r in got), key=lambda r: str(r[:4]))
    plain = sorted(brute(rows), key=lambda r: str(r[:4]))
    assert [r[:4] for r in found] == [r[:4] for r in plain]
    assert [r[4] for r in found] == [r[4] for r in plain]
    assert {r[3] for r in found} == {"resolved", "mismatch", "unverified", "orphan"}


def test_canonical_urls(spark):
    same = ["http://www.A.com/x?b=2&a=1#f", "https://a.com:443/x?a=1&b=2&utm_source=q&ref=z", "HTTP://user:pw@a.com:80/x?a=1&&b=2"]
    other = ["http://a.com", "http://a.com/X", "a.com/x?a=1", "", " ", "http://", "#top", None]
    df = spark.createDataFrame([(u,) for u in same + other], "url string")
    found = [r[0] for r in df.select(warc.canonical_url(F.col("url"))).collect()]
    assert found == ["a.com/x?a=1&b=2"] * 3 + ["a.com/", "a.com/X", "a.com/x?a=1"] + [None] * 5


def test_empty_urls_and_long_headers(spark):
    """Captures without a URL do not resolve to each other; header values of any length are carried."""
    long = "x" * 300_000
    rows = [(1, "", 1, "response", 200, {"etag": "a"}, "", ""), (2, "", 5, "revisit", 304, {"etag": "a"}, "", "")]
    rows += [(3, "a.com/l", 1, "response", 200, {"etag": "a", "server": long}, "", ""), (4, "a.com/l", 5, "revisit", 304, {"etag": "a", "vary": long}, "", "")]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[2]["outcome"], got[2]["target_id"]) == ("orphan", None)
    assert got[4]["merged"] == {"etag": "a", "server": long, "vary": long}
