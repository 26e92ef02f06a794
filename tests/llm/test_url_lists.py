"""Temporal list join against a plain as-of lookup."""

import datetime as dt
import random

import duckdb
from callscope.llm import registry, url_inputs, url_lists

DAY = dt.datetime(2024, 1, 1)
at = lambda d: None if d is None else DAY + dt.timedelta(days=d)


def host(url):
    return url.split("://")[1].split("/")[0].split("?")[0].lower() if "://" in url else None


def plain(captures, changes):
    known = {}
    for kind, entry, action, day in changes:
        if entry is not None and day is not None and action in ("allow", "block", "remove") and kind in url_lists.KINDS:
            known.setdefault((kind, entry), {}).setdefault(day, []).append(action)
    for name, url, day in captures:
        best = None
        if url is not None and day is not None:
            h = host(url)
            keys = [("url", url.split("#")[0])] + ([("host", h)] + [("domain", ".".join(h.split(".")[i:])) for i in range(h.count(".") + 1)] if h else [])
            for key in keys:
                days = [d for d in known.get(key, ()) if d <= day]
                if days and (action := min(known[key][max(days)])) != "remove":
                    best = max(best or (0,), (url_lists.KINDS[key[0]], len(key[1]), action, *key, at(max(days))))
        yield (name, url, at(day), best[2], best[3], best[4], best[5]) if best else (name, url, at(day), "allow", None, None, None)


def check(spark, captures, changes):
    caps = spark.createDataFrame([(n, u, at(d), "x") for n, u, d in captures], "page_id long, url string, fetched_at timestamp, entry string")
    hist = spark.createDataFrame([(k, e, a, at(d), 1) for k, e, a, d in changes], "kind string, entry string, action string, changed_at timestamp, page_id int")
    got = [tuple(r) for r in url_lists.judge(caps, hist).collect()]
    assert sorted(got, key=str) == sorted(plain(captures, changes), key=str)


def test_edge_rows(spark):
    captures = [(1, "http://a.b.org/x?q#f", 10), (1, "http://a.b.org/x?q#f", 10), (2, "http://a.b.org/x?q#f", 9), (3, None, 5), (4, "http://b.org", None), (5, "", 5), (6, "no url", 400),
                (None, "https://Deep.a.b.org/", 700), (7, "http://ab.org/", 20), (8, "http://b.org/" + "p" * 100_000, 21), (9, "http://a.b.org/x?q", -400)]
    changes = [("domain", "b.org", "block", 0), ("domain", "b.org", "remove", 9), ("domain", "b.org", "block", 10), ("domain", "b.org", "allow", 10), ("domain", "a.b.org", "block", 100),
               ("host", "a.b.org", "allow", 10), ("url", "http://a.b.org/x?q", "block", -500), ("url", "http://a.b.org/x?q", "remove", -300), ("host", None, "block", 1), ("host", "b.org", None, 1),
               ("host", "b.org", "block", None), (None, "b.org", "block", 1), ("host", "b.org", "unknown", 1), ("domain", "b.org", "block", 0), ("domain", "org", "block", 20), ("odd", "b.org", "block", 1)]
    check(spark, captures, changes)
    check(spark, captures, [])
    assert url_lists.judge(spark.createDataFrame([], "page_id long, url string, fetched_at timestamp"), spark.createDataFrame([("host", "h", "block", DAY)], "kind string, entry string, action string, changed_at timestamp")).count() == 0


def test_many_changes(spark):
    rand = random.Random(6)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.com", "q.y.com"]
    captures = [(i, f"http://{rand.choice(hosts)}/{rand.randrange(3)}", rand.randrange(900)) for i in range(300)]
    changes = [(k, rand.choice(["x.com", "y.com", "a.x.com", "com"]) if k != "url" else f"http://{rand.choice(hosts)}/1", rand.choice(["block", "allow", "remove"]), rand.randrange(900)) for k in rand.choices(["url", "host", "domain"], k=200)]
    check(spark, captures, changes)


def test_list_stays_off_the_driver(spark, monkeypatch):
    """20,000 entries in two years of buckets: neither their copies nor a table of their keys go by the driver."""
    captures = [(i, f"http://h{i % 50}.x{i % 7}.com/{i}", i * 7 % 720) for i in range(300)]
    changes = [("url", f"http://h{i % 50}.x{i % 7}.com/{i}", "block", i % 30) for i in range(20_000)] + [("domain", "x3.com", "allow", 5), ("host", "h8.x1.com", "block", 400)]
    sent = []
    frame, collect = type(spark.range(0)), type(spark.range(0)).collect
    monkeypatch.setattr(frame, "collect", lambda self: (sent.append(len(str(got := collect(self)))), got)[1])
    # what is small once it is counted (adaptive) may be broadcast; a page of it alone is up to 64 MB
    limits = {"spark.sql.maxBroadcastTableSize": 100 << 20, "spark.sql.autoBroadcastJoinThreshold": 10 << 20, "spark.sql.adaptive.autoBroadcastJoinThreshold": 1 << 18}
    kept = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        check(spark, captures, changes)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the time range; the last is the result
    assert sum(sent[:-1]) < 1000


def test_hosts_in_many_months(spark):
    """Hosts of many labels that share domains, captured again and again, some twice at one time."""
    rand = random.Random(9)
    hosts = [".".join(rand.choices("abc", k=rand.randrange(1, 9))) for _ in range(40)]
    captures = [(i, f"https://{rand.choice(hosts)}/{rand.randrange(2)}", rand.randrange(-200, 500)) for i in range(400)]
    captures += captures[:60]
    names = hosts + [h.split(".", 1)[-1] for h in hosts] + ["a", "b.c"]
    changes = [(rand.choice(["host", "domain"]), rand.choice(names), rand.choice(["block", "allow", "remove"]), rand.randrange(-300, 500)) for _ in range(300)]
    changes += [("url", f"https://{h}/1", rand.choice(["block", "remove"]), rand.randrange(-300, 500)) for h in hosts]
    check(spark, captures, changes)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet'")
    assert sorted(map(str, (tuple(r) for r in registry.op3_url_lists(spark, path).collect()))) == sorted(map(str, con.sql(url_inputs.ORACLE).fetchall()))
