import datetime as dt
import random

from millrace.llm import url_filter

DAY = dt.date(2024, 1, 1)


def brute(captures, entries):
    """By replay of every entry up to the capture's time."""
    out = []
    for key, url, at in captures:
        m = __import__("re").match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
        host = (m[1].lower() if m else "") or None
        labels = host.split(".") if host else []
        names = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))] if host else []
        active = []
        for name in names:
            for which in {e[0] for e in entries if e[0]}:
                past = sorted({(e[3], e[2]) for e in entries if None not in e and e[0] == which and e[1].lower() == name and at and e[3] <= at})
                if past and past[-1][1] == "add":
                    active.append((which, name, past[-1][0]))
        out.append((key, at, host, len(active), ",".join(sorted({a[0] for a in active})), max((a[1] for a in active), key=lambda d: (len(d), d), default=None), min((a[2] for a in active), default=None)))
    return sorted(map(repr, out))


def test_against_replay(spark):
    rng = random.Random(3)
    day = lambda: DAY + dt.timedelta(rng.randint(-100, 400))
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "localhost", "sub.b.org"]
    entries = [(rng.choice(["ads", "adult"]), rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts), rng.choice(["add", "remove"]), day()) for _ in range(60)]
    entries += entries[:5] + [(None, "a.com", "add", DAY), ("ads", None, "add", DAY), ("ads", "a.com", "add", None), ("ads", "a.com", None, DAY)]
    captures = [(i, f"HTTP://user@{rng.choice(hosts)}:80/p?q=http://b.org/", day()) for i in range(120)]
    captures += [(500, None, DAY), (501, "", DAY), (502, "no url", DAY), (503, "http://a.com", None), (None, "http://a.com/", DAY), (1, "http://A.com#x", DAY), (504, "http:///path", DAY)]
    rows = spark.createDataFrame([(*c, "x", 1) for c in captures], "page_id long, url string, fetched_at date, list string, row int")
    dated = spark.createDataFrame(entries, "list string, domain string, action string, at date")
    got = url_filter.listed(rows, dated, bucket_days=9)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(captures, entries)


def test_dates_far_off(spark):
    """They cost no more rows than the captures' own spans."""
    far, old = dt.date(9999, 12, 31), dt.date(1, 1, 1)
    captures = [(0, "http://a.com", far), (1, "http://a.com", old), (2, "http://b.org", DAY)]
    entries = [("ads", h, "add", old + dt.timedelta(i)) for h in ("a.com", "b.org") for i in range(0, 300, 2)] + [("adult", "b.org", "add", DAY), ("adult", "b.org", "remove", far)]
    rows, dated = spark.createDataFrame(captures, "page_id long, url string, fetched_at date"), spark.createDataFrame(entries, "list string, domain string, action string, at date")
    found = url_filter.listed(rows, dated)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(captures, entries)
    assert "sequence(from" not in found._jdf.queryExecution().toString()


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame([("ads", "a.com", "add", DAY)], "list string, domain string, action string, at date")
    assert url_filter.listed(captures.limit(0), entries).count() == 0
    assert [r["n_active"] for r in url_filter.listed(captures, entries.limit(0)).collect()] == [0]
