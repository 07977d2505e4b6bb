import datetime

from tessera.llm import urls

ENTRIES = [
    ("bad.example.com", "2024-01-10", "block"), ("bad.example.com", "2024-03-01", "drop"), ("bad.example.com", "2024-05-01", "block"), ("example.com", "2024-04-01", "block"),
    ("ok.example.com", "2024-04-02", "allow"), ("site.org/a/b", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("x.org", None, "block"), ("two.org", "2024-01-01", "allow"), ("two.org", "2024-01-01", "block"),
]
CASES = [
    ("http://bad.example.com/x", "2024-01-09", None), ("http://bad.example.com/x", "2024-01-10", "bad.example.com"), ("https://WWW.bad.example.com:80/", "2024-02-29", "bad.example.com"),
    ("http://bad.example.com/x", "2024-03-01", None), ("http://bad.example.com/x", "2024-04-15", "example.com"), ("http://bad.example.com./x", "2024-06-01", "bad.example.com"),
    ("http://notbad.example.com/x", "2024-02-01", None), ("http://u:p@site.org/A/b/c?d", "2024-02-01", "site.org/a/b"), ("http://site.org/a/bc", "2024-02-01", None), ("http://m.site.org/a/b", "2024-02-01", "site.org/a/b"),
    (None, "2024-02-01", None), ("nonsense", "2024-02-01", None), ("http://two.org", "2024-02-01", "two.org"), ("http://bad.example.com/x", None, None),
]


def captures(spark):
    day = lambda d: d and datetime.date.fromisoformat(d)
    return spark.createDataFrame([(i, u, day(d), "old") for i, (u, d, _) in enumerate(CASES)], "i int, url string, fetched_on date, host string")


def lists(spark, rows=ENTRIES):
    return spark.createDataFrame(rows, "pattern string, day string, action string")


def test_entries_hold_from_their_day_to_the_next(spark, monkeypatch):
    want = {i: p and p != "ok.example.com" for i, (_, _, p) in enumerate(CASES)}
    for limit in (urls.BROADCAST_ROWS, 0):
        monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
        got = urls.judged(captures(spark), lists(spark)).collect()
        assert len(got) == len(CASES)
        assert {r["i"]: r["pattern"] for r in got} == {i: p for i, (_, _, p) in enumerate(CASES)}
        assert {r["i"]: r["blocked"] for r in got} == {i: bool(w) for i, w in want.items()}


def test_the_longest_pattern_decides(spark):
    rows = spark.createDataFrame([(datetime.date(2024, 5, 5), "http://ok.example.com/")], "fetched_on date, url string")
    got = urls.judged(rows, lists(spark)).first()
    assert got["pattern"] == "ok.example.com" and not got["blocked"]


def test_empty_lists_and_tables(spark):
    assert not any(r["blocked"] for r in urls.judged(captures(spark), lists(spark, [])).collect())
    assert urls.judged(captures(spark).limit(0), lists(spark)).count() == 0


def test_patterns_of_many_segments(spark, monkeypatch):
    entries = [("site.org/a", "2024-01-01", "block"), ("site.org/a/b/c", "2024-01-01", "allow"), ("site.org/a/b/c/d/e", "2024-01-01", "block")]
    want = {"http://site.org/a/b": True, "http://site.org/a/b/c": False, "http://m.site.org/a/b/c/d?x": False, "http://site.org/A/b/c/d/e/f": True, "http://site.org/a/b/c/d/ef": False, "http://site.org": False}
    rows = spark.createDataFrame([(u, datetime.date(2024, 2, 1)) for u in want], "url string, fetched_on date")
    for limit in (urls.BROADCAST_ROWS, 0):
        monkeypatch.setattr(urls, "BROADCAST_ROWS", limit)
        assert {r["url"]: r["blocked"] for r in urls.judged(rows, lists(spark, entries)).collect()} == want
