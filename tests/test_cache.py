"""The cache: hits, misses, stale answers when the source fails, and its status."""

from datetime import datetime, timedelta, timezone

from skerry.sources.cache import Cache

NOW = datetime(2026, 6, 1, tzinfo=timezone.utc)


def answer(source, path, params):
    if path == "down":
        raise ConnectionError("no route")
    return f"{source}:{path}:{params.get('q')}"


def working(source, path, params):
    return "again"


def test_cache(spark, tmp_path):
    store = Cache(spark, str(tmp_path / "cache"), {"slow": 30.0}, 7.0)
    schema = "source string, path string, params map<string,string>"
    asked = spark.createDataFrame([("fast", "a", {"q": "1", "api_key": "x"}), ("fast", "a", {"q": "1", "api_key": "y"}), ("slow", "a", {"q": "1"}), ("fast", "down", None)], schema)
    states = lambda rows: sorted((r["source"], r["path"], r["state"], r["body"]) for r in rows.collect())
    assert states(store.fetch(asked, answer, NOW)) == [("fast", "a", "fetched", "fast:a:1"), ("fast", "a", "fetched", "fast:a:1"), ("fast", "down", "failed", None), ("slow", "a", "fetched", "slow:a:1")]
    assert store.rows().count() == 2
    # within the lifetime nothing is asked but what failed
    later = NOW + timedelta(days=6)
    assert states(store.fetch(asked, working, later)) == [("fast", "a", "hit", "fast:a:1"), ("fast", "a", "hit", "fast:a:1"), ("fast", "down", "fetched", "again"), ("slow", "a", "hit", "slow:a:1")]
    # expired answers are served when the source fails
    last = NOW + timedelta(days=20)
    got = store.fetch(asked, answer, last).collect()
    assert sorted((r["source"], r["path"], r["state"], r["body"]) for r in got) == [("fast", "a", "fetched", "fast:a:1"), ("fast", "a", "fetched", "fast:a:1"), ("fast", "down", "stale", "again"), ("slow", "a", "hit", "slow:a:1")]
    assert {r["error"] for r in got} == {None, "ConnectionError: no route"}
    assert {tuple(r)[:5] for r in store.status(last).collect()} == {("fast", 2, 1, 1, 3), ("slow", 1, 1, 0, 1)}
    assert store.fetch(asked.where("false"), answer, NOW).count() == 0
