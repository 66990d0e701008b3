import datetime as dt
import random
from collections import defaultdict

from websift.streaming import frontier as FR

SCHEMA = "url string, html string, fetched_at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def fold(visits, interval):
    """(url, action, second) by going through all seconds one after the other."""
    events, out, queued, visited, wanted = defaultdict(set), [], set(), {}, set()
    for url, links, s in visits:
        events[s].add((0, url))
        events[s] |= {(1, x) for x in links}
    for s in range(max(events, default=-1) + 1):
        for u in sorted(wanted):
            if s == visited[u] + interval:
                wanted.discard(u)
                queued.add(u)
                out.append((u, "enqueue", s))
        for kind, u in sorted(events[s]):
            if kind == 0:
                if u in queued:
                    out.append((u, "drop", s))
                queued.discard(u)
                wanted.discard(u)
                visited[u] = s
            elif u not in queued:
                if u not in visited or s >= visited[u] + interval:
                    queued.add(u)
                    out.append((u, "enqueue", s))
                else:
                    wanted.add(u)
    return sorted(out)


def pages(spark, visits):
    rows = [(u, "<html>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</html>", START + dt.timedelta(seconds=s)) for u, links, s in visits]
    return spark.createDataFrame(rows, SCHEMA)


def make(seed=6, n=160, sites=14):
    rng = random.Random(seed)
    urls = [f"https://h{k}.example/" for k in range(sites)]
    return [(u := rng.choice(urls), [x for x in rng.sample(urls, 3) if x != u], 7 * k) for k in range(n)]


def run(spark, tmp_path, deliveries, interval):
    src, root, out = str(tmp_path / "in"), str(tmp_path / "state"), None
    for d in deliveries:
        df = pages(spark, d)
        df.write.mode("append").parquet(src)
        out = FR.run_frontier(spark, src, df.schema, root, interval)
    start = int(START.timestamp() * 1000)
    return out, sorted((r.url, r.action, (r.at_ms - start) // 1000) for r in out.collect())


def test_frontier_equals_a_fold_over_time(spark, tmp_path):
    """Found URLs are queued once, fetched ones dropped, nothing is queued before its interval; deliveries don't matter."""
    visits = make()
    want = fold(visits, 100)
    out, got = run(spark, tmp_path / "a", [visits[:50], visits[50:51], visits[51:120], visits[120:]], 100)
    assert got == want and any(a == "enqueue" and s % 7 for _, a, s in want)  # some come from timers
    assert run(spark, tmp_path / "b", [visits], 100)[1] == want
    waiting = {r.url for r in FR.urls(out).collect() if r.queued}
    assert waiting == {u for u in {x[0] for x in want} if [a for x, a, _ in want if x == u].count("enqueue") > [a for x, a, _ in want if x == u].count("drop")}


def test_links_that_are_not_found(spark, tmp_path):
    visits = [("https://a.example/x", ["/rel", "mailto:x@y", "https://a.example/y", "ftp://b.example/", "HTTPS://B.example/", "https://b.example/p",
                                       "https://b.example/p"], 1), (None, ["https://c.example/"], 2), ("https://b.example/p", [], 3)]
    _, got = run(spark, tmp_path, [visits], 10)
    assert got == [("HTTPS://B.example/", "enqueue", 1), ("https://b.example/p", "drop", 3), ("https://b.example/p", "enqueue", 1)]
