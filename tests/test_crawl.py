"""The crawl against a queue."""

import random

from verdigris.operators import html


def queue(starts, there, links, most, depth, per_page=10, visited=()):
    todo, at, out = list(starts), dict.fromkeys(starts, 0), []
    done = set(visited)
    while todo and len(out) < most:
        url = todo.pop(0)
        if url in done or url not in there:
            continue
        done.add(url)
        out.append((url, at[url], len(out) + 1))
        if at[url] < depth:
            for link in links.get(url, [])[:per_page]:
                if link not in at:
                    at[link] = at[url] + 1
                    todo.append(link)
    return out


def graph(r, n):
    urls = [f"s{i}" for i in range(n)]
    return urls, {u for u in urls if r.random() < 0.8}, {u: r.sample(urls, r.randint(0, 14)) for u in urls}


def frames(spark, starts, there, links, **more):
    return (
        spark.createDataFrame([(*more.values(), u, i) for i, u in enumerate(starts)], ", ".join([*(f"{k} string" for k in more), "url string", "rank int"])),
        spark.createDataFrame([(u,) for u in there], "url string"),
        spark.createDataFrame([(u, x, i) for u, ls in links.items() for i, x in enumerate(ls)], "url string, link string, place int"),
    )


def test_against_a_queue(spark):
    r = random.Random(1)
    for most, depth, n in ((5, 2, 40), (30, 3, 60), (200, 1, 40), (9, 0, 40)):
        urls, there, links = graph(r, n)
        starts = r.sample(urls, 15)
        visited = r.sample(urls, 3)
        got = html.crawl(*frames(spark, starts, there, links), most, depth, visited=spark.createDataFrame([(u,) for u in visited], "url string"))
        assert [(x["url"], x["depth"], x["rank"]) for x in got.orderBy("rank").collect()] == queue(starts, there, links, most, depth, visited=visited)


def test_twelve_starts_in_their_order(spark):
    starts = [f"s{i}" for i in range(12)]
    got = html.crawl(*frames(spark, starts, set(starts), {}), 5)
    assert [x["url"] for x in got.orderBy("rank").collect()] == ["s0", "s1", "s2", "s3", "s4"]


def test_crawls_side_by_side(spark):
    r = random.Random(2)
    urls, there, links = graph(r, 50)
    each = {name: (r.sample(urls, k), most) for name, k, most in (("a", 12, 7), ("b", 3, 20), ("c", 1, 2), ("none", 2, 0))}
    starts = spark.createDataFrame([(name, u, i, most) for name, (s, most) in each.items() for i, u in enumerate(s)], "name string, url string, rank int, most int")
    _, pages, edges = frames(spark, ["x"], there, links)
    got = html.crawl(starts, pages, edges, "most", 2, by=("name",)).collect()
    for name, (s, most) in each.items():
        assert sorted((x["rank"], x["url"], x["depth"]) for x in got if x["name"] == name) == sorted((k, u, d) for u, d, k in queue(s, there, links, most, 2))


def test_no_starts(spark):
    starts, pages, edges = frames(spark, ["x"], {"x"}, {"x": ["x"]})
    assert html.crawl(starts.limit(0), pages, edges, 5).count() == 0
    assert html.crawl(starts, pages, edges, 0).count() == 0
