import random
from collections import defaultdict

import pytest
from oracle import compare
from pyspark.sql import functions as F

from sparsewright.llm import queries
from sparsewright.llm.exact_dedup import exact_groups, hot_digests
from sparsewright.llm.mixing import mix, mixed_rows
from sparsewright.llm.url_filter import RULES, cascade, in_cascade, judge_urls

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF) > 0


def test_exact_groups_edge_cases(spark):
    rows = [(None, "A"), (3, "a"), (1, "É"), (2, "é"), (4, None), (5, ""), (6, "b"), (6, "B"), (None, "only")] + [(k, "HOT") for k in range(100, 400)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, digest string")
    got = defaultdict(set)
    for r in exact_groups(docs, counters=8).collect():
        got[r["doc_id"]].add((r["keep_id"], r["group_size"], r["kept"]))
    assert got[None] == {(3, 2, False), (None, 1, True)} and got[3] == {(3, 2, True)}
    assert got[1] == {(1, 1, True)} and got[2] == {(2, 1, True)} and got[4] == {(5, 2, False)} and got[6] == {(6, 2, True)}
    assert got[100] == {(399, 300, False)} and got[399] == {(399, 300, True)}
    assert exact_groups(docs.filter(F.lit(False))).count() == 0


def test_hot_digests_are_found_and_few(spark):
    r = random.Random(1)
    rows = [(k, bytes([r.randrange(4)]) if k % 3 else r.randbytes(8)) for k in range(3000)]
    found = {bytes(x["digest"]): x["size"] for x in hot_digests(spark.createDataFrame(rows, "id long, digest binary").repartition(9), 16).collect()}
    counts = defaultdict(int)
    for _, d in rows:
        counts[d] += 1
    assert found == {d: n for d, n in counts.items() if n * 16 >= len(rows)}


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), k == "block", h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def test_urls_by_brute_force(spark):
    r = random.Random(8)
    urls = [None, "", "no scheme/en/7", "http://", "http://com/en/", "HTTP://A.COM/en/", "x://y://com/en/", "http://example.com?/en/7", "http://Example.COM/en/7#a", "http://xexample.com/en/7", "http://com", "http://.com/en/", "http://a.com/EN/", "http://com/en/\n7"]
    for _ in range(400):
        urls.append(f"http://{r.choice(['', 'a.', 'www.b.'])}{r.choice(['example.', 'ample.', ''])}{r.choice(['com', 'net', 'org', 'de'])}/{r.choice(['en', 'de', 'es'])}/{r.randrange(100)}{r.choice(['', '/x', '?q', '#f'])}")
    docs = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    many = [*RULES, ("block", "www.b.example.com", "/"), ("allow", "de", "/d"), ("block", "de", "/d"), *[(r.choice(["allow", "block"]), f"{r.choice('abc')}.ample.{r.choice(['com', 'net'])}", f"/e{r.choice('ns')}/{r.randrange(100)}") for _ in range(60)]]
    for rules in (RULES, many, ()):
        for x in judge_urls(docs, rules).collect():
            assert (x["host"], x["path"], x["rule"], x["verdict"]) == _judge(urls[x["page_id"]], rules), urls[x["page_id"]]
    assert judge_urls(docs.filter(F.lit(False))).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = [f"k{k}" for k in range(0, 3000, 7)]
    levels = cascade(universe, listed)
    assert len(levels) > 2 and sum(x.size for x in levels) < 12 * len(listed)
    assert {r["key"] for r in universe.filter(in_cascade(levels)(F.col("key"))).collect()} == set(listed)


def test_mix_reaches_targets(spark):
    r = random.Random(6)
    sizes = {"a": 900, "b": 40, "c": 60, None: 300}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * r.randrange(0, 30)) or None, s, 1))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(7)
    got = mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs.repartition(2)).collect()))
    total = sum(x["size"] for x in got)
    by = defaultdict(list)
    for x in got:
        by[rows[x["doc_id"]][2]].append(x)
        assert x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"]
    held = {s: sum(x["size"] for x in v) for s, v in by.items()}
    goal, open_ = {}, dict(zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True))
    left = total
    while True:  # clamp and share again until none is above
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * held[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * held[s]
        left = total - sum(goal.values())
        open_ = {s: w for s, w in open_.items() if s not in goal}
    goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s, v in by.items():
        assert all(x["source_size"] == held[s] and x["target"] == pytest.approx(goal[s]) for x in v)
        assert abs(sum(x["taken"] for x in v) - goal[s]) <= 15.5
    assert mixed_rows(docs).count() == sum(x["copies"] for x in got)


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "s"), (2, " \t", "s"), (2, "a b", "t"), (2, "a b", "t")], "doc_id long, text string, source string")
    assert sorted((r["size"], r["copies"]) for r in mix(docs).collect())[:3] == [(0, 0)] * 3
    assert mix(docs.filter(F.lit(False))).count() == 0 and mix(docs.limit(1)).count() == 1
