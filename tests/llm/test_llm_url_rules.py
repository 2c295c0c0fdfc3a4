from __future__ import annotations

import re
from itertools import combinations

from compare import duck
from llm_cases import LABELS, PAGES, clashing
from meterline.llm import url_rules as U
from pyspark.sql import functions as F

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def words(url):
    host, path = parts(url)
    query = re.search(r"\?([^#]*)", url)
    run = lambda s: re.findall(r"[^\W\d_]+", s.lower())
    return {f"{m}:{w}" for m, s in (("h", host), ("p", path), ("q", query[1] if query else "")) for w in run(s)}


def labelled():
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        host = ("casino" if bad else "news") + f"{i % 7}.example.{('com', 'net')[i % 2]}"
        rows.append((f"http://{host}/{('win', 'read', 'x')[i % 5 % 3]}/{i}?a={i}", "block" if bad and i % 12 else "allow"))
    return rows


def brute_rules(rows, least, confidence, lift):
    rows = sorted(set(rows))
    sets = [(words(u), v) for u, v in rows]
    n, base = len(rows), {v: sum(x == v for _, x in sets) / len(rows) for v in ("allow", "block")}
    found = {}
    every = sorted({t for s, _ in sets for t in s})
    for size in range(1, 7):
        for needs in combinations(every, size):
            have = [v for s, v in sets if s.issuperset(needs)]
            for v in ("allow", "block"):
                hits = have.count(v)
                if hits >= least and hits / len(have) >= confidence and hits / len(have) / base[v] >= lift:
                    found[needs, v] = (hits / len(have), hits / n)
    return {
        (needs, v): c
        for (needs, v), c in found.items()
        if not any((needs[:i] + needs[i + 1 :], v) in found and found[needs[:i] + needs[i + 1 :], v][0] >= c[0] for i in range(len(needs)))
    }


def test_rules_and_matches_equal_brute_force(spark):
    rows = labelled()
    known = spark.createDataFrame(rows + rows[:9], "url string, label string")
    index = U.mine(known, min_count=20).collect()
    want = brute_rules(rows, 20, U.MIN_CONFIDENCE, U.MIN_LIFT)
    got = {(tuple(r.needs), r.verdict): (r.confidence, r.support) for r in index}
    assert got.keys() == want.keys() and got
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    urls = [u for u, _ in rows] + ["http://casino.org/", "http://none.test/abc"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    fired = {r.url: r.mined for r in U.matches(pages, U.mine(known, min_count=20)).collect()}
    for u in urls:
        fit = [(*want[k], len(k[0]), " ".join(k[0]), k[1]) for k in want if words(u).issuperset(k[0])]
        assert fired.get(u) == (max(fit)[-1] if fit else None)


def test_long_urls_are_mined_whole(spark):
    """Thirty tokens a URL that always come together, and one that tells, far behind the others."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = "/".join(f"same{a}" for a in letters)
    rows = [(f"http://h.test/{common}/n{letters[i % 26]}/{'spam' if i % 2 else 'fine'}/{i}", "block" if i % 2 and i % 10 != 1 else "allow") for i in range(200)]
    index = U.mine(spark.createDataFrame(rows, "url string, label string"), min_count=20).collect()
    sure = {(tuple(r.needs), r.verdict): round(r.confidence, 6) for r in index if len(r.needs) == 1}
    assert sure[("p:spam",), "block"] == 0.8 and sure[("p:fine",), "allow"] == 1.0
    assert not any(t.startswith("p:same") for needs, _ in sure for t in needs)  # no rule: no lift


def test_tokens_that_come_together_each_stand_for_their_rule(spark):
    rows = [(f"http://{'x.bad.twin' if i % 2 else 'y.good'}.test/{i}", "block" if i % 2 else "allow") for i in range(100)]
    known = spark.createDataFrame(rows, "url string, label string")
    index = U.mine(known, min_count=20)
    want = brute_rules(rows, 20, U.MIN_CONFIDENCE, U.MIN_LIFT)
    got = {(tuple(r.needs), r.verdict): (r.confidence, r.support) for r in index.collect()}
    assert got == want and len([k for k in got if k[1] == "block"]) == 3
    pages = spark.createDataFrame([("http://only.twin.test/",), ("http://none.test/",)], "url string")
    assert [tuple(r) for r in U.matches(pages, index).collect()] == [("http://only.twin.test/", "block")]


ODD = [
    (1, None, ""),
    (2, "no scheme/org", ""),
    (3, "HTTP://WWW.Example.ORG/es/1?x#y", ""),
    (4, "http://example.org", ""),
    (5, "http://xexample.org/en/12", ""),
    (6, "http://a.com/de/", None),
    (6, "http://a.com/de/", None),
    (None, "x://y://z/fr/\nq", ""),
    (7, "", ""),
    (8, "http://" + "a" * 100_000 + ".com/fr/" + "b/" * 50_000, ""),
]


def test_odd_urls(spark):
    pages = clashing(spark.createDataFrame(ODD, PAGES))
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 0, 1), (2, None, None)], LABELS)):
        got = U.judge(pages, labels).collect()
        want = []
        for page, url, _ in ODD:
            host, path = parts(url)
            name, verdict = rule(host, path)
            want.append((page, host, path, name, verdict or "allow"))
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert U.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).count() == 0


def test_given_pages_and_native_plan(spark, small):
    got = U.query(spark, small)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = duck(small).execute("select page_id, url from pages").fetchall()
    want = [(p, *parts(u), rule(*parts(u))[0]) for p, u in rows]
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got.collect()) == sorted(want, key=lambda r: r[0])
    assert got.filter("rule is not null and verdict <> if(rule in ('org/', 'com/fr/'), 'allow', 'block')").count() == 0
