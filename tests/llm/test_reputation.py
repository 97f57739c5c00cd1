import re

import duckdb
import pandas as pd

from vitrine.llm import queries, reputation

URLS = [
    "http://example.com/en/x?a#b", "https://WWW.Example.com/en/y", "https://a.b.net/es/", "https://a.b.net/esx", "http://net/fr/1",
    "no scheme", "", None, "://", "http://host", "http://host?q/x", "http://Host#f", "x://y://z/p", "http://example.com", "http://com/",
    "http://notexample.com/en/", "http://x.example.com:80/en/", "a\n://b.com/\nc?d", "http://é.COM/É",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lowered, re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [r for r in queries.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(1, URLS[1]), (None, URLS[0])], "page_id long, url string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = sorted((tuple(r) for r in reputation.judge(pages.selectExpr("*", "1 as rule", "2 as host"), outcomes, queries.RULES).collect()), key=str)
    want = []
    for i, url in [*enumerate(URLS), (1, URLS[1]), (None, URLS[0])]:
        host, path = parts(url)
        own = rule(host, path)
        want.append((i, host, path, own and own[1] + own[2], own[0] if own else "allow"))
    assert got == sorted(want, key=str)


def test_evidence_is_shrunk_towards_the_domain(spark):
    rows = [("spam.bad.org", 1)] * 60 + [("also.bad.org", 1)] * 40 + [("new.bad.org", 1)] * 2
    rows += [("a.good.org", 0)] * 80 + [("b.good.org", 0)] * 50 + [("one.good.org", 1)] + [("x.com", None)] * 3
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(["spam.bad.org", "new.bad.org", "a.good.org", "one.good.org", "unseen.org", "x.com"])], "page_id long, url string")
    got = [r["verdict"] for r in reputation.judge(pages, outcomes, []).orderBy("page_id").collect()]
    assert got == ["block", "block", "allow", "allow", "allow", "allow"]


def test_empty_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([], "host string, bad int"), queries.RULES).count() == 0


def test_hosts_without_outcomes_are_judged_by_what_is_above(spark):
    rows = [(f"h{k}.bad.org", 1) for k in range(4) for _ in range(200)] + [(f"h{k}.good.org", 0) for k in range(4) for _ in range(200)]
    rows += [(f"a.d{k}.evil", 1) for k in range(6) for _ in range(200)] + [(f"a.d{k}.com", 0) for k in range(6) for _ in range(200)]
    hosts = ["h0.bad.org", "unseen.bad.org", "unseen.good.org", "x.unseen.evil", "x.unseen.com", "x.unseen.zz", ""]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)] + [(9, None)], "page_id long, url string")
    got = [r["verdict"] for r in reputation.judge(pages, outcomes, []).orderBy("page_id").collect()]
    assert got == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow"]


def test_sql_judges_hosts_without_outcomes_too(spark, tmp_path):
    urls = [f"https://h{k % 6}.bad.test/a" for k in range(60)] + [f"https://h{k % 6}.good.org/a" for k in range(60)]
    labelled = len(urls)
    urls += ["https://new.bad.test/a", "https://new.good.org/", "https://new.other.test/", "https://new.elsewhere.example/", "no address", None]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    labels = pd.DataFrame({"doc_id": range(labelled), "quality": [0 if ".bad." in u else 1 for u in urls[:labelled]]})
    pages.to_parquet(tmp_path / "pages.parquet")
    labels.to_parquet(tmp_path / "labels.parquet")
    got = sorted(tuple(r) for r in queries.op6_host_reputation(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.register("pages", pages)
        db.register("labels", labels)
        want = sorted(db.execute("SELECT page_id, host, path, rule, verdict FROM (" + queries.oracle_sql()["op6_host_reputation"] + ")").fetchall())
    assert got == want
    verdicts = {r[1]: r[4] for r in got}
    assert verdicts["new.bad.test"] == "block" and verdicts["new.good.org"] == "allow"
