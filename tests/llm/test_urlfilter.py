"""Url filters against plain Python and SQL, and their edge cases."""

import collections
import hashlib
import math

import duckdb
import pytest

from lodestat.llm import queries, urlfilter

ODD = [None, "", "no scheme", "http://", "://EXAMPLE.Org/es/x?y#z", "https://a.b.example.org/en/1", "https://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/", "http://COM/de/", "ftp://a?b/c://d", "http://h#f/g", "http://ünï.com/de/é",
       "http://u:p@x.example.com:80/fr/1", "a://b://c/d", "http://x.net/" + "long/" * 400]


def brute(urls, order=4):
    """(host, path, rule, verdict, score) by url, without windows or levels."""
    rows, weight = {}, collections.Counter(u or "" for u in urls)
    for u in weight:
        rest = u.split("://", 1)[1] if "://" in u else ""
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rows[u] = host, path, *(max(fits)[1:] if fits else (None, None)), int(hashlib.sha256(u.encode()).hexdigest()[0] >= "8")
    grams = {m: {v: collections.defaultdict(collections.Counter) for v in ("allow", "block")} for m in urlfilter.MODELS}
    for u, (host, path, _, verdict, half) in rows.items():
        if verdict:
            s = "\x02" * order + host + path + "\x03"
            for i in range(order, len(s)):
                for k in range(order + 1):
                    for m, halves in urlfilter.MODELS.items():
                        if str(half) in halves:
                            grams[m][verdict][s[i - k : i]][s[i]] += weight[u]

    def log_ratio(u, m):
        host, path = rows[u][:2]
        s, total = "\x02" * order + host + path + "\x03", 0.0
        for i in range(order, len(s)):
            p = {}
            for v in ("allow", "block"):
                p[v] = 1 / urlfilter.ALPHABET
                for k in range(order + 1):
                    behind = grams[m][v].get(s[i - k : i])
                    if behind:
                        p[v] = (behind.get(s[i], 0) + len(behind) * p[v]) / (sum(behind.values()) + len(behind))
            total += math.log(p["allow"] / p["block"])
        return total / (len(s) - order)

    bins = collections.defaultdict(lambda: [0, 0])
    for u, row in rows.items():
        if row[3]:
            bins[math.floor(log_ratio(u, str(row[4])) * urlfilter.STEPS)][row[3] == "block"] += weight[u]
    bound = urlfilter.threshold([(k, *v) for k, v in bins.items()])
    return {u: (*r[:3], r[3] or ("allow" if log_ratio(u, "all") >= bound else "block"), log_ratio(u, "all")) for u, r in rows.items()}


@pytest.mark.parametrize("frequent", [1 << 16, 50])
def test_filter_equals_plain_python_and_sql(spark, sf_dir, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(urlfilter, "FREQUENT", frequent)
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] * 2 + ODD + ODD[:3]
    df = spark.createDataFrame([(i if i else None, u, "h", 1, "w") for i, u in enumerate(urls)], "page_id bigint, url string, host string, weight int, w string")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = brute(urls)
    got = urlfilter.judged(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()
    assert len(got) == len(urls)
    for r in got:
        w = want[urls[r.page_id or 0] or ""]
        assert (r.host, r.path, r.rule, r.verdict) == w[:4] and r.score == pytest.approx(w[4], abs=1e-6)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, con.execute(queries.oracle_sql()["op12_url_filter"]).fetchall())) == sorted(key(tuple(r)[:5]) for r in got)


def test_threshold():
    assert urlfilter.threshold([]) == 0.0 and urlfilter.threshold([(5, 3, 0)]) == 0.0
    assert urlfilter.threshold([(-10, 0, 5), (20, 7, 0)]) in (0.2, -0.09) and urlfilter.threshold([(-10, 0, 5), (3, 7, 0)]) == 0.03


def test_one_kind_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/x"), (3, None)], "page_id int, url string")
    assert sorted(tuple(r)[:5] for r in urlfilter.judged(df).select("page_id", "host", "path", "rule", "verdict").collect())[0] == (1, "a.org", "/x", "org/", "allow")
    assert urlfilter.judged(df.filter("1 = 0")).collect() == []


def test_main_path_has_no_python(spark, sf_dir):
    plan = urlfilter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
