from pyspark.sql import functions as F

from bytequarry.llm import warc
from tests.compare import assert_same, connect

RECORDS = "record_id long, url string, time long, kind string, digest string, headers map<string,string>, k long, o string, carried string, status string"


def records(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], RECORDS)


def test_equals_sql(spark, sf_dir):
    assert_same(warc.page_revisits(spark, sf_dir).toPandas(), connect(sf_dir).execute(warc.REVISIT_SQL).df())


def test_canonical_urls(spark):
    pairs = {
        "HTTP://www.A.example:80/x/?utm_source=f#top": "a.example/x",
        "https://a.example/x?page=2&ref=q": "a.example/x?page=2",
        "https://a.example/x?ref=q&page=2": "a.example/x?page=2",
        "https://u:p@a.example/": "a.example",
        "https://a.example/Path": "a.example/Path",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in pairs], "u string")
    assert {r.u: r.c for r in rows.select("u", warc.canonical_url(F.col("u")).alias("c")).collect()} == pairs


def brute(rows):
    out = {}
    url = lambda u: u.split("//", 1)[1].rstrip("/")
    for r in rows:
        if r[3] != "revisit" or r[1] is None or r[2] is None:
            continue
        old = [q for q in rows if q[3] == "response" and q[1] is not None and q[2] is not None and url(q[1]) == url(r[1]) and q[2] < r[2]]
        out[r[0]] = max(((q[2], q[0]) for q in old), default=None)
    return out


def test_latest_earlier_response_and_headers(spark):
    import random

    rng = random.Random(1)
    rows = [(1, "http://a/x", 10, "response", "d1", {"etag": '"1"', "content-type": "t", "date": "1", "vary": "v"}), (2, "https://a/x/", 10, "revisit", None, {"etag": '"1"'}), (3, "http://a/x", 12, "revisit", None, {"etag": 'W/"1"', "content-type": "no", "date": "3"})]
    rows += [(4, "http://a/x", 13, "revisit", None, {"etag": '"2"'}), (5, "http://a/x", 14, "revisit", None, None), (6, None, 5, "revisit", None, None), (7, "http://a/x", None, "revisit", None, {}), (8, "http://a/x", 15, "other", None, {})]
    rows += [(100 + k, f"http://h/{rng.choice('pppq')}", rng.randint(0, 60), rng.choice(["response", "revisit"]), "d", {"last-modified": rng.choice("ab")}) for k in range(200)]
    rows += [rows[-1]]
    got = warc.resolve(records(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.kind == "revisit":
            best = want.get(r.record_id)
            assert (r.refers_time, r.refers_to) == (best or (None, None))
    by = {r.record_id: r for r in got}
    assert [by[k].status for k in (1, 2, 3, 4, 5, 6, 7, 8)] == ["response", "no_original", "resolved", "mismatch", "unverified", "no_original", "no_original", None]
    assert by[3].merged_headers == {"etag": 'W/"1"', "content-type": "t", "date": "3", "vary": "v"}
    assert by[5].merged_headers == {"etag": '"1"', "content-type": "t", "date": "1", "vary": "v"}
    assert by[4].merged_headers is None


def test_empty(spark):
    assert warc.resolve(records(spark, [])).count() == 0
