import datetime as dt

from terminus.llm import url_filters as uf

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute(captures, entries):
    def keys(url):
        head, _, rest = (url or "").partition("://")
        if not rest or not head.isalpha():
            return []
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = rest[:cut].rpartition("@")[2].partition(":")[0].lower()
        path = rest[cut:].partition("?")[0].partition("#")[0] if rest[cut:cut + 1] == "/" else ""
        seg, labels = [s for s in path.split("/") if s], host.split(".")
        if not host:
            return []
        return ([("host", host, 1000)] + [("domain", ".".join(labels[i:]), len(labels) - i) for i in range(1, len(labels) - 1)]
                + [("domain", host, len(labels))] + [("path", "/".join([host, *seg[:i]]), 1000 + i) for i in range(1, len(seg) + 1)])

    out = []
    for page, url, day in captures:
        hits = []
        for kind, key, spec in keys(url) if day else []:
            for name in {e[0] for e in entries if e[2:4] == (kind, key)}:
                log = sorted((e[5], e[6], e[4], e[1]) for e in entries if (e[0], e[2], e[3]) == (name, kind, key) and e[5])
                past = [e for e in log if e[0] <= day]
                if past and past[-1][2] == "add":
                    hits.append((spec, past[-1][3] == "allow", name, past[-1][3], kind, key, past[-1][0]))
        best = max(hits, default=None)
        out.append((page, url, day, *((best[3], best[2], best[4], best[5], best[6]) if best else ("none", None, None, None, None))))
    return sorted(out, key=str)


def test_against_brute_force_and_edges(spark):
    urls = ["http://a.b.com/x/y?q=/z", "https://u:p@A.b.com:80/x", "http://b.com", "http://c.org/x//y/", "mailto:x", "", None,
            "http://", "http://b.com/" + "s/" * 300, "ftp://a.b.com#x/y"]
    captures = [(i * 100 + d, u, D(d)) for i, u in enumerate(urls) for d in (0, 3, 4, 31, 70, 500)]
    captures += [(None, urls[0], D(3)), (7, urls[0], None), (8, urls[0], D(70)), (8, urls[0], D(70))]
    entries = [("L", "block", "host", "a.b.com", "add", D(3), 1), ("L", "block", "host", "a.b.com", "remove", D(31), 2),
               ("L", "block", "host", "a.b.com", "add", D(31), 3), ("L", "block", "host", "a.b.com", "remove", D(400), 4),
               ("T", "allow", "domain", "b.com", "add", D(0), 1), ("T", "allow", "domain", "b.com", "remove", D(60), 1),
               ("S", "block", "path", "a.b.com/x", "add", D(4), 1), ("R", "allow", "path", "a.b.com/x", "add", D(70), 1),
               ("S", "block", "path", "b.com/" + "/".join("s" * 299), "add", D(4), 1), ("S", "block", "host", None, "add", D(0), 1),
               ("S", "block", "host", "c.org", "add", None, 1), ("S", "block", "path", "c.org/x/y", "add", D(500), 1)]
    c = spark.createDataFrame([(*r, 1) for r in captures], "page_id long, url string, fetched date, list int")
    e = spark.createDataFrame(entries, "list string, verdict string, kind string, key string, action string, effective date, seq int")
    got = sorted(((r.page_id, r.url, r.fetched, r.verdict, r.list, r.kind, r.key, r.valid_from) for r in uf.evaluate(c, e).collect()), key=str)
    assert got == brute(captures, entries)
    assert uf.evaluate(c.limit(0), e).count() == 0
    assert {r.verdict for r in uf.evaluate(c, e.limit(0)).collect()} == {"none"}


def test_native_plan(spark):
    plan = uf.evaluate(uf.page_captures(spark, "/root/testdata/sf0.001"), uf.page_lists(spark, "/root/testdata/sf0.001"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text
