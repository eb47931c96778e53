import random

from spanloom.llm import url_filters as U


def brute(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER)), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1]) or not r[1]) and host and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_sweep_equals_brute_force(spark):
    rng = random.Random(7)
    rules = U.RULES + [("block", "a.com", "/x"), ("allow", "b.a.com", "/x/y"), ("block", "a.b.a.com", ""), ("block", "co", "/"), ("allow", "com.net", "/")]
    labels = ["a", "b", "com", "net", "www", "example", "co", "", "é"]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/?q#f", "x://com", "x://com/", "x://COM:80/", "a://b.net/es/://c", "http://net\n/fr/", "://com/ß"]
    for _ in range(3000):
        urls.append("http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/x", "/x/y", "/x?y", "#/en/"]))
    urls += ["http://hot.example.com/en/"] * 500
    urls.append("http://long.example.com/en/" + "x" * 300_000)
    rules += [("block", "", "/x"), ("allow", "", "/x"), ("allow", "b.com", "/en"), ("block", "b.com", "/en")]
    pages = spark.createDataFrame([(i, u, "k", "f", "key", 1) for i, u in enumerate(urls)] + [(None, None, None, None, None, 1)], "page_id long, url string, rule string, found string, key string, part int")
    assert U.found_name(pages) == "found_"
    for ranges in (1, 4, 23):
        out = U.apply_rules(pages, rules, ranges=ranges)
        assert out.columns == [*pages.columns, "found_"]
        got = {r.page_id: (r.url, r.rule, r.found, r.key, r.part, tuple(r.found_)) for r in out.collect()}
        assert len(got) == len(urls) + 1
        assert all(got[i] == (u, "k", "f", "key", 1, brute(u, rules)) for i, u in enumerate(urls))
    assert U.apply_rules(pages.limit(0), rules).count() == 0
    assert all(r.found_.rule is None for r in U.apply_rules(pages, []).collect())
