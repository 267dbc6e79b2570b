from helpers import clashing

from matchbook.llm.url_filter import RULE_SCHEMA, RULES, judge_urls

URLS = ["https://example.org/es/1", "https://EXAMPLE.org/en/15?x", "https://a.b.example.org/en/2", "http://notexample.org/es/1",
        "http://x.com/fr/1", "http://x.com/de/", "http://com/de/#a", "http://x.org", "http://x.org?y=/", "no scheme", None, "",
        "ftp://u:p@h.example.org:80/es/", "http://a..org/", "x://y://example.org/es/", "http://example.org/es/", "http:///fr/"]


def brute(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def judged(df):
    return sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=repr)


def test_rules_match_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 3)] + [(None, URLS[0])] * 2
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"), "host", "verdict", "labels")
    out = judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA))
    assert "labels" in out.columns
    assert judged(out) == sorted([(i, u, *brute(u)) for i, u in rows], key=repr)


def test_hash_collisions_are_confirmed_by_the_digest(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    assert judged(judge_urls(pages, rules, prefix_chars=0)) == judged(judge_urls(pages, rules))


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).count() == 0
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert judged(judge_urls(pages, spark.createDataFrame([], RULE_SCHEMA))) == [(1, "http://x.org/", "x.org", "/", None, "allow")]
