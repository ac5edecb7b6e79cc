from accordant.llm.url_filter import RULES, judge_urls

SCHEMA = "page_id long, url string, html string, host int, verdict string, label string, length int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, "v", "l", 2) for i, u in rows], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def rule(host, path):
    fits = [r for r in RULES if (h := r.split("/", 1)[0], p := "/" + r.split("/", 1)[1]) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/EN/", "http://xexample.net/en/",
        "http://example.com/de/1", "http://example.com/fr/", "http://a.example.org/fr/x", "http://org/fr/", "http://x?a=b/c", "http://x#/en/", "http://É.net/a",
        "http://user:pw@h.net:80/a://b", "ftp://evilnet/", "http://example.com.net/de/", "://net/en/", "http://a.org/" + "fr/" * 20_000]


def test_hosts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://a.net/"), (5, "http://net/")]
    got = judge_urls(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((i is None, i or 0), *parts(u), rule(*parts(u)) or "") for i, u in rows)
    assert sorted(((r.page_id is None, r.page_id or 0), r.host, r.path, r.rule or "") for r in got) == want
    assert {r.verdict for r in got} <= {"allow", "block"} and all(r.verdict == RULES[r.rule] for r in got if r.rule)


def test_trees_learn_what_the_labels_show(spark):
    rules = {"bad.com/": "block", "good.com/": "allow"}
    rows = [(i, f"http://bad.com/{'9' * (20 + i % 7)}-{i}?a=1&b=2&c=3") for i in range(60)] + [(100 + i, f"http://good.com/page/{'abc' * (1 + i % 3)}") for i in range(60)]
    rows += [(300, "http://other.com/99999999999999999999-7?a=1&b=2&c=3"), (301, "http://other.com/page/abcabc")]
    got = {r.page_id: r.verdict for r in judge_urls(frame(spark, rows), rules=rules, rounds=5).collect()}
    assert got[300] == "block" and got[301] == "allow"


def test_without_labels(spark):
    assert judge_urls(frame(spark, [])).collect() == []
    assert {r.verdict for r in judge_urls(frame(spark, [(1, "http://a.b/"), (2, None)])).collect()} == {"allow"}
    got = judge_urls(frame(spark, [(1, "http://a.net/"), (2, "http://b/")])).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block"}


def test_odds_do_not_tell_a_label(spark):
    """Labelled domains that occur once are unknown in training, as others are in judging; so only the path helps."""
    hosts = [f"h{i}.com" for i in range(24)]
    rules = {f"{h}/": "block" if i % 2 else "allow" for i, h in enumerate(hosts)}
    rows = [(i, f"http://{h}/{('9' * 12 if i % 2 else 'abcd' * 3)}{i}") for i, h in enumerate(hosts)]
    rows += [(300 + i, f"http://other{i}.com/{'9' * 12}{i}") for i in range(5)] + [(400 + i, f"http://other{i}.com/{'abcd' * 3}{i}") for i in range(5)]
    got = {r.page_id: r.verdict for r in judge_urls(frame(spark, rows), rules=rules, rounds=3).collect()}
    assert all(got[300 + i] == "block" and got[400 + i] == "allow" for i in range(5))
