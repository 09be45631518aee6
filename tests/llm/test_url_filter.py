import math
from collections import defaultdict

from seasonframe.llm import url_filter as U

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "html", "clash", 1.0) for k, u in enumerate(urls)], "page_id long, url string, html string, rule string, score double")


def test_parts_and_rules(spark):
    urls = {
        "http://WWW.Example.NET/en/1?q=/de/": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://a.example.net/de/#x": ("a.example.net", "/de/", "net/", "block"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "ftp://notexample.com/de/": ("notexample.com", "/de/", None, None),
        "x://y.org/fr/?a": ("y.org", "/fr/", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, None),
        "http://a.net?b/": ("a.net", "", None, None),
        "no scheme": ("", "", None, None),
        "http://b.com/c://d.net/": ("b.com", "/c://d.net/", None, None),
        "HTTP://ÄB.net/x": ("Äb.net", "/x", "net/", "block"),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    found = {r.page_id: r for r in U.url_filter(pages(spark, list(urls)), RULES).collect()}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        r = found[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def grams(host, path):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host + path)
    s = "^^^" + "".join("0" if c.isdigit() else c if c in U.ALPHABET[:-2] else "?" for c in low) + "$"
    return [s[i : i + 4] for i in range(len(s) - 3)]


def test_scores_and_verdicts_equal_plain_models(spark):
    urls = [f"http://{h}.{'example.net/en' if k % 2 else 'spam.net'}/{h}{k}" for k, h in enumerate(["good", "evil", "fine", "vile"] * 30)]
    urls += [f"http://{h}.info/{k}" for k, h in enumerate(["evil", "good", "other"] * 5)]
    found = {r.page_id: r for r in U.url_filter(pages(spark, urls), RULES).collect()}
    count = {c: defaultdict(int) for c in ("allow", "block")}
    given = {k: r.verdict if r.rule else None for k, r in found.items()}
    for k, r in found.items():
        if given[k] and k % U.FOLDS:
            for g in grams(r.host, r.path):
                for n in range(1, 5):
                    count[given[k]][g[-n:]] += 1
                    count[given[k]][n, g[4 - n : 3]] += 1

    def p(c, g):
        out = 1 / len(U.ALPHABET)
        for n in range(1, 5):
            out = (count[c][g[-n:]] + U.SMOOTHING * out) / (count[c][n, g[4 - n : 3]] + U.SMOOTHING)
        return out

    scores = {k: sum(math.log(p("allow", g) / p("block", g)) for g in grams(r.host, r.path)) / len(grams(r.host, r.path)) for k, r in found.items()}
    for k, r in found.items():
        assert math.isclose(r.score, scores[k], rel_tol=1e-9, abs_tol=1e-12)
    held = [(math.floor(scores[k] * 100), given[k]) for k in found if given[k] and k % U.FOLDS == 0]
    size = {c: sum(g == c for _, g in held) for c in count}
    cuts = sorted({b for b, _ in held})
    error = [round(sum(b < x and g == "allow" for b, g in held) / size["allow"] + sum(b >= x and g == "block" for b, g in held) / size["block"], 9) for x in cuts]
    best = cuts[error.index(min(error))] / 100
    for k, r in found.items():
        assert r.verdict == (given[k] or ("allow" if scores[k] >= best else "block"))


def test_nothing_to_learn_from(spark):
    found = U.url_filter(pages(spark, ["http://a.info/", None, "http://a.info/"]), RULES).collect()
    assert [r.verdict for r in found] == ["allow"] * 3
    assert U.url_filter(pages(spark, []), RULES).collect() == []
    blocked = [f"http://x{k}.net/" for k in range(12)] + ["http://a.info/"]
    assert [r.verdict for r in U.url_filter(pages(spark, blocked), RULES).orderBy("page_id").collect()] == ["block"] * 12 + ["allow"]
    both = spark.createDataFrame([(None, "http://x.net/"), (7, None), (7, "http://x.net/")], "page_id long, url string")
    assert U.url_filter(both, RULES).count() == 3
