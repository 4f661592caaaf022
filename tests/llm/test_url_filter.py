"""URL filter against plain Python."""

from collections import Counter, defaultdict

import pytest

from conftest import SF_SMALL
from labelflow.llm import url_filter
from labelflow.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, salt long, n long, tmpl string, label string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "clash", 1, 2, "t", "x") for i, u in rows], SCHEMA).repartition(3)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return None, None
    best = max(fit, key=lambda f: (f[0], f[1]))
    return best[2] + best[3], best[4]


def brute(rows, rules, labels=None):
    import re
    urls = []
    for i, u in rows:
        host, path = split(u)
        name, said = rule(host, path, rules)
        label = {"block": "bad", "allow": "good"}.get(said) if labels is None else {True: "bad", False: "good"}.get(labels.get(i))
        parts = path.split("/")
        urls.append({"id": i, "host": host, "path": path, "rule": name, "said": said, "label": label,
                     "segs": parts[1:4] + (["/".join(parts[4:])] if len(parts) > 4 else []), "tmpl": ""})
    node = defaultdict(lambda: [0, 0])
    parent = {}
    for u in urls:
        node[u["host"], ""][0] += u["label"] == "bad"
        node[u["host"], ""][1] += u["label"] == "good"
    for lv in range(url_filter.LEVELS):
        here = [u for u in urls if len(u["segs"]) > lv]
        for u in here:
            u["seg"], u["form"] = u["segs"][lv], re.sub("[0-9]+", "<n>", u["segs"][lv])
            u["kind"] = (u["label"] or "none", len(u["segs"]) == lv + 1)
        forms = defaultdict(set)
        for u in here:
            if u["form"] != u["seg"]:
                forms[u["host"], u["tmpl"], u["form"]].add(u["seg"])
        kids, total = defaultdict(Counter), defaultdict(Counter)
        for u in here:
            u["name"] = u["form"] if len(forms[u["host"], u["tmpl"], u["form"]]) > url_filter.VARIABLE else u["seg"]
            kids[u["host"], u["tmpl"], u["name"]][u["kind"]] += 1
            total[u["host"], u["tmpl"]][u["kind"]] += 1
        step = {}
        for (h, t, name), c in kids.items():
            all_ = total[h, t]
            n, m = sum(c.values()), sum(all_.values())
            chi = sum((c[k] - n * all_[k] / m) ** 2 / (n * all_[k] / m) for k in all_) * m / (m - n) if n < m else 0
            only = sum(key[:2] == (h, t) for key in kids) == 1
            step[h, t, name] = name if only or (n >= url_filter.MIN_BRANCH and n < m and chi > url_filter.DIFFERENT) else "*"
        for u in here:
            above = u["host"], u["tmpl"]
            u["tmpl"] += "/" + step[u["host"], u["tmpl"], u["name"]]
            parent[u["host"], u["tmpl"]] = above
            node[u["host"], u["tmpl"]][0] += u["label"] == "bad"
            node[u["host"], u["tmpl"]][1] += u["label"] == "good"

    def purity(key):
        above = purity(parent[key]) if key in parent else url_filter.PRIOR
        bad, good = node[key]
        return (bad + url_filter.STRENGTH * above) / (bad + good + url_filter.STRENGTH)

    out = []
    for u in urls:
        key = u["host"], u["tmpl"]
        bad = sum(node[key]) >= url_filter.MIN_LABELLED and purity(key) >= url_filter.REJECT
        out.append((u["id"], u["host"], u["path"], u["rule"], u["tmpl"], u["said"] or ("block" if bad else "allow")))
    return out


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.page_id, r.host, r.path, r.rule, r.template, r.verdict) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


ODD = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "HTTP://A.Example.NET/EN/1"), (6, "http://example.net"), (7, "http://example.net/en/"),
       (8, "http://x.net?q=/en/"), (9, "http://notexample.com/de/1"), (10, "https://a.b.org/fr/1#x://y"), (11, "http://h.org:80/fr/1"),
       (12, "http://ÄÖ.example.com/de/ü"), (None, "http://h.org/fr/2"), (10, "https://a.b.org/fr/1#x://y"), (13, "http://h.com/" + "a/" * 4000),
       (14, "http://h.com//double//x"), (15, "http://h.com/a\nb/c?d"), (16, "://x.net/1"), (17, "http://net/1"), (18, "http://h.com/'quote'")]


def test_odd_urls(spark):
    same(url_filter.judge(pages(spark, ODD), URL_RULES), brute(ODD, URL_RULES))


def test_empty_table(spark):
    assert url_filter.judge(pages(spark, []), URL_RULES).count() == 0


def planted():
    """A host where /promo/ is bad, /news/ good, /blog/ unlabelled; many numbers and slugs."""
    rows, labels, i = [], {}, 0
    for k in range(120):
        for part, bad in (("promo", True), ("news", False), ("blog", None)):
            for host in ("big.example.com", "small.example.com") if k < 30 else ("big.example.com",):
                i += 1
                rows.append((i, f"http://{host}/{part}/{k}" + ("/" if k % 2 else "/more.html")))
                if bad is not None and k % 3:
                    labels[i] = bad
    for k in range(40):
        i += 1
        rows.append((i, f"http://slugs.example.com/{'abcdefghij'[k % 10]}word{'xyz'[k % 3]}/p{k}"))
        if k % 2:
            labels[i] = True
    return rows, labels


def test_labelled_templates(spark):
    rows, labels = planted()
    known = spark.createDataFrame([(k, v) for k, v in labels.items()], "page_id long, bad boolean")
    out = url_filter.judge(pages(spark, rows), [("allow", "small.example.com", "/promo/1/")], known)
    same(out, brute(rows, [("allow", "small.example.com", "/promo/1/")], labels))
    by = {(r.host, r.path): r for r in out.collect()}
    assert by["big.example.com", "/promo/3/"].verdict == "block"   # unlabelled itself
    assert by["big.example.com", "/promo/3/"].template == "/promo/<n>/*"
    assert by["big.example.com", "/news/3/"].verdict == by["big.example.com", "/blog/3/"].verdict == "allow"
    assert by["slugs.example.com", "/awordx/p0"].verdict == "block"   # similar branches are one
    assert by["small.example.com", "/promo/1/"].verdict == "allow"    # a rule comes first


def test_given_table_and_hot_host(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    rows += [(10_000 + i, f"http://hot.example.com/{'de' if i % 4 else 'en'}/{i % 700}.html") for i in range(1500)]
    same(url_filter.judge(pages(spark, rows), URL_RULES), brute(rows, URL_RULES))


def test_plan_has_no_python(spark):
    df = url_filter.judge(pages(spark, ODD), URL_RULES)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("order", [1, -1])
def test_longest_rule_wins_in_any_order(spark, order):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x")][::order]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages(spark, [(1, "a://example.net/en/x"), (2, "a://example.net/en/y"), (3, "a://net/q")]), rules).collect()}
    assert got == {1: ("example.net/en/x", "block"), 2: ("example.net/en/", "allow"), 3: ("net/", "block")}
