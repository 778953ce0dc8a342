"""URL filters against plain Python: rules by trying all, models by counting in dicts."""

import math
from zlib import crc32

import numpy as np
import pytest

from millrace.llm import url_filter as uf
from millrace.llm.queries import URL_RULES, op12_url_filter
from tests.llm.test_dedup import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def rule_of(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def counts(urls):
    found = {}
    for url in urls:
        data = b"\0" * uf.ORDER + url + b"\0"
        for at in range(uf.ORDER, len(data)):
            for order in range(uf.ORDER + 1):
                followers = found.setdefault(data[at - order : at], {})
                followers[data[at]] = followers.get(data[at], 0) + 1
    return found


def log_likelihood(found, url):
    data, total = b"\0" * uf.ORDER + url + b"\0", 0.0
    for at in range(uf.ORDER, len(data)):
        p = 1 / 256
        for order in range(uf.ORDER + 1):
            followers = found.get(data[at - order : at])
            if followers:
                n, d = sum(followers.values()), len(followers)
                p = (followers.get(data[at], 0) + d * p) / (n + d)
        total += math.log(p)
    return total


def plain(urls, rules, slope=None, shift=None):
    """(host, path, rule, difference) of each URL, with models of all URLs with rules outside the fold."""
    sides = {"allow": [], "block": []}
    for u in urls:
        rule = rule_of(*split(u), rules)
        if rule and crc32((u or "").encode()) % 5:
            sides[rule.verdict].append((u or "").encode())
    allowed, blocked = counts(sides["allow"]), counts(sides["block"])
    for u in urls:
        raw = (u or "").encode()
        rule = rule_of(*split(u), rules)
        gap = (log_likelihood(allowed, raw) - log_likelihood(blocked, raw)) / len(raw) if raw and sides["allow"] and sides["block"] else 0.0
        yield *split(u), rule and rule.text, gap


ODD = [
    None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM:80/en/", "http://example.com", "http://example.com/en", "http://a.example.com/en/x?http://net/es/", "http://notexample.com/en/",
    "http://example.com/EN/", "http://x.net/es/1#a", "http://net/fr/", "http://x.net?/fr/", "http://ÄÖ.net/es/ü", "http://.com/", "x://y://net/es/", "http://a.com/\n/en/", "http://net.com/fr/",
    "http://long.example.org/" + "a/b" * 3_000, "http://b.example.org/en/", "http://b.example.org/en/",
]


def test_hosts_paths_rules_and_models_of_odd_urls(spark):
    urls = ODD + [f"http://{h}.example.{t}/{p}/{k}" for k in range(12) for h in ("www", "m") for t in ("com", "net", "org") for p in ("en", "es", "fr")]
    pages = spark.createDataFrame([(None if k == 3 else k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    model = uf.fit(pages, URL_RULES)
    got = uf.judge(pages, URL_RULES, model).collect()
    assert len(got) == len(urls)
    by_id = {r.page_id: r for r in got}
    for k, (host, path, rule, gap) in enumerate(plain(urls, URL_RULES)):
        row = by_id[None if k == 3 else k]
        assert (row.host, row.path, row.rule) == (host, path, rule), urls[k]
        assert row.probability == pytest.approx(1 / (1 + math.exp(-model.slope * gap - model.shift)), rel=1e-6)
        assert row.verdict == (next(r.verdict for r in URL_RULES if r.text == rule) if rule else "allow" if row.probability >= 0.5 else "block")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in op12_url_filter(spark, str(SF)).collect()}
    assert len(got) == len(pages)
    want = list(plain([r.url for r in pages], URL_RULES))
    assert [(got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) for r in pages] == [w[:3] for w in want]
    # without rules the probability grows with the difference, and the verdict is its half
    free = sorted((w[3], got[r.page_id].probability, got[r.page_id].verdict) for r, w in zip(pages, want, strict=True) if w[2] is None)
    assert [x[1] for x in free] == sorted(x[1] for x in free)
    assert all((p >= 0.5) == (v == "allow") for _, p, v in free)


def test_models_tell_kept_out_urls_apart(spark):
    made = [(k, f"http://{'shop' if k % 2 else 'casino'}-{k * 7919 % 1000}.{'com' if k % 2 else 'net/es'}/{'item' if k % 2 else 'win-bonus'}/{k}") for k in range(3000)]
    pages = spark.createDataFrame(made, "page_id long, url string")
    model = uf.fit(pages, URL_RULES)
    others = [f"http://{w}-{k}.org/{p}/{k}" for k in range(200) for w, p in (("shop", "item"), ("casino", "win-bonus"))]
    likely = uf.probabilities(model, uf.differences(model, [u.encode() for u in others]))
    assert np.mean((likely >= 0.5) == np.tile([True, False], 200)) > 0.97


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/"), (3, None)], "page_id long, url string")
    got = uf.judge(pages, URL_RULES, uf.fit(pages, URL_RULES)).collect()
    assert [(r.rule, r.verdict, r.probability) for r in sorted(got)] == [("com/", "allow", 0.5), (None, "allow", 0.5), (None, "allow", 0.5)]
    none = pages.limit(0)
    assert uf.judge(none, URL_RULES, uf.fit(none, URL_RULES)).count() == 0


def test_small_model_keeps_what_is_frequent(spark):
    pages = spark.createDataFrame([(k, f"http://{k}.{'com' if k % 2 else 'net/fr'}/page") for k in range(400)], "page_id long, url string")
    whole, few = uf.fit(pages, URL_RULES), uf.fit(pages, URL_RULES, most_entries=100)
    assert len(few.keys) <= 100 + 256 < len(whole.keys)
    assert set(few.keys) <= set(whole.keys)


@pytest.mark.parametrize("most", [1, 150, 2_000])
def test_rare_contexts_decide_too(spark, most):
    urls = ODD + [f"http://{k * 7919 % 1000}.{'com' if k % 2 else 'net/fr'}/page{k}" for k in range(200)] + [f"http://w{k * 7919 % 1000}.org/page{k}" for k in range(100)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    whole, few = uf.fit(pages, URL_RULES), uf.fit(pages, URL_RULES, most_entries=most)
    assert whole.rest is None and len(few.keys) + few.rest.filter("key < 1L << 60").count() == len(whole.keys)
    assert (few.slope, few.shift) == pytest.approx((whole.slope, whole.shift), rel=1e-9)
    by_id = lambda model: {r.page_id: r for r in uf.judge(pages, URL_RULES, model).collect()}
    want, got = by_id(whole), by_id(few)
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k][:5] == row[:5] and got[k].probability == pytest.approx(row.probability, rel=1e-9), urls[k]


def test_rules_against_trying_all():
    rules = [uf.Rule(v, h, p) for v in ("allow", "block") for h in ("com", "a.com", "b.a.com", "net") for p in ("", "/", "/x", "/x/y", "/xy") if hash(h + p) % 3 or v == "allow"]
    rules += [uf.Rule("block", "com", "/x/")]
    of = uf.Rules(rules)
    for host in ("", "com", "a.com", "b.a.com", "c.b.a.com", "net", "xcom", "a.net", "com.net"):
        for path in ("", "/", "/x", "/x/", "/x/y/z", "/xyz", "x"):
            assert of.find(host, path) == rule_of(host, path, rules), (host, path)


def test_calibration_is_a_minimum():
    rng = np.random.default_rng(1)
    value, allowed = rng.normal(size=400), rng.random(400) < 0.3
    value = value + allowed
    slope, shift = uf.calibrated(np.ones(400), value, allowed, 1e-9)
    w = np.where(allowed, 0.5 / allowed.sum(), 0.5 / (~allowed).sum())

    def loss(a, b):
        return (w * (np.logaddexp(0, a * value + b) - allowed * (a * value + b))).sum()

    assert all(loss(slope, shift) <= loss(slope + x, shift + y) for x in (-1e-3, 0, 1e-3) for y in (-1e-3, 0, 1e-3))
