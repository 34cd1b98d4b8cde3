"""URL filter and quality rules against plain Python versions."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")


def judged(url):
    host = path = ""
    if url and "://" in url:
        m = re.match("([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fit = []
    for verdict, rule in url_filter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fit.append((len(rule), rule, verdict))
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules_and_mined(spark):
    urls = [None, "", "example.org/fr/", "http://EXAMPLE.net", "https://a.example.net/en/x?y=1", "https://a.example.net/EN/x", "http://notnet/", "http://example.com/de/", "http://b.org/fr/1#t", "x://h?q/a", "ftp://É.NET/a"]
    urls += [f"http://spam-shop{i % 3}.example.com/offer/{i}" for i in range(20)] + [f"http://good{i}.example.com/en/{i}" for i in range(20)] * 2
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, confidence string")
    labels = spark.createDataFrame([(i, 0 if u and "offer" in u else 1, 0) for i, u in enumerate(urls)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = judged(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if u and "offer" in u else "allow")), u
    none = url_filter.judge(pages, labels.limit(0).where("false")).collect()
    assert len(none) == len(urls)
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def counts(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            inside |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@pytest.mark.parametrize("real", [False, True])
def test_quality_counts(spark, sf, real):
    if real:
        docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    else:
        texts = [None, "", " \n\t", "a b c a b c", "x\nx\n\nx\x0by\nx", "one", "a a a a", "#*$% & |<>", "é\u00a0é é", "w " * 60, " ".join(f"w{i}" for i in range(60))]
        docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words string")
        labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        n = counts(text)
        r = got[i]
        assert tuple(r[c] for c in quality.COUNTS) == n, text
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_exact_binomial():
    assert abs(quality.at_most(0, 10, 0.1) - 0.9**10) < 1e-12
    assert abs(quality.at_most(1, 3, 0.5) - 0.5) < 1e-12
    assert quality.at_most(5, 5, 0.2) == 1.0


def test_quality_cutoff_is_certified_and_bites(spark):
    plain, noisy = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}#####" for i in range(80))
    rows = [(i, plain, "en", 1) for i in range(300)] + [(300 + i, noisy, "en", 0) for i in range(40)]
    rows += [(400 + i, plain, None, 1) for i in range(30)] + [(430 + i, noisy, None, 0) for i in range(10)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")
    assert set(quality.thresholds(quality.counts(docs), labels)) == {"en"}  # too few labels in the other
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {r[0] for r in rows} - set(range(300, 340))
    # good documents like the bad ones beyond the risk: the sequence ends before its first cutoff
    mixed = labels.withColumn("quality", F.expr("if(doc_id between 300 and 320, 1, quality)"))
    assert quality.thresholds(quality.counts(docs), mixed) == {}
    # repeated rows don't make more trials, contradictory ones make none
    few = labels.where("doc_id < 120 or doc_id between 300 and 339")
    assert quality.thresholds(quality.counts(docs), few.unionByName(few).unionByName(few)) == quality.thresholds(quality.counts(docs), few) == {}
    torn = labels.unionByName(labels.where("doc_id < 200").withColumn("quality", F.lit(0)))
    assert quality.thresholds(quality.counts(docs), torn) == {}
    nobody = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.judge(nobody, labels).count() == docs.count() + 2
