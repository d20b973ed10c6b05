"""Operators on small tables, with nulls, ties, repeats, empty input and extra columns."""

import random

from pyspark.sql import functions as F

from leadloom.functions import dom
from leadloom.operators import audit, contacts, graph, leads, resolve, verify
from leadloom.sources import candidates, pages


def test_connected_matches_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, 7), (None, 3)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent}
    got = {r["node"]: r["group_id"] for r in graph.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert graph.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


REC = "id string, name string, phone string, website string, address struct<line1:string,locality:string,city:string,postal_code:string,country:string>, extra int"


def records(spark):
    a = ("1 Long Road", "Old Town", "Town", "1000", "Land")
    return spark.createDataFrame([
        ("a", "Corner Bakery", "98765 43210", "corner.example", a, 1), ("b", "Corner Bakery Ltd", "+919876543210", "https://www.corner.example/x", a, 2),
        ("c", "Other", None, None, None, 3), ("d", "Mill", "98765 43210", "mill.example", None, 4), ("a", "Corner Bakery", "98765 43210", "corner.example", a, 1),
    ], REC)


def test_pair_scores(spark):
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "zz")], "left_id string, right_id string")
    got = {r["right_id"]: r for r in resolve.score_pairs(p, records(spark)).collect()}
    assert set(got) == {"b", "c", "d"}
    assert got["b"]["score"] > 0.9 and {"exact_domain", "exact_phone"} <= set(got["b"]["reasons"])
    assert not got["c"]["duplicate"] and got["d"]["duplicate"]


def test_exact_classes(spark):
    got = {r["id"]: (r["group_id"], r["links"]) for r in resolve.exact_classes(records(spark)).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("c", 0), "d": ("a", 2)}


def test_survivors_and_repoint(spark):
    g = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, group_id string")
    seen = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-01-01"), ("c", None)], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    m = resolve.survivors(g, seen)
    assert {r["id"]: r["survivor"] for r in m.collect()} == {"a": "b", "b": "b", "c": "c"}
    kids = spark.createDataFrame([("a", "x"), ("b", "x"), ("q", "x")], "owner string, domain string")
    assert sorted(r["owner"] for r in resolve.repoint(kids, "owner", m, ["domain"]).collect()) == ["b", "q"]


def test_verify(spark):
    rows = spark.createDataFrame([
        ("Smile Care", "smilecare.in", "98765 43210", "Town", "Smile Care Town", "call 9876543210"), ("Smile Care", "other.example", None, None, None, None), ("X", "bad host", None, None, None, None),
    ], "name string, website string, phone string, city string, title string, page_text string")
    got = [(r["status"], round(r["confidence"], 2)) for r in verify.verify_websites(rows).collect()]
    assert got == [("VERIFIED", 1.0), ("INVALID", 0.0), ("INVALID", 0.0)]


HTML = (
    '<html><head><title>T</title><script type="application/ld+json">[{"telephone":"+4420 7946 0000"},{"email":"shop@site.example"}]</script><script type="application/ld+json">{broken</script></head>'
    '<body><span>reservations</span><a href="tel:98765-43210">Call</a><footer><a href="mailto:info@site.example?subject=Hi">m</a></footer>'
    '<a href="https://wa.me/919876543211">w</a><form action="/Contact"><input name="email"></form>you@site.example 0123456789abcdef0@x.example</body></html>'
)


def test_contacts(spark):
    p = spark.createDataFrame([(1, "https://site.example/", HTML, 9), (2, "https://site.example/contact", None, 9), (3, "https://site.example/x", "", 9)], "page_id int, url string, html string, raw int")
    got = {(r["kind"], r["value"]): r for r in contacts.extract_contacts(p).collect()}
    assert ("EMAIL", "you@site.example") not in got
    mail = got["EMAIL", "info@site.example"]
    assert mail["method"] == "MAILTO" and mail["confidence"] >= 0.7 and mail["status"] == "LIKELY"
    assert got["PHONE", "+919876543210"]["method"] == "TEL" and got["WHATSAPP", "+919876543211"]["confidence"] == 0.75
    assert got["EMAIL", "shop@site.example"]["method"] == "SCHEMA_ORG" and ("PHONE", "+442079460000") in got
    assert ("CONTACT_FORM", "https://site.example/contact") in got


def test_upsert_and_ties(spark):
    s = "k string, v int, at timestamp"
    mk = lambda rows: spark.createDataFrame(rows, "k string, v int, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = contacts.upsert(mk([("a", 1, "2024-01-02"), ("b", 1, None)]), mk([("a", 2, "2024-01-02"), ("c", 2, None)]), ["k"], "at")
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": 2, "b": 1, "c": 2}
    assert contacts.upsert(spark.createDataFrame([], s), spark.createDataFrame([], s), ["k"], "at").count() == 0


def page(spark, html, url="https://s.example/", headers=None):
    return spark.createDataFrame([("s", 1, url, html, 200, headers or {})], "site_id string, seq int, url string, html string, status int, headers map<string,string>")


def test_audit_modules(spark):
    good = '<html lang="en"><head><title>A</title><meta name="description" content="d"><meta name="viewport" content="width=device-width"><link rel="canonical" href="x"></head><body><main><h1>H</h1>' + "words " * 60 + '<a href="tel:1">call now</a></main></body></html>'
    m = audit.all_modules(page(spark, good))
    assert set(m) == set(audit.FINDINGS)
    assert m["SEO"].first()["score"] > 70 and m["ACCESSIBILITY"].first()["score"] > 50 and m["MOBILE_UX"].first()["score"] > 50
    bare = audit.all_modules(page(spark, "<html><body>x</body></html>", "http://s.example/"))
    codes = {r["code"] for k, a in bare.items() for r in audit.findings(k, a).collect()}
    assert {"MISSING_LANG", "BAD_VIEWPORT", "NO_HTTPS", "MISSING_TITLE"} <= codes
    assert {k: a.count() for k, a in audit.all_modules(page(spark, None)).items()}["SEO"] == 1


def test_technologies(spark):
    p = page(spark, '<script src="https://www.googletagmanager.com/gtm.js"></script><link href="/wp-content/a.css">')
    t = audit.technologies(p)
    assert {r["name"] for r in t.collect()} == {"WordPress", "Google Tag Manager"}
    assert audit.marketing(t, p).first()["gtm"] == "detected" and audit.marketing(t, p).first()["hotjar"] == "not detected"


def test_weighted_mean(spark):
    d = spark.createDataFrame([(1, "seo", 80.0, True), (1, "mobileUx", 60.0, True), (1, "technical", 0.0, False), (2, "seo", 10.0, False)], "id int, key string, score double, reliable boolean")
    got = {r["id"]: r["health"] for r in audit.weighted_mean(d, ["id"], {"seo": 0.15, "mobileUx": 0.15, "technical": 0.1}).collect()}
    assert abs(got[1] - 70) < 1e-9 and got[2] is None


def test_dom_signals_agree_with_patterns(spark):
    n = dom.page_signals(HTML)
    assert n["mail"] == n["footer_mail"] == 1 and n["fields"] == 1
    assert dom.page_signals(None)["depth"] == 0
    assert dom.dom_signals(spark.createDataFrame([(1, HTML), (2, None)], "page_id int, html string")).count() == 2


def test_expand_queries(spark):
    j = spark.createDataFrame([(1, "Town", None, "Land", ["North", "South"], ["dentist"], {"dentist": ["tooth doctor"]}), (2, "City", "", "Land", [], ["cafe"], None)], "job_id int, city string, state string, country string, localities array<string>, categories array<string>, aliases map<string,array<string>>")
    got = candidates.expand_queries(j).collect()
    assert len(got) == 5 and "tooth doctor North Town Land" in {r["query_text"] for r in got} and "cafe City Land" in {r["query_text"] for r in got}


def test_places_and_sources(spark):
    rows = spark.createDataFrame([('{"id":"p1","displayName":{"text":" A "},"businessStatus":"OPERATIONAL","types":["x"],"internationalPhoneNumber":"+1"}',), ('{"id":"p2"}',), ("broken",), (None,)], "json string")
    got = candidates.place_candidates(rows).collect()
    assert [(r["external_id"], r["name"], r["status"], r["phone"]) for r in got] == [("places:p1", "A", "OPEN", "+1")]
    assert candidates.source("mock") is candidates.generated_candidates
    s = spark.createDataFrame([("Town", None, "dental clinic", "q")], "city string, locality string, category string, query_text string")
    a, b = (sorted(map(str, candidates.generated_candidates(s).collect())) for _ in range(2))
    assert a == b and sum(":dup" in x for x in a) == 1


def test_robots_and_frontier(spark):
    b = spark.createDataFrame([(1, "User-agent: *\nDisallow: /\n"), (2, "Disallow: /x\nSitemap: https://a.example/s.xml"), (3, "")], "id int, body string")
    got = {r["id"]: (r["allowed"], r["sitemap"]) for r in pages.robots_rules(b).collect()}
    assert got == {1: (False, None), 2: (True, "https://a.example/s.xml"), 3: (True, None)}
    l = spark.createDataFrame([(f"https://a.example/p{i}", i) for i in range(40)] + [("https://a.example/contact/", 99), (None, 1)], "url string, seq int")
    got = pages.crawl_frontier(l).collect()
    assert len(got) == 15 and any(r["url"].endswith("/contact") and r["place"] == 1 for r in got)


def test_lead_page_and_export(spark):
    rows = spark.createDataFrame([(i, f"l{i}", f"=N{i}", "c", "Town", None, "1 Road", None, "A", None, None) for i in range(5)], "record_no int, lead_id string, business_name string, category string, city string, locality string, address string, website string, data_quality_grade string, discovery_source string, last_verified timestamp")
    scores = spark.createDataFrame([(1, "l1", "2024-01-01", 50.0), (2, "l1", "2024-01-01", 60.0), (3, "l2", "2024-01-02", float("nan")), (4, "l3", None, 90.0)], "score_no int, lead_id string, scored_at string, sales_opportunity double").withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    for c in ("website_health", "contact_confidence", "audit_confidence"):
        scores = scores.withColumn(c, F.lit(None).cast("double"))
    scores = scores.withColumn("priority", F.lit("HOT"))
    cur = leads.current(rows, scores)
    assert [r["record_no"] for r in leads.lead_page(cur, size=3).collect()] == [3, 1, 0]
    assert leads.page_counts(cur, 2).first()["pages"] == 3
    con = spark.createDataFrame([(1, "l1", "PHONE", "+1", 0.5, False), (2, "l1", "PHONE", "+2", float("nan"), True)], "row_no int, lead_id string, contact_type string, contact_value string, confidence double, primary_contact boolean")
    x = {r["record_no"]: r for r in leads.export_rows(cur, con, F.col("record_no") == 1).collect()}
    assert x[1]["phone"] == "[DO_NOT_CONTACT]" and x[0]["business_name"] == "'=N0" and x[0]["contacts"] == 0
    assert {r["record_no"]: r["website_style"] for r in leads.export_styles(leads.export_rows(cur, con)).collect()}[0] == "missing"
