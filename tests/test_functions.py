"""Scalar functions on freshly written inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.functions import freshness, text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [("Blue  Door, Ltd.", "blue door"), ("Crème & Thé Company", "creme the"), ("", ""), (None, None), ("A.B-C 24", "a b c 24")])
def test_name_key(spark, raw, want):
    assert one(spark, raw, text.name_key) == want


@pytest.mark.parametrize("raw,want", [
    (" MAILTO:Ann@Site.Example?subject=x", "ann@site.example"), ("a%2Bb@site.example", "a+b@site.example"), ("a+b@site.example", "a+b@site.example"),
    ("one@a.example,two@b.example", "one@a.example"), ("logo@2x.png", None), ("nobody", None), ("bad%zz@x.example", "bad%zz@x.example"), (None, None),
])
def test_email_key(spark, raw, want):
    assert one(spark, raw, text.email_key) == want


@pytest.mark.parametrize("raw,want", [("tel:+44 20 7946 0000", "+442079460000"), ("0044 20 7946 0000", "+442079460000"), ("98765 43210", "+919876543210"), ("12345", None), ("1" * 16, None), (None, None)])
def test_phone_key(spark, raw, want):
    assert one(spark, raw, text.phone_key) == want


@pytest.mark.parametrize("raw,want", [
    ("Site.Example/", "https://site.example"), ("http://SITE.example:80/a#b", "http://site.example/a"), ("https://site.example?q=1", "https://site.example/?q=1"), ("https://site.example:8443/", "https://site.example:8443"), ("bad host", None), (None, None),
])
def test_url_key(spark, raw, want):
    assert one(spark, raw, urls.url_key) == want


@pytest.mark.parametrize("raw,want", [("=SUM(A1)", "'=SUM(A1)"), ("+1", "'+1"), ("-x", "'-x"), ("@y", "'@y"), ("safe", "safe"), (None, None)])
def test_safe_cell(spark, raw, want):
    assert one(spark, raw, text.safe_cell) == want


@pytest.mark.parametrize("raw,want", [(38.04, 38.0), (38.05, 38.1), (-3.0, 0.0), (101.0, 100.0), (float("nan"), 0.0), (None, None)])
def test_clamp(spark, raw, want):
    assert one(spark, raw, text.clamp_score, "double") == want


def test_similarity(spark):
    row = spark.createDataFrame([("little corner shop", "little corner shp"), ("", ""), ("a", "")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert row[0]["s"] > 0.85 and row[1]["s"] == 1.0 and row[2]["s"] == 0.0


def test_freshness(spark):
    now = dt.datetime(2024, 6, 20)
    rows = [(None,), (now,), (now - dt.timedelta(days=7),), (now - dt.timedelta(days=14),), (now + dt.timedelta(days=1),)]
    df = spark.createDataFrame(rows, "t timestamp")
    n = F.lit("2024-06-20 00:00:00").cast("timestamp")
    got = df.select(freshness.is_fresh(F.col("t"), n, "crawl").alias("f"), F.round(freshness.freshness_score(F.col("t"), n, "crawl"), 6).alias("s")).collect()
    assert [r["f"] for r in got] == [False, True, True, False, True]
    assert [r["s"] for r in got] == [0.2, 1.0, 0.7, 0.0, 1.0]


@pytest.mark.parametrize("ip,want", [("10.1.2.3", True), ("172.31.0.1", True), ("172.32.0.1", False), ("100.64.0.1", True), ("8.8.8.8", False), ("::1", True), ("fd00::1", True), ("x.y.z.w", False)])
def test_private(spark, ip, want):
    assert one(spark, ip, urls.is_private_ip) is want


def test_website_choice(spark):
    links = ["https://www.google.com/maps", "https://m.facebook.com/shop", "https://www.google.com/url?q=https%3A%2F%2Fshop.example%2F&x=1"]
    df = spark.createDataFrame([(links,), ([],)], "l array<string>").select(urls.pick_website(F.col("l")).alias("w")).collect()
    assert [r["w"] for r in df] == ["https://shop.example/", None]


def test_label(spark):
    p = one(spark, "Corner Bakery · 4.4 stars (12) · Bakery · 12 Long Street, Town", urls.parse_label)
    assert (p["name"], p["category_hint"], p["address_hint"]) == ("Corner Bakery", "Bakery", "12 Long Street, Town")


def test_hash_score_is_fixed(spark):
    import hashlib

    n = int.from_bytes(hashlib.sha256(b"perf:https://a.example").digest()[:2], "big") / 65535
    assert one(spark, "https://a.example", lambda c: text.hash_score(c, "perf", 45, 92)) == int(45 + n * 47 + 0.5)
