"""Queue steps, run aggregates and export rows on small tables with nulls, ties, repeats, empties and clashing extra columns."""

from pyspark.sql import functions as F

from leadloom.operators import export, queue, runs

def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def jobs(spark):
    rows = [("a", "s", "T", "PENDING", 100, 0), ("b", "s", "T", "PENDING", 200, 0), ("c", "s", "T", "PENDING", 100, 2), ("d", None, "T", None, None, 0), ("e", "q", "T", "COMPLETED", 5, 1)]
    df = spark.createDataFrame(rows, "id string, search_job string, type string, status string, priority int, attempts int")
    return queue.enqueue(df.select("id", "search_job", "type", "priority"), now()).drop("status", "attempts").join(df.select("id", "status", "attempts"), "id").withColumn("extra", F.lit(1))


def at(df):
    return {r["id"]: r for r in df.collect()}


def test_two_retries_then_failed(spark):
    q = jobs(spark)
    for attempt, status in ((1, "PENDING"), (2, "PENDING"), (3, "FAILED")):
        q = queue.claim(q.withColumn("available_at", now()), now(), "w", 1)
        assert at(q)["b"]["status"] == "PROCESSING" and at(q)["b"]["attempts"] == attempt and at(q)["a"]["status"] == "PENDING"
        q = queue.fail(q, spark.createDataFrame([("b", "x" * 5000, None), ("b", "y", False), ("gone", "z", True)], "id string, error string, permanent boolean"), now())
        assert at(q)["b"]["status"] == status and at(q)["b"]["locked_by"] is None and len(at(q)["b"]["last_error"]) == 4000
    assert at(q)["d"]["status"] is None and "extra" in q.columns


def test_permanent_errors_fail_at_once_and_others_stay(spark):
    q = queue.fail(jobs(spark), spark.createDataFrame([("a", "x", True), ("a", "w", False)], "id string, error string, permanent boolean"), now())
    assert at(q)["a"]["status"] == "FAILED" and at(q)["b"]["status"] == "PENDING"
    none = queue.fail(jobs(spark), spark.createDataFrame([], "id string, error string, permanent boolean"), now())
    assert at(none) == at(jobs(spark))


def test_cancel_complete_recover_and_empty_queue(spark):
    q = queue.claim(jobs(spark), now(), "w", 2)
    assert {k for k, r in at(q).items() if r["status"] == "PROCESSING"} == {"b", "a"}  # of equal priority and time the smaller id
    off = at(queue.cancel(q, spark.createDataFrame([("s",), (None,)], "search_job string")))
    assert {off[k]["status"] for k in "abc"} == {"CANCELLED"} and off["e"]["status"] == "COMPLETED"
    later = now() + F.expr("INTERVAL 301 SECOND")
    back = at(queue.recover(q, later))
    assert back["a"]["status"] == "PENDING" and back["a"]["last_error"] == queue.STALE and at(queue.recover(q, now()))["a"]["status"] == "PROCESSING"
    empty = jobs(spark).limit(0)
    for step in (queue.claim(empty, now(), "w", 3), queue.complete(empty, empty.select("id")), queue.cancel(empty, empty.select("search_job")), queue.recover(empty, now())):
        assert step.count() == 0


def test_run_aggregates(spark):
    m = spark.createDataFrame([(1, "SEO", "x", 1.0, 2), (1, "SEO", "x", 5.0, 1), (1, "SECURITY", "https", 1.0, 1), (1, "SECURITY", "csp", 0.0, 1), (1, "SECURITY", "tlsValid", 1.0, 1), (2, "SEO", None, None, 1)], "site_id int, module string, name string, value double, seq int")
    p = {r["site_id"]: r["seo_x"] for r in runs.metric_pivot(m, [("SEO", "x")], "seq").collect()}
    assert p == {1: 5.0, 2: None}
    assert {r["site_id"]: r["security"] for r in runs.security_fallback(m).collect()} == {1: 50.0, 2: None}
    c = spark.createDataFrame([("l", 0.5, True, "v", "LIKELY"), ("l", 0.9, False, "[DO_NOT_CONTACT]", None), ("k", float("nan"), None, None, None), ("k", 0.3, None, "v", None)], "lead string, confidence double, primary_contact boolean, contact_value string, verification_status string")
    assert {r["lead"]: r["contact_confidence"] for r in runs.contact_confidence(c, "lead").collect()} == {"l": 50.0, "k": 30.0}
    assert {tuple(r) for r in runs.any_flags(c, "lead").collect()} == {("l", True, True), ("k", False, False)}
    assert runs.metric_pivot(m.limit(0), [("SEO", "x")]).count() == runs.run_summary(spark.createDataFrame([], "site_id int, score double, confidence double")).count() == 0


def test_replacement_and_evidence(spark):
    old, new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int"), spark.createDataFrame([("a", 9)], "k string, v int")
    assert {tuple(r) for r in runs.replace_by_key(old, new, "k").collect()} == {("a", 9), ("b", 3)}
    assert runs.replace_by_key(old, new.limit(0), "k").count() == 3
    e = spark.createDataFrame([("s", "f", 2), ("s", "f", 1), ("s", "g", 3), ("s", "f", 1)], "subject string, field string, id int")
    r = spark.createDataFrame([("s", "r1", ["g", "f", "none"]), ("t", "r2", ["f"]), ("s", "r3", [])], "subject string, rule string, keys array<string>")
    assert {x["rule"]: x["evidence"] for x in runs.evidence_ids(r, e).collect()} == {"r1": [3, 1, 2], "r2": [], "r3": []}


def test_sparse_leads_export(spark):
    """A lead with nothing but a name, no metrics at all; formulas are quoted, opted-out contacts withheld."""
    leads = spark.createDataFrame([(1, "a", "=SUM(A1)", None), (2, "b", None, None)], "record_no int, lead_id string, business_name string, run_priority string")
    leads = leads.withColumns({c: F.lit(None).cast("string") for c in ("address", "locality", "city", "website")} | {c: F.lit(None).cast("double") for c in ("sales_opportunity", "website_health", "audit_confidence")})
    contacts = spark.createDataFrame([(7, "a", "PHONE", "+1555", 0.9, True)], "row_no int, lead_id string, contact_type string, contact_value string, confidence double, primary_contact boolean")
    none = lambda schema: spark.createDataFrame([], schema)
    rows = export.lead_rows(leads, contacts, none("site_id int, module string, name string, value double"), none("site_id int, name string, category string"), none("site_id int, code string, severity string"), F.col("record_no") == 1)
    got = {r["Lead ID"]: r for r in export.sheet(rows, export.EXECUTIVE).collect()}
    assert got["a"]["Business Name"] == "'=SUM(A1)" and got["a"]["Primary Phone"] == "[DO_NOT_CONTACT]" and got["b"]["Primary Phone"] is None
    audits = export.sheet(rows, export.AUDITS)
    assert audits.columns == list(export.AUDITS) and {r["HTTPS"] for r in audits.collect()} == {False} and {r["GTM"] for r in audits.collect()} == {"not detected"}
    book = export.workbook(rows, export.contact_rows(contacts.withColumns({c: F.lit(None).cast("string") for c in ("context", "contact_role", "source", "source_url", "verification_status", "verified_at")}), leads), "v1", now())
    assert [len(df.columns) for df in book.values()] == [26, 18, 45, 12, 21, 2] and all(df.count() >= 1 for df in book.values())
