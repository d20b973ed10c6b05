import random

from leadloom.llm import components, survivor, topn


def union_find(pairs, nodes):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        p[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_groups_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 401 + i) for i in range(80)] + [(5, 5)]
    rows = [(f"n{a:03}", f"n{b:03}") for a, b in pairs]
    want = union_find(rows, {x for r in rows for x in r})
    df = spark.createDataFrame(rows + rows[:9] + [(None, "n900"), (None, None)], "a string, b string")
    got = {r["node"]: r["group_id"] for r in components.connected_groups(df, "a", "b").collect()}
    assert got == want | {"n900": "n900"}


def test_groups_by_levels_and_in_one_task_are_the_same(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 401 + i) for i in range(80)]
    rows = [(f"n{a:03}", f"n{b:03}") for a, b in pairs]
    want, df = union_find(rows, {x for r in rows for x in r}), spark.createDataFrame(rows, "a string, b string")
    for last in (0, 40, 10**6):
        got = {r["node"]: r["group_id"] for r in components.connected_groups(df, "a", "b", beta=0.5, rounds=2, last_edges=last).collect()}
        assert got == want


def test_rounds_take_no_more_tasks_than_their_rows_need(spark, monkeypatch):
    """Stages and tasks that the driver must track follow the edges, not the session's partitions (before: each of 60 rounds and more took all 64)."""
    asked, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, *a: (asked.append(a), real(df, *a))[1])
    df = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(500)], "a string, b string")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        groups = components.connected_groups(df, "a", "b").select("group_id").distinct().collect()
        assert [r[0] for r in groups] == ["n0000"] and len(asked) <= 4  # nodes, edges, the one task, the composed names
        asked.clear()
        assert components.connected_groups(df, "a", "b", last_edges=0).count() == 501
        assert len(asked) > 10 and {a for a in asked if a} == {(spark.sparkContext.defaultParallelism,)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_match_groups_cases(spark):
    s = "left_id string, right_id string, entity_match_score double, group_id int"
    df = spark.createDataFrame([(" A ", "b", 0.9, 1), ("B", "c", 0.82, 1), ("c", "d", float("nan"), 1), ("d", "e", None, 1), ("e", "f", 0.81, 1), (None, "g", 1.0, 1), ("h", "H", 1.0, 1), ("a", "b", 0.1, 1)], s)
    got = {r["record_id"]: r["group_id"] for r in components.match_groups(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h"}
    assert components.match_groups(df.limit(0)).count() == 0


def test_top_leads_brute_force(spark):
    rng = random.Random(1)
    leads = [(i, f"l{rng.randrange(60):02}", rng.choice(["x", "y", None, ""]), rng.choice(["p", "q"])) for i in range(200)]
    runs = [(i, f"l{rng.randrange(70):02}", rng.choice([None, 1, 2, 3]), rng.choice([None, float("nan"), 10.0, 20.0, 30.0])) for i in range(150)]
    l = spark.createDataFrame([(*r, "z") for r in leads], "record_no int, lead_id string, city string, category string, rank_no string")
    s = spark.createDataFrame([(a, b, None if c is None else f"2024-01-0{c}", d) for a, b, c, d in runs + runs[:7]], "score_no int, lead_id string, t string, sales_opportunity double").selectExpr("score_no", "lead_id", "cast(t as timestamp) scored_at", "sales_opportunity")
    best = {}
    for n, lead, t, v in runs:
        k = (t or 0, n)
        if lead not in best or k > best[lead][0]:
            best[lead] = (k, v)
    score = {k: v for k, (_, v) in best.items() if v is not None and v == v}
    want = []
    for c in ("x", "y"):
        for g in ("p", "q"):
            ids = sorted({r[1] for r in leads if r[2] == c and r[3] == g and r[1] in score}, key=lambda i: (-score[i], i))[:5]
            want += [(c, g, n + 1, i) for n, i in enumerate(ids)]
    assert sorted(tuple(r) for r in topn.top_leads(l, s).collect()) == sorted(want)
    assert topn.top_leads(l.limit(0), s).count() == 0


ROW = "row_no int, lead_id string, contact_type string, contact_value string, contact_role string, source string, source_url string, confidence double, verified_at timestamp, primary_contact boolean, exported_at timestamp, key string"


def test_field_survivors_brute_force(spark):
    import datetime as dt

    rng = random.Random(2)
    out = dt.datetime(2024, 6, 1)
    vals = [("PHONE", "+91 98765 43210"), ("PHONE", "9876543210"), ("EMAIL", " MAILTO:A@b.example?x"), ("EMAIL", "a@B.example"), ("CONTACT_FORM", "https://a.example/C/"), ("CONTACT_FORM", "https://a.example/c"), ("PHONE", "[DO_NOT_CONTACT]"), ("PHONE", None)]
    rows = []
    for i in range(160):
        k, v = rng.choice(vals)
        rows.append((i, rng.choice(["l1", "l2"]), k, v, rng.choice([None, " ", "owner"]), rng.choice([None, " manual", "SYSTEM", "odd"]), rng.choice([None, "u"]), rng.choice([None, float("nan"), 0.2, 0.9, 5.0]),
                     rng.choice([None, out - dt.timedelta(days=3), out + dt.timedelta(days=3)]), rng.choice([None, True, False]), out, "k"))
    df = spark.createDataFrame(rows + rows[:20], ROW)
    trust = spark.createDataFrame([("MANUAL", 1), ("SYSTEM", 5)], "source string, trust_rank int")
    rank = {"manual": 1, "system": 5}

    def key(k, v):
        if v is None or v == "[DO_NOT_CONTACT]":
            return None
        if k == "PHONE":
            return "".join(c for c in v if c.isdigit())[-10:]
        if k == "EMAIL":
            return v.strip().lower().removeprefix("mailto:").split("?")[0]
        return v.lower().removesuffix("/")

    groups = {}
    for r in rows:
        if key(r[2], r[3]):
            groups.setdefault((r[1], r[2], key(r[2], r[3])), []).append(r)
    want = set()
    for g in groups.values():
        if len(g) < 2:
            continue
        conf = lambda r: r[7] if r[7] is not None and 0 <= r[7] <= 1 else None
        ver = lambda r: r[8] if r[8] is not None and r[8] <= r[10] else None
        order = sorted(g, key=lambda r: (rank.get((r[5] or "").strip().lower(), 99), -(ver(r).timestamp() if ver(r) else -1e18), -(conf(r) if conf(r) is not None else -1), 0 if r[9] else 1, r[0]))
        for f, get in (("contact_role", lambda r: r[4] if r[4] and r[4].strip() else None), ("source_url", lambda r: r[6]), ("confidence", conf), ("verified_at", ver), ("primary_contact", lambda r: r[9])):
            first = next((r[0] for r in order if get(r) is not None), None)
            if first is not None:
                want.add((min(r[0] for r in g), f, first))
    assert {tuple(r) for r in survivor.field_survivors(df, trust).collect()} == want
    assert survivor.field_survivors(df.limit(0), trust).count() == 0


def test_truth_discovery_trusts_the_reliable(spark):
    rng = random.Random(4)
    claims = []
    for i in range(80):
        truth = f"v{i}"
        for s, p in (("good", 0.95), ("fair", 0.8), ("bad1", 0.2), ("bad2", 0.2)):
            claims.append((i, "f", truth if rng.random() < p else f"w{rng.randrange(3)}", s))
    df = spark.createDataFrame(claims + [(1, "f", None, "good")], "item int, field string, value string, source string")
    taken, weights = survivor.truth_discovery(df)
    right = sum(r["value"] == f"v{r['item']}" for r in taken.collect())
    w = {r["source"]: r["weight"] for r in weights.collect()}
    assert right >= 70 and w["good"] > w["bad1"] and w["good"] > w["bad2"]
    assert survivor.truth_discovery(df.limit(0))[0].count() == 0


def test_truth_discovery_runs_until_it_settles(spark):
    import pytest

    claims = [(i, "f", f"v{i}" if (i + k) % (k + 2) else f"w{i}", f"s{k}") for i in range(40) for k in range(5)]
    df = spark.createDataFrame(claims, "item int, field string, value string, source string")
    with pytest.raises(RuntimeError):
        survivor.truth_discovery(df, rounds=1)
    assert survivor.truth_discovery(df)[0].count() == 40


def test_truth_by_kinds_of_fields_equals_truth_by_claims(spark):
    """Few sources go another way to the same values, supports and weights; ties, repeats and one hot item included."""
    rng = random.Random(21)
    claims = [(rng.randrange(40) if rng.random() < 0.7 else 0, rng.randrange(3), rng.randrange(6), rng.choice("abcde")) for _ in range(900)]
    df = spark.createDataFrame(claims + claims[:50] + [(1, 1, None, "a"), (None, 1, 1, "a")], "item int, field int, value int, source string")
    (x, xw), (y, yw) = survivor.truth_discovery(df), survivor.truth_discovery(df, few=0)
    same = lambda df, n: sorted((*map(str, tuple(r)[:n]), round(tuple(r)[n], 6)) for r in df.collect())
    assert same(x, 3) == same(y, 3) and same(xw, 1) == same(yw, 1)
