"""Duplicate pairs against a comparison of all pairs, and merging."""

import itertools
import random

from pyspark.sql import functions as F

from leadloom.operators import pairs, resolve


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def spoilt(rng, name, edits):
    s = list(name)
    for _ in range(edits):
        k = rng.randrange(3)
        i = rng.randrange(len(s))
        if k == 0:
            s[i] = rng.choice("abcdxyz ")
        elif k == 1:
            s.insert(i, rng.choice("abcdxyz"))
        elif len(s) > 2:
            del s[i]
    return "".join(s)


def test_alike_names_equals_all_pairs(spark):
    rng = random.Random(11)
    stems = ["corwin bakery", "dunmore florist and sons", "al", "quill", "harbour end dental clinic", "b"]
    names = sorted({spoilt(rng, rng.choice(stems), rng.randrange(7)) for _ in range(260)} - {""})
    for floor in (0.6, pairs.NAME_FLOOR, 0.9):
        got = {(r["a"], r["b"]) for r in pairs.alike_names(spark.createDataFrame([(n,) for n in names] + [(None,), ("",), (names[0],)], "name string"), floor).collect()}
        want = {(a, b) for a, b in itertools.combinations(names, 2) if 1 - distance(a, b) / max(len(a), len(b)) >= floor - 1e-12}
        assert got == want and (floor > 0.8 or len(want) > 500)
        some = names[::7]
        part = pairs.alike_names(spark.createDataFrame([(n,) for n in names], "name string"), floor, spark.createDataFrame([(n,) for n in [*some, "unknown"]], "name string"))
        assert {(r["a"], r["b"]) for r in part.collect()} == {p for p in want if set(p) & set(some)}
    assert pairs.alike_names(spark.createDataFrame([], "name string")).count() == 0


def test_fuzzy_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        name = spoilt(rng, rng.choice(["corwin bakery", "dunmore florist", "harbour dental clinic"]), rng.randrange(4))
        rows.append((f"r{i:03d}", name, rng.choice([None, None, "+911", "+912"]), rng.choice([None, None, "a.example", "b.example"]), rng.choice([None, "12 teal street|millford", "12 teal st|millford", "9 oak road|otherton"])))
    rows.append(("r999", *rows[0][1:]))
    df = spark.createDataFrame(rows + [("z", "", None, None, None), ("y", None, None, None, None)], "id string, name string, phone string, domain string, addr string")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in pairs.fuzzy_pairs(df).collect()}
    reps = {}
    for r in rows:
        reps.setdefault(r[1:], r[0])
    want = {}
    like = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    for (x, i), (y, j) in itertools.combinations(sorted(reps.items(), key=lambda z: z[1]), 2):
        if (x[1] and x[1] == y[1]) or (x[2] and x[2] == y[2]):
            continue
        weight = 0.25 + 0.3 * bool(x[1] and y[1]) + 0.35 * bool(x[2] and y[2]) + 0.1 * bool(x[3] and y[3])
        score = (0.25 * like(x[0], y[0]) + (0.1 * like(x[3], y[3]) if x[3] and y[3] else 0)) / weight
        if score >= 0.82:
            want[i, j] = score
    assert got.keys() == want.keys() and len(want) > 300 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    members = {r["id"]: r["representative"] for r in pairs.membership(df).collect()}
    assert members["r999"] == members["r000"] and len(members) == 163


def test_full_records_are_compared_only_with_bare_ones(spark, monkeypatch):
    """Names of records with phone and domain don't enter the index where the other side may have either (before: all did)."""
    seen, real = [], pairs.alike_names
    monkeypatch.setattr(pairs, "alike_names", lambda names, *a, **k: (seen.append({r["name"] for r in names.collect()}), real(names, *a, **k))[1])
    rows = [("a", "corwin bakery", "1", "x", "12 teal street"), ("b", "corwin bakry", None, "y", "12 teal street"), ("c", "corwin bakary", "2", None, "12 teal street"), ("d", "corwin bakery s", None, None, "12 teal street")]
    got = {(r["left_id"], r["right_id"]) for r in pairs.fuzzy_pairs(spark.createDataFrame(rows, "id string, name string, phone string, domain string, addr string")).collect()}
    assert got == {("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert seen == [{"corwin bakry", "corwin bakary", "corwin bakery s"}, {"corwin bakery", "corwin bakery s"}]


def test_like_names_at_unlike_addresses_are_not_kept(spark, monkeypatch):
    """Only pairs that reach the threshold leave the comparison of names (before: every pair of like names did), and all of those do."""
    kept, real = [], pairs.alike_names
    monkeypatch.setattr(pairs, "alike_names", lambda *a, **k: (kept.append(real(*a, **k)), kept[-1])[1])
    rng = random.Random(17)
    rows = [(f"r{i:03d}", spoilt(rng, "harbour dental clinic", rng.randrange(7)), *rng.choice([("1", None), (None, "x")]), spoilt(rng, "12 teal street|upper green|millford", rng.randrange(13))) for i in range(120)]
    rows += [(f"s{i:03d}", f"dental clinic no {i}", *[("1", None), (None, "x")][i % 2], f"{chr(97 + i % 26) * 9} {i * 7919} road") for i in range(40)]
    rows = sorted({r[1:]: r for r in reversed(rows)}.values())  # one row a signal, the smallest id
    like = lambda a, b: 1 - distance(a, b) / max(len(a), len(b))
    found = {(x[0], y[0]): (0.25 * like(x[1], y[1]) + 0.1 * like(x[4], y[4])) / 0.35 for x, y in itertools.combinations(rows, 2) if x[2] != y[2]}
    want = {k: v for k, v in found.items() if v >= 0.82}
    got = {(r["left_id"], r["right_id"]): r["score"] for r in pairs.fuzzy_pairs(spark.createDataFrame(rows, "id string, name string, phone string, domain string, addr string")).collect()}
    assert got.keys() == want.keys() and 100 < len(want) < len(found) / 2 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(k.count() for k in kept) <= len(want)


def test_merging_children_and_id_lists(spark):
    mapping = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, survivor string")
    sites = spark.createDataFrame([("b", "x.example", 1), ("a", "x.example", 2), ("b", "y.example", 3), (None, "z.example", 4)], "owner string, domain string, n int")
    other = spark.createDataFrame([("b", "k"), ("b", "k"), ("q", "l")], "owner string, item string")
    got = pairs.merge_children({"websites": sites, "contacts": other}, mapping)
    assert sorted(map(tuple, got["websites"].filter("owner is not null").collect())) == [("a", "x.example", 2), ("a", "y.example", 3)]
    assert sorted(map(tuple, got["contacts"].collect())) == [("a", "k"), ("a", "k"), ("q", "l")]
    jobs = spark.createDataFrame([(1, ["a", "b", "z"]), (2, []), (3, None)], "job int, ids array<string>")
    assert {r["job"]: r["ids"] for r in pairs.merge_ids(jobs, mapping).collect()} == {1: ["a", "z"], 2: [], 3: None}


def test_first_signals_pass_over_nulls(spark):
    b = spark.createDataFrame([("a", "A", None), ("b", "B", None)], "id string, name string, address string")
    w = spark.createDataFrame([("a", 1, None), ("a", 2, "x.example"), ("a", 3, "y.example")], "id string, seq int, website string")
    p = spark.createDataFrame([("a", 2, "2"), ("a", 1, "1")], "id string, seq int, phone string")
    assert {tuple(r) for r in pairs.first_signals(b, w, p).collect()} == {("a", "A", "1", "x.example", None), ("b", "B", None, None, None)}
    s = resolve.signals(pairs.first_signals(b, w, p).withColumn("address", F.lit(None).cast("struct<line1:string,locality:string,city:string,postal_code:string,country:string>")))
    assert s.count() == 2
