import random

from pyspark.sql import functions as F

from leadloom.llm import addresses, categories, linkage, postal

LEAD = "record_no bigint, address string, city string, locality string, postal_code string, state string, country string, category string"
MAPS = "record_no bigint, address_hint string, query_text string, category_hint string"
ENT = "record_no bigint, provider_id string, name string, phone string, website string, address struct<line1:string,locality:string,city:string,postal_code:string,country:string>"


def leads(spark):
    rows = [(100 + i, f"{i} Filler Road, North Quay, Millford", "Millford", "North Quay", "410107", "State", "Land", None) for i in range(1, 4)]
    rows += [(200 + i, f"{i} Filler Road, Eastgate, Otherton", "Otherton", "Eastgate", "420100", "State", "Land", None) for i in range(11, 14)]
    rows += [(1, "12A Teal Street, North Quay, Millford", "Millford", "North Quay", None, "State", "Land", "Bakery"), (2, "Teal Str 12a, Flat 3", "Millford", None, None, None, None, "bakeyr"),
             (3, "12 Teal Street, North Quay, Millford", "Millford", "North Quay", None, None, None, " "), (4, None, "Millford", None, None, None, None, None), (5, "near Bus Stand, Millford", "Millford", None, None, None, None, "???"),
             (6, "12A Teal Street, Eastgate, Otherton", "Otherton", "Eastgate", None, None, None, "Windmill")]
    return spark.createDataFrame(rows + rows[-6:-4], LEAD)


def test_same_building(spark):
    maps = spark.createDataFrame([(7, "Millford 410107, #12A Tael St. (opp. Clock Tower)", "bakery in Millford, Land", None), (8, None, "x in Millford, Land", None)], MAPS)
    ents = spark.createDataFrame([(9, "p", "n", None, None, ("No. 12A Teal St", "N. Quay, Millford", None, "410 107", "Land")), (10, "p", "n", None, None, None)], ENT)
    got = {tuple(r) for r in addresses.same_building(maps, leads(spark), ents).collect() if max(r) < 100}
    assert got == {(1, 2), (1, 7), (1, 9), (2, 7), (2, 9), (7, 9)}
    assert addresses.same_building(maps.limit(0), leads(spark).limit(0), ents.limit(0)).count() == 0


def test_street_kinds_and_postcodes(spark):
    """Streets of one name and another kind differ; a missing kind is the street's own; a postcode joins spellings of unknown locality."""
    rows = [(1, "5 Mill Lane, North Quay, Millford"), (2, "5 Mill Ln, N. Quay, Millford"), (3, "5 Mill Road, North Quay, Millford"), (4, "5 Mill Rd., Millford 410107"),
            (5, "9 Corvane Street, Millford 410107"), (6, "9 Corvame St, Millford 410107"), (7, "9 Corvane, Millford 410107")]
    extra = spark.createDataFrame([(i, t, "Millford", None, None, "State", "Land", None) for i, t in rows], LEAD)
    none = spark.createDataFrame([], MAPS), spark.createDataFrame([], ENT)
    every = leads(spark).unionByName(extra)
    got = {tuple(r) for r in addresses.same_building(none[0], every, none[1]).collect() if max(r) < 100}
    assert {(1, 2), (3, 4), (5, 6), (5, 7), (6, 7)} <= got and not {(1, 3), (1, 4), (2, 3)} & got


def test_classes_and_units(spark):
    rows = [(1, "Flat 2, 5 Mill Lane, North Quay, Millford"), (2, "Flat 3, 5 Mill Lane, North Quay, Millford"), (3, "5 Mill Lane, North Quay, Millford"), (3, "5 Mill Lane, North Quay, Millford"), (4, "6 Mill Lane, North Quay, Millford")]
    df = spark.createDataFrame([(i, t, "Millford", None, None, "State", "Land", None) for i, t in rows], LEAD)
    known = leads(spark).filter("record_no > 100").unionByName(df)
    none = spark.createDataFrame([], MAPS), spark.createDataFrame([], ENT)
    classes = {r["record_no"]: (r["building_no"], r["links"]) for r in addresses.building_classes(addresses.record_buildings(none[0], known, none[1])).collect()}
    assert {k: v for k, v in classes.items() if k < 100} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}
    pairs = lambda veto: {tuple(r) for r in addresses.same_building(none[0], known, none[1], unit_veto=veto).collect() if max(r) < 100}
    assert pairs(False) == {(1, 2), (1, 3), (2, 3)} and pairs(True) == {(1, 3), (2, 3)}


def test_long_place_lists_are_split(spark):
    """Beyond the broadcast bound the components come out the same, also with 300,000 places."""
    many = spark.range(300_000).select(F.lit("city").alias("kind"), F.concat(F.lit("Zq"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit("ovia")).alias("name"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("locality"))
    known = addresses.places(leads(spark))
    texts = addresses._lead_texts(leads(spark)).filter("text is not null").unionByName(spark.createDataFrame([(70, "Zqcdefovia, 8 Nettle Lane", None, None, None)], "id bigint, text string, city_hint string, locality_hint string, post_hint string"))
    rows = lambda df: sorted(map(tuple, df.distinct().collect()), key=repr)
    assert rows(addresses.read_addresses(texts, known)) == rows(addresses.read_addresses(texts, known, broadcast_rows=0))
    got = rows(addresses.read_addresses(texts, known.unionByName(many)))
    assert (70, "8", "nettle", "lane", None, "zqcdefovia", None, None) in got and len(got) == len(rows(addresses.read_addresses(texts, known)))


def test_assignment_prefers_the_cheaper_reading():
    g = postal.Gazetteer(["Millford", "Otherton"], ["North Quay", "Southfields"], ["Land"], {})
    assert postal.read("Shop 3B, 45A Teal Lane S.fields Milford", g) == ("45a", "teal", "lane", "southfields", "millford", None, "3b")
    assert postal.read("Otherton, 7 Teal", g)[:5] == ("7", "teal", None, None, "otherton")
    assert postal.read("", g) == postal.read(None, g) == (None,) * 7


def test_categories(spark):
    ref = spark.createDataFrame([(9, "Bakery", "Food"), (26, "Car Repair", "Motor"), (13, "Catering Service", "Food"), (1, "Dental Clinic", "Health")], "category_id int, category_name string, vertical string")
    values = ["Bakery", "bakrey", "BAKERY near me", "category: bread shop", "Repair, Car", "carrepair", "Dent. Clinic", "Tooth Doctor - Millford", "zahnarztpraxis", "Catering Services in Eastgate", "b4kery", "Best Bakery in Millford", "Car Museum", "Quarry", "?", "", None, "   "]
    maps = spark.createDataFrame([(i, None, "bakery in Millford, Land", v) for i, v in enumerate(values)], MAPS)
    got = {r["record_no"]: r["category_id"] for r in categories.map_categories(maps, leads(spark), ref).collect() if r["table_name"] == "maps_listing"}
    want = [9, 9, 9, 9, 26, 26, 1, 1, 1, 13, 9, 9, 0, 0, 0]
    assert [got.get(i) for i in range(len(values))] == want + [None] * 3
    lead = {r["record_no"]: r["category_id"] for r in categories.map_categories(maps, leads(spark), ref).collect() if r["table_name"] == "lead_row"}
    assert lead == {1: 9, 2: 9, 5: 0, 6: 0}


def test_learned_names_and_noise(spark):
    ref = spark.createDataFrame([(1, "Bakery", "F"), (2, "Plumber", "T"), (3, "Florist", "R")], "category_id int, category_name string, vertical string")
    rows = [(i, None, "bakery in A, L", "Krustenhaus") for i in range(5)] + [(10 + i, None, f"{c} in A, L", "Miscellanea") for i, c in enumerate(["bakery", "plumber", "florist"] * 4)] + [(50, None, "plumber in A, L", "krustenhuas")]
    got = {r["record_no"]: r["category_id"] for r in categories.map_categories(spark.createDataFrame(rows, MAPS), leads(spark).limit(0), ref).collect()}
    assert {got[i] for i in range(5)} == {1} and {got[10 + i] for i in range(12)} == {0} and got[50] == 1


def test_categories_without_a_list_of_other_names(spark):
    """The listings' own searches teach the names that no list gives; one careless search more doesn't matter."""
    ref = spark.createDataFrame([(1, "Bakery", "F"), (2, "Plumber", "T")], "category_id int, category_name string, vertical string")
    rows = [(i, None, "bakery in A, L", "Panadería") for i in range(12)] + [(20, None, "plumber in A, L", "Panaderia")] + [(30 + i, None, "plumber in A, L", "Fontanero") for i in range(2)]
    got = lambda names: {r["record_no"]: r["category_id"] for r in categories.map_categories(spark.createDataFrame(rows, MAPS), leads(spark).limit(0), ref, other_names=names).collect()}
    taught, listed = got({}), got(None)
    assert {taught[i] for i in (*range(12), 20)} == {1} and taught[30] == 0 and listed[30] == 2


def test_match_entities(spark):
    a = ("12 Teal Street", "North Quay", "Millford", "410107", "Land")
    b = ("14 Teal Street", "North Quay", "Millford", "410107", "Land")
    rows = [
        (1, "p1", "Corwin Bakery Ltd", "555 123 4567", "corwin.example", a), (2, "p2", "CORWIN BAKREY", "+91-5551234567", None, a), (3, "p3", "Corwin Bakery - Millford", "5559876543", None, a),  # same, one changed its number
        (4, "p1", "Corwin Bakery", "555 222 3333", "corwin.example", b), (5, "p2", "Corwin Bakery", "555 222 3333", None, b),  # a branch next door
        (6, "p2", "Dunmore Florist", "555 123 4567", "corwin.example", a), (7, "p1", None, None, None, None), (8, "p3", "", "555 123 4567", None, None),  # shares phone, site and building only
    ]
    df = spark.createDataFrame(rows + rows[:2], ENT)
    got = {(r["left_no"], r["right_no"]): r["confidence"] for r in linkage.match_entities(df, leads(spark)).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3), (4, 5)} and all(0.5 <= c <= 1 for c in got.values())
    assert linkage.match_entities(df.limit(0), leads(spark)).count() == 0


def test_match_in_a_crowded_block(spark):
    town = (None, "North Quay", "Millford", "410107", "Land")
    names = ["Ashby", "Brunel", "Cavell", "Darrow", "Elgin", "Fenwick", "Garrick", "Hollis", "Ibsen", "Jarrow", "Kelso", "Lomond"]
    rows = [(10 + i, "p1", f"{n} Bakery", f"55500000{i:02}", None, (f"{20 + i} Teal Street", *town[1:])) for i, n in enumerate(names)]
    rows += [(1, "p1", "Wolverton Bakery", "5551234567", None, town), (2, "p2", "Wolv Bakery", None, None, town), (3, "p3", "Zeller Florist", None, None, town)]
    got = {(r["left_no"], r["right_no"]) for r in linkage.match_entities(spark.createDataFrame(rows, ENT), leads(spark)).collect()}
    assert got == {(1, 2)}


def test_closure_takes_whole_groups(spark, monkeypatch):
    def matched(providers):
        rows = [(i, i + 1, providers[i - 1], providers[i], 0.9) for i in range(1, len(providers))]
        marginals = spark.createDataFrame(rows, "l int, r int, lp string, rp string, probability double")
        for f, x in (("prepared", marginals), ("candidates", None), ("scored", None), ("believe", marginals)):
            monkeypatch.setattr(linkage, f, lambda *_, x=x: x)
        return {(r["left_no"], r["right_no"]) for r in linkage.match_entities(None, None).collect()}

    assert matched("ABCDA") == {(1, 2), (2, 3), (3, 4), (4, 5)}  # two records of A: direct pairs only
    assert matched("ABCDEFGHIJ") == {(i, j) for i in range(1, 11) for j in range(i + 1, 11)}


def test_beliefs_match_enumeration(spark):
    import itertools
    import math

    pairs = [(1, 11, 2.0), (1, 12, 1.0), (2, 11, 1.5), (2, 13, -1.0), (3, 12, 0.5)]  # a chain: beliefs are exact
    df = spark.createDataFrame([(l, r, "a", "b", t) for l, r, t in pairs], "l int, r int, lp string, rp string, theta double")
    got = {(r["l"], r["r"]): r["probability"] for r in linkage.believe(df, rounds=60, tolerance=1e-9).collect()}
    z, m = 0.0, dict.fromkeys(range(5), 0.0)
    for bits in itertools.product((0, 1), repeat=5):
        on = [pairs[i] for i in range(5) if bits[i]]
        if len({p[0] for p in on}) == len(on) == len({p[1] for p in on}):
            w = math.exp(sum(p[2] for p in on))
            z += w
            for i in range(5):
                m[i] += w * bits[i]
    for i, (l, r, _) in enumerate(pairs):
        assert abs(got[l, r] - m[i] / z) < 1e-4


def test_beliefs_settle_on_long_rival_chains(spark):
    import math

    import pytest

    n, theta = 9, 4.0
    rows = [((i + 1) // 2, 100 + i // 2, "a", "b", theta) for i in range(n)]  # each record contends with the next
    df = spark.createDataFrame(rows, "l int, r int, lp string, rp string, theta double")
    got = {(r["l"], r["r"]): r["probability"] for r in linkage.believe(df).collect()}
    z = [1.0, 1.0]
    for _ in range(n):
        z.append(z[-1] + math.exp(theta) * z[-2])
    for i, (l, r, *_) in enumerate(rows):
        assert abs(got[l, r] - math.exp(theta) * z[i] * z[n - 1 - i] / z[n + 1]) < 0.005
    with pytest.raises(RuntimeError):
        linkage.believe(df, rounds=2)


def test_hopeless_pairs_count_as_mass(spark):
    """Outside the loop they change no verdict and no probability by more than their own odds."""
    rng = random.Random(8)
    rows = [(i, 100 + rng.randrange(30), "p1", "p2", rng.choice([-9.0, -7.0, -6.0, -1.0, 0.5, 2.0, 6.0])) for i in range(30) for _ in range(5)]
    df = spark.createDataFrame(sorted({(l, r): (l, r, a, b, t) for l, r, a, b, t in rows}.values()), "l long, r long, lp string, rp string, theta double")
    got, want = ({(x["l"], x["r"]): x["probability"] for x in linkage.believe(df, hopeless=h).collect()} for h in (linkage.HOPELESS, -1e9))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.01 for k in want)
    assert {k for k in got if got[k] >= 0.5} == {k for k in want if want[k] >= 0.5}


def test_a_phone_of_everybody_is_no_evidence(spark):
    """A number under many names makes no pairs, however many records hold it; a business's own number still does."""
    names = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gorse", "Hazel", "Ivy", "Juniper", "Kapok", "Larch", "Maple", "Nutmeg"]
    rows = [(i, f"p{i % 3}", f"{names[i % 14]} {names[(i * 5 + 3) % 14]} House", "555 000 1111", None, (f"{i + 1} Teal Street", "North Quay", "Millford", "410107", "Land")) for i in range(90)]
    rows += [(900, "p0", "Corwin Bakery", "555 123 4567", None, None), (901, "p1", "Corwin Bakery", "555 123 4567", None, None)]
    prepared = linkage.prepared(spark.createDataFrame(rows, ENT), leads(spark))
    held = {r["record_no"]: r["phone"] for r in prepared.collect()}
    assert all(held[i] is None for i in range(90)) and held[900] == held[901] == "5551234567"
    got = {(r["l"], r["r"]) for r in linkage.candidates(prepared).collect()}
    assert (900, 901) in got


def test_unlike_names_of_a_city_are_counted_not_made(spark, monkeypatch):
    """Nobody's probability changes, though a crowded block's unlike pairs aren't joined (before: all of them were)."""
    monkeypatch.setattr(linkage, "CROWD", 8)
    rng = random.Random(3)
    stems = ["corwin", "dunmore", "ashbury", "kelso", "quilter", "fenwick", "garrick", "wolverton"]
    bend = lambda w: rng.choice([w, w, w[:-1] + "x", w[:4], w[1:] + "q", w[0] + "z" + w[2:]])
    rows = []
    for i in range(220):
        name = " ".join([bend(rng.choice(stems)), *rng.choice([["bakery"], ["dental", "clinic"], ["bakery", "house"], []])])
        town = rng.choice([("Millford", "North Quay", "410107"), ("Otherton", "Eastgate", "420100")])
        line = rng.choice([None, f"{rng.randrange(1, 40)} Teal Street", f"{rng.randrange(1, 40)} Teal Street"])
        rows.append((i, f"p{rng.randrange(4)}", name, rng.choice([None, f"55500000{rng.randrange(90):02}"]), rng.choice([None, None, f"s{rng.randrange(30)}.example"]), (line, town[1], town[0], town[2], "Land")))
    r = linkage.prepared(spark.createDataFrame(rows, ENT), leads(spark)).localCheckpoint()
    found = linkage.candidates(r).localCheckpoint()
    k = r.filter("city is not null").select("record_no", "provider_id", "city", "keys", (F.col("phone").isNull() | F.col("building").isNull()).alias("open"))
    a, b = k.toDF("l", "lp", "city", "lk", "lo"), k.toDF("r", "rp", "city", "rk", "ro")
    block = a.join(b, "city").filter("l < r and lp <> rp and (lo or ro)").filter(F.arrays_overlap("lk", "rk")).select("l", "r")
    every = found.union(block).distinct()
    n, m = found.count(), every.count()
    assert m > 1500 and n < 0.6 * m
    probability = lambda pairs, *x: {(p["l"], p["r"]): p["probability"] for p in linkage.believe(linkage.scored(pairs, r), *x).collect()}
    got, want, untold = probability(found, r), probability(every), probability(found)
    assert got.keys() <= want.keys() and all(want[p] < 1e-4 for p in want.keys() - got.keys())
    assert max(abs(got[p] - want[p]) for p in got) < 1e-12 < max(abs(untold[p] - want[p]) for p in got)
