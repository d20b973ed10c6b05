import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing, packing, tokens, toxicity

LEN = "doc_id bigint, source string, n_tokens bigint"


def lengths(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 1, 5, 30, 90, 200, 700, 3000])) for i in range(n)]


@pytest.mark.parametrize("shard_tokens", [10**9, 20_000])
def test_packing_places_every_token_once(spark, shard_tokens):
    rows = lengths()
    specs = spark.createDataFrame([(1, 512), (2, 2048), (3, 0)], "spec_no int, capacity_tokens int")
    got = packing.pack_documents(spark.createDataFrame(rows, LEN), specs, shard_tokens=shard_tokens).collect()
    for spec, cap in ((1, 512), (2, 2048)):
        mine = [r for r in got if r["spec_no"] == spec]
        pieces = {}
        used = {}
        for r in mine:
            pieces.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
            used[r["container_no"]] = used.get(r["container_no"], 0) + r["n_tokens"]
        assert set(pieces) == {r[0] for r in rows} and max(used.values()) <= cap
        for d, _, n in rows:
            p = sorted(pieces[d])
            assert sum(k for _, k in p) == n and (len(p) == 1 or n > cap) and all(p[i][0] + p[i][1] == p[i + 1][0] for i in range(len(p) - 1))
        least = -(-sum(r[2] for r in rows) // cap)
        assert len(used) <= least * 1.05 + (20 if shard_tokens < 10**6 else 2)
    assert {r["spec_no"] for r in got} == {1, 2}
    assert packing.pack_documents(spark.createDataFrame([], LEN), specs).count() == 0


def test_packing_keeps_the_mixture():
    rng = random.Random(7)
    docs = [(i, "a" if i % 4 else "b", rng.randrange(20, 120)) for i in range(2000)]
    total = sum(d[2] for d in docs)
    share = {s: sum(d[2] for d in docs if d[1] == s) / total for s in "ab"}
    src = {d[0]: d[1] for d in docs}
    boxes = {}
    for box, doc, _, _, n in packing.pack(docs, 2048, share, {}):
        boxes.setdefault(box, {"a": 0, "b": 0})[src[doc]] += n
    off = [abs(b["a"] / sum(b.values()) - share["a"]) for b in boxes.values()]
    assert sum(off) / len(off) < 0.05
    again = packing.pack(list(reversed(docs)), 2048, share, {})
    assert again == packing.pack(docs, 2048, share, {})


def test_long_documents_do_not_fill_containers_alone():
    docs = [(i, "abcd"[i % 4], 100) for i in range(400)] + [(1000 + i, "e", 5000) for i in range(4)]
    share = {s: 10_000 / 60_000 for s in "abcd"} | {"e": 20_000 / 60_000}
    boxes, pieces = {}, {}
    for box, doc, piece, start, n in packing.pack(docs, 512, share, {}):
        boxes.setdefault(box, set()).add(doc >= 1000)
        pieces.setdefault(doc, []).append((piece, start, n))
    assert sum(b == {True} for b in boxes.values()) <= 2
    for d in range(1000, 1004):
        p = sorted(pieces[d])
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == 5000 and all(x[2] >= 16 for x in p[:-1])


def test_mixture_is_reported_beside_its_bound(spark):
    rows = lengths(2000)
    df, specs = spark.createDataFrame(rows, LEN), spark.createDataFrame([(1, 4096)], "spec_no int, capacity_tokens int")
    packed = packing.pack_documents(df, specs)
    off = packing.mixture(packed, df)
    r = packing.mixture_report(off, df, specs).first()
    assert 0 <= r["least_possible"] <= r["mean_deviation"] < 1
    target = {s: sum(n for _, x, n in rows if (x or "") == s) / sum(n for _, _, n in rows) for s in ("a", "b", "")}
    source, held = {i: s or "" for i, s, _ in rows}, {}
    for x in packed.collect():
        box = held.setdefault(x["container_no"], {})
        box[source[x["doc_id"]]] = box.get(source[x["doc_id"]], 0) + x["n_tokens"]
    want = {b: sum(abs(box.get(s, 0) / sum(box.values()) - p) for s, p in target.items()) / 2 for b, box in held.items() if sum(box.values())}
    got = {x["container_no"]: x["deviation"] for x in off.collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-5 for b in want)


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 40 + [None] * 30 + ["other"] * 20)] + [(5000, "big", 0)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(rows, LEN)
    for buckets in (10**6, 50):
        mixed = mixing.mix(df, targets, bucket_rows=buckets)
        got = mixed.collect()
        uses = {}
        for r in got:
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        cap = {"big": 1, "mid": 2, "small": 4}
        src = {r[0]: r[1] for r in rows}
        assert all(n <= cap[src[d]] for d, n in uses.items()) and 5000 not in uses
        share = {r["source"]: r["reached_share"] for r in mixing.reached(mixed, df, targets).collect()}
        assert abs(share["big"] - 0.6) < 0.03 and abs(share["mid"] - 0.3) < 0.03 and abs(share["small"] - 0.1) < 0.03 and share["none"] == 0
        at = [r["position"] for r in got]
        assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    early = [r for r in got if r["position"] < 0.25]
    late = [r for r in got if r["position"] >= 0.75]
    part = lambda xs: sum(r["n_tokens"] for r in xs if r["source"] == "big") / sum(r["n_tokens"] for r in xs)
    assert part(early) > part(late)
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_positions_invert_the_schedule(spark):
    rows = [(float(u), b) for u in (0, 10, 50, 90, 100) for b in (-0.5, 0.0, 0.4)]
    df = spark.createDataFrame(rows, "c double, bend double")
    t = F.col("t")
    back = df.withColumn("t", mixing.position(F.col("c"), F.lit(100.0), F.col("bend"))).select("c", (100 * (t + F.col("bend") * (t * t - t))).alias("x"))
    assert all(abs(r["c"] - r["x"]) < 1e-6 for r in back.collect())


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files here")
def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 9), (1, "a b c", "s", 9), (2, None, None, 9), (3, "", "s", 9), (4, "<|endoftext|>" * 50, "s", 9)], "doc_id bigint, text string, source string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_lengths(df).collect()}
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 50


def toy(n, seed):
    rng = random.Random(seed)
    bad = ["you are a stupid {x} and a loser", "go away you filthy {x}", "i will hurt you {x}"]
    good = ["we open at {n} on monday", "our {y} range arrives today", "parking is free for {n} cars", "the staff were kind and {y}", "book {y} online now"]
    out = []
    for _ in range(n):
        ws = [rng.choice(good).format(n=rng.randrange(99), y=rng.choice(["blue", "green", "soft"])) for _ in range(4)]
        y = rng.random() < 0.3
        if y:
            ws[rng.randrange(4)] = rng.choice(bad).format(x=rng.choice(["idiot", "moron", "pig"]))
        out.append((y, ". ".join(ws) + "."))
    return out


def test_toxicity_on_held_out_documents():
    train, test = toy(300, 1), toy(200, 2)
    docs = [(y, toxicity.windows(t)) for y, t in train]
    held = [x for k in range(toxicity.FOLDS) for x in toxicity.held_out(docs, None, 16_384, k)]
    assert len(held) == len(docs)
    s = toxicity.Scorer(toxicity.train(docs))
    scores = [(s.document(toxicity.windows(t)), y) for y, t in test]
    limit = toxicity.threshold(held, Counter(v for v, _ in scores))
    assert sum((v >= limit) == y for v, y in scores) / len(scores) > 0.95
    assert s.document([]) == -1.0
    assert toxicity.threshold([], {}) == 2.0


def test_wrong_verdicts_do_not_blind_the_dictionaries():
    """A tenth of the verdicts is wrong, in either direction."""
    rng = random.Random(3)
    train, test = toy(600, 1), toy(200, 2)
    docs = [(y ^ (rng.random() < 0.1), toxicity.windows(t)) for y, t in train]
    s = toxicity.Scorer(toxicity.train(docs))
    scores = sorted(((s.document(toxicity.windows(t)), y) for y, t in test), reverse=True)
    assert toxicity.best_f1(scores) > 0.9


def test_common_windows_of_harmful_documents_are_acquitted():
    corpus = toxicity.Corpus(100_000, {"story time every monday": 300, "rare and vile": 15, "once": 1})
    bad = Counter({"story time every monday": 2, "rare and vile": 5, "once": 1})
    assert toxicity.chance("story time every monday", bad, 800, corpus)
    assert not toxicity.chance("rare and vile", bad, 800, corpus) and not toxicity.chance("once", bad, 800, corpus)


def test_windows_undo_disguises():
    assert toxicity.windows("You 1d1ot! S.t.u.p.i.d coooow") == ["you idiot", "stupid cow"]
    assert len(toxicity.windows("word " * 100)) > 5 and toxicity.windows("") == []


def test_scores_and_rates(spark):
    docs = toy(120, 5)
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1) for i, (_, t) in enumerate(docs)] + [(500, None, "s", 1), (0, docs[0][1], None, 1)], "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(i, "r", "harmful" if y else "fine") for i, (y, _) in enumerate(docs[:80])] + [(3, "q", "unsure")], "doc_id bigint, reviewer string, verdict string")
    scored = toxicity.score_documents(df, labels)
    assert scored.count() == 121 and scored.filter("doc_id = 500").first()["score"] == -1.0
    assert {r["source"]: r["documents"] for r in toxicity.rates(scored).collect()} == {"s": 61, None: 60}
    assert toxicity.score_documents(df.limit(0), labels.limit(0)).count() == 0


def test_fitting_sample_is_bounded_in_documents_and_windows(spark):
    docs = spark.createDataFrame([(i, "s", [f"w{i} {k}" for k in range(4)]) for i in range(40)] + [(99, "s", ["x"] * 50)], "doc_id bigint, source string, ws array<string>")
    labels = spark.createDataFrame([(i, "r", "fine") for i in range(40)] + [(99, "r", "harmful")], "doc_id bigint, reviewer string, verdict string")
    assert len(toxicity.labelled(docs, labels)) == 41
    assert len(toxicity.labelled(docs, labels, most=10)) <= 10
    few = toxicity.labelled(docs, labels, most_windows=100)
    assert sum(len(ws) for _, ws in few) <= 100 and all(not y for y, _ in few)
