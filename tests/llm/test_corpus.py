"""Near-dedup and packing: small cases and brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracksieve.llm import near_dedup, packing


def _words(rng, n, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_banded_distance_by_brute_force():
    def whole(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    rng = random.Random(1)
    for _ in range(2000):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(4) for _ in range(rng.randrange(4))]
        most = rng.randrange(12)
        assert near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(whole(a, b), most + 1)


def _pairs(texts):
    return {(i, j) for i in texts for j in texts if i < j and near_dedup.near(texts[i], texts[j])}


def _groups(texts):
    """Smallest id of the component of every id, by brute force over all pairs."""
    group = {i: i for i in texts}
    for _ in texts:
        for i, j in _pairs(texts):
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_groups_equal_all_pairs_on_texts_that_share_a_template(spark):
    draw = random.Random(11)
    template = [f"t{i}" for i in range(110)]
    texts = {}
    for family in range(40):
        base = list(template)
        for at in draw.sample(range(110), 60):
            base.insert(at, f"f{family}w{at}")
        for member in (0, 1):
            words = list(base)
            for at in draw.sample(range(len(words)), 8 * member):
                words[at] = f"x{family}y{at}"
            texts[member * 40 + family] = " ".join(words)
    want = _pairs(texts)
    assert len(want) == 40
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.copy_of for r in near_dedup.group_copies(df).collect()}
    assert sum(got[j] == i for i, j in want) >= 39  # sketches are a sample: a link is found with high probability
    assert all(got[i] in (i, i - 40) for i in texts)


def test_null_repeated_long_and_clashing_rows_and_one_text_many_times(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    words = [f"v{i}" for i in range(60)]
    rows = [(None, long, 1), (None, long, 2), (5, long, 3), (3, long + " end", 4), (5, long, 5), (8, None, 6), (9, "", 7), (10, " \t", 8), (11, "a b", 9), (12, "a b", 10)]
    rows += [(100 + i, " ".join(words), 0) for i in range(300)] + [(1000 + i, " ".join([*words[:i % 60], f"z{i}", *words[i % 60:]]), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _group int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = {(r.doc_id, r._group): (r.copy_of, r.kept) for r in near_dedup.group_copies(df).collect() if r.doc_id is None or r.doc_id < 100}
            assert got == {(None, 1): (None, True), (None, 2): (None, True), (5, 3): (3, False), (3, 4): (3, True), (5, 5): (3, False), (8, 6): (8, True),
                           (9, 7): (9, True), (10, 8): (10, True), (11, 9): (11, True), (12, 10): (11, False)}
            kept = sorted(r.doc_id for r in near_dedup.drop_copies(df).collect() if r.doc_id is not None)
            assert kept == [3, 8, 9, 10, 11, 100]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_near_copies_meet_and_others_stay(spark):
    rng = random.Random(2)
    base, other = _words(rng, 200), _words(rng, 200)
    edited = base[:50] + ["new"] + base[51:120] + base[122:]
    passage = _words(rng, 60)  # shared by texts that are not copies
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(edited)), (4, " ".join(other)), (5, None), (6, ""), (7, " \n"), (8, " ".join(reversed(base))),
            (9, "one"), (10, "one")] + [(20 + i, " ".join(passage + _words(rng, 90))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = {r["doc_id"]: (r["copy_of"], r["kept"]) for r in near_dedup.group_copies(df).collect()}
    assert len(got) == len(rows)
    assert {i: g for i, g in got.items() if not g[1]} == {2: (1, False), 3: (1, False), 10: (9, False)}
    assert near_dedup.group_copies(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "_a long, _b long")
    assert {r["_id"]: r["_group"] for r in near_dedup.components(edges).collect()} == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def _check_bins(rows, largest):
    bins = {}
    for r in rows:
        if r["size"]:
            bins.setdefault(r["bin"], []).append(r)
        else:
            assert r["bin"] is None and r["capacity"] is None
    for inside in bins.values():
        end = 0
        for r in sorted(inside, key=lambda r: r["start"]):
            assert r["start"] == end
            end += r["size"]
        assert all(r["filled"] == end and r["capacity"] == min(c for c in packing.CAPACITIES if c >= end) for r in inside)
    return bins


def test_packing_loses_nothing(spark):
    rng = random.Random(3)
    texts = ["  " + "\n".join(_words(rng, n)) + " " for n in [0, 1, 2047, 2048, 2049, 5000, *[rng.randrange(1, 900) for _ in range(120)]]] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bin", F.lit("clash"))
    rows = packing.pack(df, ["doc_id"]).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        whole[r["doc_id"]] = whole[r["doc_id"]] + r["text"] if r["piece"] else r["text"]
        assert r["size"] == len((r["text"] or "").split())
    assert whole == dict(enumerate(texts))
    bins = _check_bins(rows, 2048)
    assert len(bins) <= 1.05 * sum(r["size"] for r in rows) / 2048 + 1
    assert packing.pack(df.limit(0), ["doc_id"]).count() == 0
