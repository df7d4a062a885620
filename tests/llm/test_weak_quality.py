"""op9: the label model, the sums of one pass against NumPy over all rows, and rows without words."""

import itertools

import numpy as np

from tracksieve.llm import weak_quality as wq

SCHEMA = "doc_id bigint, text string"


def texts():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdlmn" for b in "aeio" for c in ("r", "st", "n")] + ["the", "of", "and", "in"] * 6
    good = [". ".join(" ".join(rng.choice(words, 12)) for _ in range(12)) for _ in range(60)]
    symbols = [" ".join(rng.choice(["#$%", "x&|", "<>*", "q%"], 120)) for _ in range(10)]
    repeated = ["\n".join(["the last of the end in the barn"] * 20) for _ in range(10)]
    return good, symbols + repeated


def test_em_finds_how_far_rules_are_to_be_believed():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = np.asarray([0.95, 0.9, 0.85, 0.9])  # chance to vote the truth
    cast = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    cast[rng.random((20000, 4)) < 0.2] = 0
    patterns = np.asarray(list(itertools.product((-1, 0, 1), repeat=4)))
    counts = np.asarray([(cast == p).all(axis=1).sum() for p in patterns])
    good = wq.believed(patterns, counts)
    at = {tuple(p): i for i, p in enumerate(patterns)}
    guess = np.asarray([good[at[tuple(c)]] > 0.5 for c in cast])
    assert (guess == truth).mean() > 0.96
    assert good[at[1, 1, 1, 1]] > 0.99 > 0.01 > good[at[-1, -1, -1, -1]]


def test_one_pass_has_the_sums_of_all_rows(spark):
    good, bad = texts()
    rows = wq.judged(spark.createDataFrame(list(enumerate([*good, *bad])), SCHEMA).repartition(5), "text", ["doc_id"])
    held = rows.toPandas()
    x = wq._features(list(held["text"]), [held[c].to_numpy() for c in wq.DENSE])
    cells = wq.sums(rows, "text").toPandas()
    half = cells[cells["i"] >= 0]
    assert np.allclose((x.T @ x)[half["i"], half["j"]], half["x"]) and len(half) == wq.WIDTH * (wq.WIDTH + 1) // 2
    for name, part in cells[cells["i"] < 0].groupby("pattern"):
        assert np.allclose(part.sort_values("j")["x"], x[(held["pattern"] == name).to_numpy()].sum(axis=0))
    weights, known = wq.learn(rows, "text")
    y = held["pattern"].map(known).to_numpy()
    assert np.allclose(weights, np.linalg.solve(x.T @ x + wq.RIDGE * len(x) * np.eye(wq.WIDTH), x.T @ y), atol=1e-6)


def test_features_do_not_depend_on_pieces_or_neighbours(monkeypatch):
    rows = ["the cat sat on a mat", None, "", "x", "a b c d e f g h"]
    zeros = [np.zeros(5)] * len(wq.DENSE)
    whole = wq._features(rows, zeros)
    assert np.allclose(whole[3], wq._features(["x"], [np.zeros(1)] * len(wq.DENSE))[0])
    monkeypatch.setattr("tracksieve.llm.language_id.PIECE", 30)
    assert np.allclose(whole, wq._features(rows, zeros))


def test_query_keeps_what_no_rule_accuses_and_returns_every_row(spark, tmp_path):
    good, bad = texts()
    rows = [*enumerate([*good, *bad]), (None, good[0]), (900, None), (901, ""), (0, bad[0])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = wq.op9_weak_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_words > 0 and r.weak_label > 0.5): r for r in got}
    assert all(by[i, True].kept and by[i, True].score > 0.8 for i in range(1, len(good)))
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= len(good))
    assert sorted(r.kept for r in got if r.doc_id == 0) == [False, True] and next(r.kept for r in got if r.doc_id is None)


def test_an_empty_table_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert wq.op9_weak_quality(spark, str(tmp_path)).collect() == []
