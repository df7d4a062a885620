"""Near-dedup in runs of texts that share a sketch: no pair of a run is left out."""

import random

import numpy as np

from tracksieve.llm import near_dedup


def _groups(texts):
    """Smallest id of the component of every id, over all near pairs that share a sketch."""
    words = {i: near_dedup.word_hashes(t) for i, t in texts.items()}
    keys = {i: set(near_dedup.sketches(w).tolist()) for i, w in words.items()}
    group = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and keys[i] & keys[j] and near_dedup.near_words(words[i], words[j])]
    for _ in texts:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group, links


def _templated(draw, families):
    """Pairs of texts that share only a template's sketches, with all the others too: every fourth word of their own part is changed."""
    template, texts = [f"t{i}" for i in range(120)], {}
    for family in range(families):
        own = [f"f{family}w{i}" for i in range(60)]
        for member in (0, 1):
            texts[member * families + family] = " ".join(template + [f"m{family}x{i}" if member and i % 4 == 1 else w for i, w in enumerate(own)])
    order = draw.sample(range(2 * families), 2 * families)
    return {order[i]: t for i, t in texts.items()}


def test_near_texts_far_apart_in_a_run_meet(spark, monkeypatch):
    texts = _templated(random.Random(4), 60)
    want, links = _groups(texts)
    assert len(links) == 60
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.copy_of for r in near_dedup.group_copies(df).collect()} == want
    monkeypatch.setattr(near_dedup, "MEMBERS", 16)  # runs of several blocks
    assert {r.doc_id: r.copy_of for r in near_dedup.group_copies(df).collect()} == want


def test_large_group_of_near_copies_in_rounds(spark, monkeypatch):
    draw = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(300):
        words = list(base)
        for at in draw.sample(range(120), draw.randrange(1, 16)):
            words[at] = f"x{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {i + 1000: t for i, t in _templated(draw, 20).items()}
    want, _ = _groups(texts)
    df = spark.createDataFrame([(f"{i:05}", t) for i, t in texts.items()], "doc_id string, text string")
    for members, many in ((4096, 2), (64, 0)):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        monkeypatch.setattr(near_dedup, "MANY", many)
        got = {int(r.doc_id): int(r.copy_of) for r in near_dedup.group_copies(df).collect()}
        assert got == want


def test_bounds_lose_no_near_pair():
    draw = random.Random(6)
    texts = []
    for length in (1, 5, 90, 700, 3000):
        base = [f"w{draw.randrange(length)}" for _ in range(length)]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randrange(length // 4 + 1)):
                at = draw.randrange(len(words))
                words[at:at + 1] = draw.choice([[], ["new"], [words[at], f"w{draw.randrange(length)}"]]) or ["z"]
            texts.append(near_dedup.word_hashes(" ".join(words)))
    for each, widest in ((3, 8192), (32, near_dedup.WIDEST)):
        bits = np.array([near_dedup.signature(w, each, widest) for w in texts] + [None], dtype=object)[:-1]
        every = near_dedup.side(np.arange(len(texts)), np.array([len(w) for w in texts]), np.arange(len(texts)), bits)
        found = {(int(a), int(b)) for i, j, _ in near_dedup.close_pairs(every, None, 0.8) for a, b in zip(i, j)}
        assert {(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.near_words(texts[i], texts[j])} <= found
        half = [near_dedup.side(s, every.n[s], every.of[s], bits[s]) for s in (np.arange(0, 30), np.arange(30, 60))]
        across = {(int(half[1].ids[a]), int(half[0].ids[b])) for i, j, _ in near_dedup.close_pairs(*half, 0.8) for a, b in zip(i, j)}
        assert across == {(i, j) for i, j in found if i >= 30 > j}
