"""op6: the model against Kneser-Ney written out, rows without letters, ids and languages."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from tracksieve.llm import language_id as li

DOCS = [("the cat sat on the mat", "en"), ("The hat, the cat; the end?", "en"), ("der Hund und die Katze", "de"), ("das ist der Hund 12 und", "de"), ("ein Haus", None), (None, "de")]
SCHEMA = "doc_id bigint, text string, lang string"


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [(x[i - 2], x[i - 1], x[i]) for w in words for x in ["  " + w + " "] for i in range(2, len(x))]


def brute(texts, letters):
    """p(c | a, b) by the definition."""
    three = Counter(g for t in texts for g in grams(t))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def level(counts, below):
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        d = min(ones / (ones + 2 * twos) if ones else 0.5, 0.95)
        sums, kinds = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            sums[g[:-1]] += n
            kinds[g[:-1]] += 1

        def p(g):
            if not sums[g[:-1]]:
                return below(g[1:])
            return (max(counts.get(g, 0) - d, 0) + d * kinds[g[:-1]] * below(g[1:])) / sums[g[:-1]]
        return p

    return level(three, level(two, level({(c,): n for c, n in one.items()}, lambda _: 1 / (letters + 1))))


def test_the_model_is_kneser_ney_as_defined(spark):
    model = li.learn(spark.createDataFrame([(i, *d) for i, d in enumerate(DOCS)], SCHEMA), "text", "lang")
    by = {x: [t for t, y in DOCS if y == x and t] for x in ("de", "en")}
    letters = len({c for ts in by.values() for t in ts for _, _, c in grams(t)})
    probes = ["the cat und", "zebra", "hhu ünd Ж", "x"]
    total, n = model.score([*probes, None, "12 !"])
    assert model.labels == ["de", "en"] and list(n) == [*[len(grams(p)) for p in probes], 0, 0]
    for j, x in enumerate(model.labels):
        p = brute(by[x], letters)
        for i, text in enumerate(probes):
            assert total[i, j] == pytest.approx(sum(math.log(p(g)) for g in grams(text)), abs=1e-9)


def test_shares_of_a_context_add_up_to_one(spark):
    model = li.learn(spark.createDataFrame([(i, *d) for i, d in enumerate(DOCS)], SCHEMA), "text", "lang")
    key = (ord("t") << 2 * li.BITS) | (ord("h") << li.BITS)
    every = li.np.asarray([key | int(c) for c in model.keys[0]])
    assert li.np.allclose(li.np.exp(model.log_p(every)).sum(axis=0) + li.np.exp(model.log_p(li.np.asarray([key | 0x416])))[0], 1.0)


def test_pieces_do_not_change_a_score(spark, monkeypatch):
    model = li.learn(spark.createDataFrame([(i, *d) for i, d in enumerate(DOCS)], SCHEMA), "text", "lang")
    texts = ["the cat sat on a mat und der Hund", None, "", "die Katze"]
    whole = model.score(texts)
    monkeypatch.setattr(li, "PIECE", 9)
    assert all(li.np.allclose(x, y) for x, y in zip(whole, model.score(texts)))


def test_query_learns_from_its_rows_only_and_returns_every_row(spark, tmp_path):
    held = [i for i in range(60) if crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "der hund und die katze" if i % 2 else "the cat and the dog", "xx" if i in held else ("de" if i % 2 else "en")) for i in range(60)]
    rows += [(100, None, "en"), (101, "12 ?", "en"), (None, "the dog", "yy"), (102, "die katze", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in li.op6_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 64
    assert all(got[i].held_out == (crc32(str(i).encode()) % 5 == 0) and got[i].lang_pred == ("de" if i % 2 else "en") and 0 < got[i].score <= 1 for i in range(60))
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2
    assert got[None].lang_pred == "en" and got[102].lang_pred == "de"


def test_without_any_language_all_are_undecided(spark, tmp_path):
    spark.createDataFrame([(1, "the cat", None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.lang_pred, r.score) for r in li.op6_language_id(spark, str(tmp_path)).collect()] == [("und", 0.0)]
