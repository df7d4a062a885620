"""Token counts against the tokenizer library itself, text by text."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracksieve.llm.token_counts import count_tokens, op11_token_counts, pre_tokens, special_strings, _unassigned

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


def expected(rows, limit=512):
    library = Tokenizer.from_file(PATH)
    out = []
    for ident, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        out.append((ident, len((text or "").encode()), n, n > limit))
    return sorted(out, key=repr)


def test_every_code_point_splits_as_in_the_library():
    library = Tokenizer.from_file(PATH).pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for known in (True, False):
        some = [c for c in points if known != _unassigned()[c]]
        for start in range(0, len(some), 50_000):
            text = "".join(f"x{chr(c)}9{chr(c)}! {chr(c)}{chr(c)}" for c in some[start:start + 50_000])
            assert list(pre_tokens(PATH, text)) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_query_equals_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_token_counts(spark, SMALL).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_cases(spark, block):
    special = special_strings(PATH)[0]
    rows = [(1, None), (2, ""), (None, "a null id"), (3, f"a {special}{special} b  c{special}"), (4, "twice"), (4, "twice"), (4, "other"),
            (5, " \n\n  x'll 12é  　 \U0001f600́ end  "), (6, "it's " * 900), (7, special), (8, "<|endoftext" + special[:-1]), (9, "z" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = df.withColumns({c: F.lit("x") for c in ("id", "block", "words", "n_tokens", "n_bytes", "place")})
    got = count_tokens(clash, PATH, block_chars=block)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_long_text_is_streamed(spark):
    text = "Zwei Wörter, 34 and 'tis so. \n" * 60_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert sorted(map(tuple, count_tokens(df, PATH).collect()), key=repr) == expected([(1, text), (2, "short")])


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id string, text string"), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        special_strings(public_tokenizers.path("word_bpe_49k.json"))
