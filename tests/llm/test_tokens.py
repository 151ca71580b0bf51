import random

import pytest
import tiktoken

from quern.llm import tokens as K


@pytest.fixture(scope="module")
def both():
    ranks = K.read_ranks(K.vocab_path())
    return K.Encoder(ranks, K.pattern()), tiktoken.Encoding("own", pat_str=K.pattern(), mergeable_ranks=ranks, special_tokens={}), ranks


def test_like_the_public_encoder(both, spark, sf):
    enc, ref, _ = both
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    rnd = random.Random(2)
    texts += ["a" * 5000, "ab" * 3000, "<|endoftext|>", "​\U0001f600é" * 40, " \n\t  x", *("".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF)])) for _ in range(80)) for _ in range(60))]
    assert [enc.encode(t) for t in texts] == [ref.encode_ordinary(t) for t in texts]


def test_round_trip_and_cache(both):
    enc, ref, ranks = both
    back = {v: k for k, v in ranks.items()}
    text = "Größe, naïve café — 12345 don't"
    for _ in range(2):
        assert b"".join(back[i] for i in enc.encode(text)).decode() == text
    assert enc.encode(None) == enc.encode("") == []


def test_segment_tree_like_a_scan():
    rnd = random.Random(4)
    ranks = [rnd.randint(0, 9) for _ in range(37)]
    tree = K.SegmentTree(list(ranks))
    for _ in range(200):
        assert tree.least() == ranks.index(min(ranks))
        at = rnd.randrange(37)
        ranks[at] = rnd.randint(0, 9)
        tree.put(at, ranks[at])


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "hi there")], "doc_id long, text string").selectExpr("*", "1 as ids")
    assert sorted((r.doc_id, len(r.ids)) for r in K.encode(df).collect()) == [(1, 0), (2, 0), (2, 0), (3, 2)]
    assert K.encode(df.limit(0)).collect() == []
