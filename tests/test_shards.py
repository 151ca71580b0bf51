import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.vocab import Vocabulary, packed, unpacked
from quern.sources import shards as K
from quern.sources import writers

PIECES = ["<unk>", "<s>", "</s>", *[f"<0x{b:02X}>" for b in range(256)], "▁", *"abcdlo", "lo", "▁a", "ab", "abc", "▁ab", "oo"]
SCORES = [0.0] * 259 + [-9.0] * 7 + [-3.0, -2.0, -1.0, -0.5, -4.0, -3.0]


def brute(v, text):
    """The best-scored pair, leftmost, merged until none is left."""
    sym = [(c if c in v.ids else bytes([b])) for c in ("▁" + text.replace(" ", "▁")) for b in ([0] if c in v.ids else c.encode())]
    while True:
        best = None
        for i in range(len(sym) - 1):
            if isinstance(sym[i], str) and isinstance(sym[i + 1], str) and (k := v.ids.get(sym[i] + sym[i + 1])) is not None and (best is None or v.scores[k] > best[0]):
                best = (v.scores[k], i)
        if best is None:
            return [v.ids[s] if isinstance(s, str) else 3 + s[0] for s in sym]
        sym[best[1] : best[1] + 2] = [sym[best[1]] + sym[best[1] + 1]]


def test_scored_pieces():
    import random

    v, rnd = Vocabulary(PIECES, SCORES), random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("abcdlo é") for _ in range(rnd.randint(1, 12)))
        assert v.encode(t) == brute(v, t) and v.decode(v.encode(t)) == t
    assert v.encode("") == v.encode(None) == [] and v.encode("", True) == [1] and v.decode([0, 1, 99999]) == ""
    assert [(p, s) for _, p, s in unpacked(packed(PIECES, SCORES))] == list(zip(PIECES, SCORES))
    with pytest.raises(ValueError):
        unpacked(packed(PIECES, SCORES)[:-1])


def test_vocabulary_and_token_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(packed(PIECES, SCORES))
    assert K.vocabulary(spark, str(tmp_path / "v.bin")).where("piece = 'abc'").collect()[0].id == PIECES.index("abc")
    ids = np.array([9, 1, 5, 6, 1, 7, 1, *[8] * 20, 1, 4], "<u2")
    (tmp_path / "d.bin").write_bytes(ids.tobytes())
    assert [tuple(r)[1:] for r in K.token_rows(spark, str(tmp_path / "d.bin"), 1, 10).orderBy("row").collect()] == [(0, [1, 5, 6]), (1, [1, 7]), (3, [1, 4])]


def test_windows(spark, tmp_path):
    path = str(tmp_path / "w")
    good = [(i, [1, 2, 3, 4], [-1, 2, 3, -1]) for i in range(20)]
    df = spark.createDataFrame(good, "id int, ids array<int>, tgt array<int>")
    K.write_windows(df, path, "train", 4, 10)
    assert K.window_faults(spark, path, "train", 4, 10).collect() == []
    assert {r.fault for r in K.window_faults(spark, path, "train", 5, 3).collect()} == {"ids_length", "ids_range", "targets_range", "other_length", "other_vocabulary"}
    bad = spark.createDataFrame([(1, [1, 2, 3, 4], [-1] * 4), (2, [1, 2, 3, 11], [1, 2, 3]), (3, [1, 2, 3, 4], [-2, 1, 1, 1])], df.schema)
    K.write_windows(bad, path, "val", 4, 10)
    assert {r.fault: r.n for r in K.window_faults(spark, path, "val", 4, 10).collect()} == {"all_masked": 1, "targets_length": 1, "ids_range": 1, "targets_range": 1}
    (tmp_path / "w" / "meta.json").unlink()
    assert "unfinished" in {r.fault for r in K.window_faults(spark, path, "train", 4, 10).collect()}
    got = K.random_windows(df, "id", 200, 5, trim=True).collect()
    assert sorted(r.draw for r in got) == list(range(200)) and all(r.ids == [1, 2, 3] and r.tgt == [-1, 2, 3] for r in got) and len({r.id for r in got}) > 15
    assert K.random_windows(df.limit(0), "id", 5, 1).count() == 0


def test_tables_beside_each_other(spark, tmp_path):
    base = spark.createDataFrame([(i, f"k{i}") for i in range(500)], "i int, key string")
    writers.keyed(base, str(tmp_path / "keyed"), "key", 2)
    keys = spark.createDataFrame([("k3",), ("k3",), ("zz",), (None,)], "key string")
    assert [r.i for r in K.lookup(spark, str(tmp_path / "keyed"), keys, "key").collect()] == [3]
    assert K.lookup(spark, str(tmp_path / "keyed"), base, "key").count() == 500
    K.write_alias(base.limit(3), base, str(tmp_path / "alias"))
    assert K.read_alias(spark, str(tmp_path / "alias"), base).count() == 3
    with pytest.raises(ValueError):
        K.read_alias(spark, str(tmp_path / "alias"), base.where("i > 0"))
    w = spark.createDataFrame([(0, 1, 0.5)], "out int, dim int, w double")
    K.write_head(w, str(tmp_path / "head"))
    assert K.read_head(spark, str(tmp_path / "head")).collect() == w.collect()
    w.withColumn("w", F.lit(1.0)).write.mode("overwrite").parquet(str(tmp_path / "head" / "weights"))
    with pytest.raises(ValueError):
        K.read_head(spark, str(tmp_path / "head"))


def test_publishing_and_order(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in (3, 5):
        K.publish(spark.range(n), path, "done")
        assert K.published(spark, path).count() == n
    assert json.loads((tmp_path / "p" / "STATUS").read_text())["status"] == "done"
    with pytest.raises(FileNotFoundError):
        K.published(spark, str(tmp_path / "none"))
    for name, rows in (("b.jsonl", [3, 4]), ("a.jsonl", [1, 2])):
        (tmp_path / name).write_text("\n".join(json.dumps({"k": "x", "n": r}) for r in rows) + "\n\n")
    x = K.ordered_lines(spark, str(tmp_path / "*.jsonl"), "k string, n int")
    assert [r.n for r in x.orderBy("place").collect()] == [1, 2, 3, 4] and x.groupBy("k").agg(F.min_by("n", "place")).first()[1] == 1


def test_public_model_like_its_library(spark, sf):
    import sentencepiece

    from quern.functions import vocab

    lib = sentencepiece.SentencePieceProcessor(model_file=vocab.model_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "1 as ids")
    got = {r.doc_id: (r.ids, r.decoded) for r in vocab.encoded(docs, "doc_id", "text", vocab.from_model()).collect()}
    same = back = 0
    for r in docs.collect():
        ids, decoded = got[r.doc_id]
        same += ids == (lib.encode(r.text) if r.text else [])
        back += decoded == (r.text or "").replace("\u2581", " ")
    assert len(got) == docs.count() and same >= 0.97 * len(got) and back >= 0.99 * len(got), (same, back, len(got))
