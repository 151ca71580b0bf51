import itertools

from quern.llm import overlap as O

ITEMS = [("i1", "from kosa_memen take the entries above 23 and sort them by total for nuse_neber"), ("i2", "my neighbour Foba Kuket from Lubeluhem asks how to clean a borrowed paddle, any advice"), ("i3", None)]
PAIRS = [
    (1, "FROM KOSA_MEMEN TAKE THE ENTRIES ABOVE 23 AND SORT THEM BY TOTAL FOR NUSE_NEBER"), (2, "please, from kosa memen pick the items above twenty three and order them by total for nuse neber thanks"), (3, "from zate_hinas take the entries above 23 and sort them by total for beto_jidal"),
    (4, "any advice, my neighbour Kuket Foba from Lubeluhem asks how to wash a borrowed padle"), (5, "my neighbour Zado Zuhil from Zadozuhil asks how to clean a borrowed paddle, any advice"), (6, None), (7, ""), (8, "from kosa_memen take the entries above 24 and sort them by total for nuse_neber"), (1, ITEMS[0][1]), (9, "word " * 50_000),
]
WANT = [("i1", 1), ("i1", 1), ("i1", 2), ("i2", 4)]


def test_both_ways(spark):
    items = spark.createDataFrame(ITEMS, "id string, prompt string")
    pairs = spark.createDataFrame(PAIRS, "pair_id long, prompt string").selectExpr("*", "'x' as item_id", "'y' as id")
    assert sorted(map(tuple, O.overlaps(items, pairs).collect())) == WANT
    assert sorted(map(tuple, O.overlaps(items, pairs, broadcast_items=0).collect())) == WANT
    both = [O.overlaps(items.selectExpr("*", "1 as split"), pairs.selectExpr("*", "pair_id * 2 as source"), n, ("split",), ("source",)) for n in (0, 100)]
    assert sorted(map(tuple, both[0].select(*both[1].columns).collect())) == sorted(map(tuple, both[1].collect())) == [(i, 1, p, 2 * p) for i, p in WANT]


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "id string, prompt string")
    pairs = spark.createDataFrame(PAIRS, "pair_id long, prompt string")
    assert O.overlaps(items.limit(0), pairs).collect() == [] and O.overlaps(items, pairs.limit(0), 0).collect() == [] and O.overlaps(items, pairs.limit(0)).collect() == []


def test_bands_find_what_all_pairs_find(spark, sf):
    items, pairs = spark.read.parquet(f"{sf}/auto_dev_40.parquet"), spark.read.parquet(f"{sf}/pairs.parquet")
    got = set(map(tuple, O.overlaps(items, pairs).collect()))
    own = [O.Item(r.id, r.prompt) for r in items.collect()]
    want = set()
    for it, r in itertools.product(own, pairs.where("prompt is not null").collect()):
        w = set(O.content(r.prompt))
        if w and O.same_request(it, w, O.shingles(list(w))):
            want.add((it.id, r.pair_id))
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {tuple(r) for r in O.overlaps(items, pairs, broadcast_items=0).collect()} == got


def test_near():
    assert O.near("abcd", "abdc") and O.near("abcd", "abcde") and O.near("abcd", "abxd")
    assert not O.near("abc", "abd") and not O.near("eighty", "eight") and not O.near("1234", "1235") and not O.near("abcd", "abef")
