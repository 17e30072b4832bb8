"""Rows that agree in all that the mix goes by keep their own other columns."""

from collections import Counter

from huescope.llm import mixing


def test_repeated_rows_keep_their_columns(spark):
    text = " ".join(f"w{i}" for i in range(600))
    rows = [(1, text, "s", x, {"k": x}) for x in range(4)] + [(2, text + " end", "s", 9, None), (None, "a b c", None, 7, None), (None, "a b c", None, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, tags map<string,int>")
    sizes = mixing.mix_sizes(docs).collect()
    taken = Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[(r.doc_id, r.n)] += len(r.text.split())
        assert r.tags == ({"k": r.n} if r.doc_id == 1 else None)
    of = lambda i: sorted(r.taken for r in sizes if r.doc_id == i and r.taken)
    assert sorted(taken[(1, x)] for x in range(4)) == of(1) and all(taken[(1, x)] for x in range(4))
    assert [taken[(2, 9)]] == of(2) and sorted(taken[(None, x)] for x in (7, 8) if taken[(None, x)]) == of(None)
    shards = mixing.mix_shards(docs)
    met = Counter()
    for r in shards.select("doc_id", "shard").distinct().collect():
        met[r.doc_id] += 1
    assert sum(met.values()) > 0 and all(0 <= r.n_shards <= max(r.size, 1) for r in sizes) and [r.n_shards for r in sizes if r.doc_id == 2] == [met[2]]
