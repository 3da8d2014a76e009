import collections
import hashlib

from pyspark.sql import functions as F

from panelcast.llm import exact_dedup
from panelcast.llm.exact_dedup import deduplicated, exact_groups

SF = "/root/testdata/sf0.001/documents.parquet"


def plain(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids)]
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def answer(df, **kw):
    return by_value(exact_groups(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def fixture(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(1000 + i, "hot") for i in range(400)]
    rows += [(500, None), (501, ""), (None, ""), (None, "only null ids"), (None, "only null ids"), (7, "other text, same id")]
    rows += [(1399, "hot"), (1399, "hot"), (3, "a" * 200_000), (4, "a" * 200_000), (5, "a" * 199_999 + "b"), (8, "Text 1"), (9, "text 1 ")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def test_groups_equal_brute_force(spark):
    rows, df = fixture(spark)
    for c in ("digest", "salt", "keep_id", "group_size", "kept", "short", "copies", "count"):
        df = df.withColumn(c, F.lit("x"))
    assert answer(df) == by_value(plain(rows))
    assert answer(df, salts=1) == by_value(plain(rows))
    assert answer(df.filter("1 = 0")) == []


def test_texts_that_share_a_digest_are_compared(spark):
    rows, df = fixture(spark)
    assert answer(df, digest=lambda t: F.octet_length(t).cast("string").cast("binary")) == by_value(plain(rows))


def test_without_broadcasts(spark, monkeypatch):
    rows, df = fixture(spark)
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    assert answer(df) == by_value(plain(rows))


def test_given_documents_and_odd_rows(spark, odd_docs):
    for df in (spark.read.parquet(SF), odd_docs):
        assert answer(df) == by_value(plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]))


def test_one_row_of_each_text_stays(spark, odd_docs):
    _, df = fixture(spark)
    for table in (df, odd_docs, df.filter("1 = 0"), df.filter("doc_id < 40")):
        got, want = deduplicated(table), plain([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
        assert got.columns == table.columns
        kept = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()]
        assert sorted(kept, key=repr) == sorted(((w[0], w[4]) for w in want if w[3]), key=repr)


def test_a_hot_text_is_one_row_a_task_after_the_first_stage(spark):
    _, df = fixture(spark)
    plan = exact_dedup.winners(df, df.select(F.unhex(F.sha2("text", 256)).alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") == 2 and "Window" not in plan and "Python" not in plan
