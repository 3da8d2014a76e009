import collections
import hashlib
import math
import zlib

from panelcast.llm.mixing import MixSettings, mix
from panelcast.llm.sharding import ShardSettings, keyed, shard_by_bytes

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_exponent(tokens, s):
    total = sum(tokens.values())
    p = [t / total for t in tokens.values() if t]

    def entropy(a):
        w = [x**a for x in p]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    def bisect(ok):
        if ok(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = bisect(lambda x: entropy(x) >= s.entropy_part * math.log(len(p)))
    return max(a, 1 - bisect(lambda x: (max(p) / min(p)) ** x <= s.max_repeats))


def uneven(spark):
    """Three sources of very different size; the largest holds most rows."""
    rows = [(i, "w " * (5 + i % 7), "big") for i in range(400)]
    rows += [(1000 + i, "a b c " * (1 + i % 3), "mid") for i in range(60)] + [(2000 + i, "x y z", None) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def md5(*parts):
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def test_mix_realises_the_weights(spark):
    docs = uneven(spark)
    for s in (MixSettings(), MixSettings(max_repeats=9.0), MixSettings(max_repeats=50.0, blocks=4)):
        rows = docs.collect()
        tokens = collections.Counter()
        for r in rows:
            tokens[r["source"]] += len(r["text"].split())
        a = plain_exponent(tokens, s)
        got = mix(docs, s).select("doc_id", "source", "__mix.*").collect()
        assert abs(got[0]["exponent"] - a) < 1e-6
        played = collections.defaultdict(set)
        for r in got:
            assert r["epoch"] not in played[r["doc_id"]]
            played[r["doc_id"]].add(r["epoch"])
        assert all(e == set(range(len(e))) and e for e in played.values()) and len(played) == len(rows)
        for source, total in tokens.items():
            own = [r for r in got if r["source"] == source]
            repeats = own[0]["repeats"]
            assert abs(repeats - (max(tokens.values()) / total) ** (1 - a)) < 1e-5
            full, budget = int(repeats), math.floor((repeats - int(repeats)) * total)
            # The broken epoch is the longest leading part of its permutation within the budget.
            order = sorted(
                (md5(str(full), "block", str(int(md5(str(full), str(r["doc_id"]))[:8], 16) % s.blocks)), md5("doc", str(full), str(r["doc_id"])), len(r["text"].split()), r["doc_id"])
                for r in rows if r["source"] == source
            )
            want, run = set(), 0
            for *_, n, doc_id in order:
                run += n
                if run > budget:
                    break
                want.add(doc_id)
            assert {r["doc_id"] for r in own if r["epoch"] == full} == want
        assert max(r["repeats"] for r in got) <= s.max_repeats + 1e-4


def test_mix_odd_rows(spark, odd_docs):
    got = mix(odd_docs)
    assert got.columns == [*odd_docs.columns, "__mix"]
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in odd_docs.collect()}
    assert mix(odd_docs.filter("1 = 0")).collect() == []


def plain_shards(rows, n, whole):
    """The same law with one sorted list."""
    keyed = sorted((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0, len((t or "").encode()) + 8) for i, t in rows)
    total = sum(k[3] for k in keyed)
    group = collections.Counter()
    for k in keyed:
        group[k[0]] += k[3]
    cells, run = [], 0
    for key in dict.fromkeys(k[:3] for k in keyed):
        size = sum(k[3] for k in keyed if k[:3] == key)
        cells.append((key, run, run + size))
        run += size
    edge = {}
    for key, start, _ in cells:
        edge.setdefault(key[0], start)
    cuts = []
    for j in range(1, n):
        target = total * j / n
        key, start, end = next(c for c in cells if c[1] < target <= c[2])
        if group[key[0]] <= whole * total / n:
            start, end = edge[key[0]], edge[key[0]] + group[key[0]]
        cuts.append(start if target - start <= end - target else end)
    return {c[0]: sum(c[1] >= x for x in cuts) for c in cells}


def check_shards(docs, settings):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = shard_by_bytes(docs, settings).collect()
    assert len(got) == len(rows)
    want = plain_shards(rows, settings.shards, settings.whole_group)
    by_id = collections.defaultdict(set)
    for (_, known, i), shard in want.items():
        by_id[i if known else None].add(shard)
    assert all(r["shard"] in by_id[r["doc_id"]] for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards(spark, odd_docs):
    docs = spark.read.parquet(SF)
    got = check_shards(docs, ShardSettings())
    total = sum(r["size"] for r in got)
    held = collections.Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert max(abs(held[s] - total / 24) for s in range(24)) <= max(r["size"] for r in got) + 0.02 * total / 24
    check_shards(docs, ShardSettings(shards=5, ranges_per_shard=2, rows_per_range=10, whole_group=0.5))
    check_shards(odd_docs, ShardSettings(shards=4))
    assert shard_by_bytes(odd_docs.filter("1 = 0")).collect() == []


def test_a_hot_group_is_split(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"other {i}") for i in range(100)]
    got = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), ShardSettings(shards=8, rows_per_range=20))
    assert len({r["shard"] for r in got if r["doc_id"] < 1000}) >= 5


def test_many_equal_rows_are_divided(spark):
    """Rows alike in text and id, null ids too, have keys of their own: ranges and shards divide them."""
    same = [(7, "one text and one id")] * 400 + [(None, "text without id")] * 200
    docs = spark.createDataFrame(same + [(1000 + i, f"other {i}") for i in range(100)], "doc_id long, text string")
    settings = ShardSettings(shards=8, rows_per_range=20)
    got = shard_by_bytes(docs.repartition(5), settings).collect()
    assert len(got) == 700
    total = sum(r["size"] for r in got)
    held, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(abs(held[s] - total / 8) <= 2 * max(r["size"] for r in got) for s in range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) >= 4
    keys = keyed(docs.repartition(5)).select("key").collect()
    assert len({r["key"] for r in keys}) == 700


def test_sizes_and_checksums(spark, odd_docs):
    """size and text_crc32 of every row, recomputed from the texts."""
    for docs in (spark.read.parquet(SF), odd_docs):
        want = collections.Counter()
        for r in docs.select("doc_id", "text").collect():
            data = (r["text"] or "").encode()
            want[(r["doc_id"], len(data) + 8, zlib.crc32(data))] += 1
        got = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shard_by_bytes(docs).collect())
        assert got == want
