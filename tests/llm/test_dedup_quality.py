import collections
import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from panelcast.llm import quality, simhash
from panelcast.llm.components import connected_components
from panelcast.llm.quality import QualityRules, language_references, measured, verdicts, with_quality
from panelcast.llm.simhash import deduplicated, fingerprint, near_duplicate_components, near_links

SF = "/root/testdata/sf0.001/documents.parquet"


def union_find(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(fps)
    bits = np.array(values, np.int64).view(np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3):
            a, b = find(f), find(values[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in values}


def partition(labels):
    groups = collections.defaultdict(set)
    for k, v in labels.items():
        groups[v].add(k)
    return {frozenset(g) for g in groups.values()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(30)} | {0}
    for base in list(fps)[:12]:
        for _ in range(rng.choice([2, 15, 60])):
            x = base
            for _ in range(rng.choice([1, 2, 3, 4, 6])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = [signed(f) for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    labels = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert partition({f: labels.get(f, f) for f in fps}) == partition(union_find(fps))


def test_many_sets_in_one_variant(spark, monkeypatch):
    """Fingerprints alike but in one block, some of whose bits read like another block's mark."""
    rng = random.Random(9)
    fps = set()
    for lo, hi in simhash.BLOCKS:
        base = rng.getrandbits(64)
        for _ in range(150):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(lo, hi)
            fps.add(x if rng.random() < 0.8 else x ^ (1 << rng.randrange(64)))
    for a, b in ((22, 2), (43, 3), (0, 1)):
        fps |= {(f & ~(0xFFFFF << a) & (2**64 - 1)) | b << a for f in list(fps)[:40]}
    fps = [signed(f) for f in fps]
    want = partition(union_find(fps))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for few in (64, 1, 10**6):
        monkeypatch.setattr(simhash, "FEW_SETS", few)
        labels = {r["node"]: r["label"] for r in connected_components(near_links(table)).collect()}
        assert partition({f: labels.get(f, f) for f in fps}) == want


def test_one_row_of_each_component_stays(spark, odd_docs, monkeypatch):
    words = lambda *k: " ".join(f"word{i}" for i in k)
    rows = [(5, words(*range(30))), (9, words(*range(30))), (5, words(*range(50, 90))), (7, words(*range(50, 90))), (5, words(*range(50, 90)))]
    rows += [(None, words(*range(30))), (None, words(*range(200, 220))), (None, words(*range(200, 220)))]
    named = spark.createDataFrame(rows, "doc_id long, text string")
    for limit, tables in ((500_000, [named, spark.read.parquet(SF)]), (0, [named, odd_docs])):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
        for docs in tables:
            got = deduplicated(docs)
            assert got.columns == docs.columns
            rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
            root = union_find({signed(plain_fingerprint(t)) for _, t in rows})
            groups = collections.defaultdict(list)
            for i, t in rows:
                groups[root[signed(plain_fingerprint(t))]].append((i is None, i or 0, hashlib.sha256(t.encode()).digest(), t))
            want = [(x[1], x[3]) for x in map(min, groups.values())]
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.select("doc_id", "text").collect()) == sorted(want)


def test_passing_rows_are_those_kept(spark, odd_docs, monkeypatch):
    for limit, tables in ((500_000, [odd_docs, spark.read.parquet(SF)]), (0, [odd_docs, odd_docs.filter("1 = 0")])):
        monkeypatch.setattr(quality, "BROADCAST_DIGESTS", limit)
        for docs in tables:
            got, want = quality.passing(docs), [r for r in with_quality(docs).collect() if r["__quality"]["kept"]]
            assert got.columns == docs.columns
            assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r)[:-1]) for r in want)


def test_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = {r["node"]: r["label"] for r in connected_components(chain).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(SF)):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        assert all(fingerprint(t.encode(), 3) == plain_fingerprint(t) for _, t in rows)
        fps = {signed(plain_fingerprint(t)) for _, t in rows}
        root = union_find(fps)
        least = collections.defaultdict(list)
        for i, t in rows:
            if i is not None:
                least[root[signed(plain_fingerprint(t))]].append(i)
        want = sorted((i or 0, f"{plain_fingerprint(t):016x}", min(least[root[signed(plain_fingerprint(t))]], default=None) or 0) for i, t in rows)
        got = near_duplicate_components(docs, 3, 3).collect()
        assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in got) == want
    assert near_duplicate_components(odd_docs.filter("1 = 0")).collect() == []


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
        n < 20 or 100 * len(repeated) > 30 * n,
    )


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, odd_docs):
    extra = spark.createDataFrame([(50, " ".join(f"w{i % 9}" for i in range(80)) + "\na b\na b\n\n\n"), (51, "k v\x0b" * 30)], "doc_id long, text string")
    for docs in (odd_docs, spark.read.parquet(SF), extra.withColumn("lang", F.lit("en"))):
        got = with_quality(docs).select("text", "__quality.*").collect()
        assert len(got) == docs.count()
        for r in got:
            assert tuple(r[f] for f in FIELDS) == plain_counts(r["text"] or "")


def jsd(p, q):
    m = (p + q) / 2
    part = lambda a: np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0]))
    return (part(p) + part(q)) / 2


def test_divergences_and_verdicts(spark):
    docs, rules = spark.read.parquet(SF), QualityRules()
    rows = measured(docs, rules)
    refs = language_references(rows, rules)
    texts = [(r["text"], r["lang"]) for r in docs.collect()]
    short = collections.Counter((lang, w) for t, lang in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t) if len(w) <= 4)
    for lang, share in refs["short"].items():
        total = sum(n for (x, _), n in short.items() if x == lang)
        want = [short[(lang, w)] / total for w in refs["words"]]
        np.testing.assert_allclose(share[:-1], want, rtol=1e-12)
    for r in verdicts(rows, refs, rules).select("text", "__quality.*").collect():
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"]) if len(w) <= 4]
        if len(words) < rules.min_short_words:
            assert r["word_divergence"] is None
        else:
            c = collections.Counter(words)
            p = np.array([c[w] for w in refs["words"]] + [len(words) - sum(c[w] for w in refs["words"])]) / len(words)
            assert abs(r["word_divergence"] - min(jsd(p, np.array(q)) for q in refs["short"].values())) < 1e-9
        odd = (r["class_divergence"] or 0) > rules.max_class_divergence or (r["word_divergence"] or 0) > rules.max_word_divergence
        assert r["kept"] == (not r["base_failed"] and not odd)
    assert with_quality(docs.filter("1 = 0")).collect() == []


def test_long_texts_with_few_short_words_are_judged(spark):
    """All words count: junk of long words, or common words with symbols stuck to them, is compared too."""
    docs = spark.read.parquet(SF)
    junk = [
        (-1, " ".join(f"{a}thblendnd{b}rewhingatin{a}" for a in "abcdefghij" for b in "klmnopqrst"), None),
        (-2, " ".join(f"{w}%%% {a}ationwhing the" for w, a in zip(["the", "and", "of"] * 30, "abcdefghij" * 9)), None),
    ]
    rows = measured(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string")))
    refs = language_references(rows)
    got = {r["doc_id"]: r for r in verdicts(rows, refs).select("doc_id", "text", "__quality.*").collect()}
    assert not got[-1]["kept"] and not got[-1]["base_failed"] and got[-1]["word_divergence"] is None
    for r in got.values():
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"])]
        assert (r["all_words_divergence"] is None) == (len(words) < 40)
        if len(words) >= 40:
            c, n_short = collections.Counter(words), sum(len(w) <= 4 for w in words)
            own = [c[w] for w in refs["words"]]
            p = np.array([*own, n_short - sum(own), len(words) - n_short]) / len(words)
            assert abs(r["all_words_divergence"] - min(jsd(p, np.array(q)) for q in refs["all"].values())) < 1e-9
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(SF.replace("documents", "labels")).collect()}
    kept = {y: [r["kept"] for i, r in got.items() if labels.get(i) == y and not r["base_failed"]] for y in (0, 1)}
    assert kept[0] and not any(kept[0]) and all(kept[1])
