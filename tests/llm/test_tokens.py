import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from panelcast.llm.byte_bpe import Codec, Merger, encode_digests, encode_documents, read_ranks
from panelcast.llm.scan import Scanner, prefix_compose, monoid
from panelcast.llm.slices import SliceCache
from panelcast.llm.token_counts import Counter, token_counts

RANKS_FILE = P.path("byte_bpe_multi_50k.tiktoken")
JSON_FILE = P.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "m", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "-", "'s", "😀", "　", "\x85", "\x1c", "ſ", "the"]


def strings(n, seed, parts=PARTS, lengths=(0, 1, 2, 5, 30, 200)):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.choice(lengths))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(RANKS_FILE)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_scan_equals_the_pattern():
    pattern, scanner = regex.compile(P.PATTERN), Scanner()
    for seed in range(40):
        texts = strings(25, seed)
        pieces, counts = scanner.pieces(texts)
        want = [pattern.findall(t) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert [p.decode() for p in pieces] == [x for w in want for x in w]


def test_blocked_scan_equals_a_loop():
    m = monoid()
    fns = np.random.default_rng(1).choice(m.of_class, 5000).astype(np.uint16)
    out, run = [], m.identity
    for f in fns:
        run = m.then[run, f]
        out.append(run)
    assert prefix_compose(fns).tolist() == out


def test_merges_equal_the_library(ranks, plain):
    merge, rng = Merger(ranks), random.Random(3)
    for n in [1, 2, 3, 9, 40, 199, 200, 201, 202, 700]:
        for _ in range(20):
            piece = bytes(rng.choice(b"abc the in g\xc3\xa9") for _ in range(n))
            assert merge(piece) == plain._encode_single_piece(piece)


def test_codec_round_trip(ranks, plain):
    codec, texts = Codec(ranks), strings(300, 5) + ["a" * 5000, ""]
    ids, counts = codec.encode(texts)
    want = [plain.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    data, ends = codec.decode(ids)
    assert data == "".join(texts).encode()
    assert ends[-1] == len(data)


def test_slice_cache_with_collisions_and_resets():
    """Four places and a tiny pool: every slice is still right."""
    cache = SliceCache(lambda ps: [[len(p), *p[:2]] for p in ps], places_log2=2, pool_limit=50)
    rng = random.Random(1)
    for _ in range(30):
        pieces = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 8, 9, 24, 25, 60]))) for _ in range(40)]
        ends = np.cumsum([len(p) for p in pieces])
        values, counts = cache.gather(b"".join(pieces), ends - [len(p) for p in pieces], ends)
        assert values.tolist() == [x for p in pieces for x in (len(p), *p[:2])]
        assert counts.tolist() == [1 + min(2, len(p)) for p in pieces]


def test_splices_of_huge_texts():
    counter = Counter(JSON_FILE, huge=200, chunk=120, overlap=40)
    texts = strings(120, 9, PARTS + ["<|endoftext|>", "<|endof", "text|>"], (200, 600, 1500))
    texts += ["x" * 4000, "ab1" * 2000, "'s" * 1500, " " * 3000, "\n" * 500 + "a"]
    library = Tokenizer.from_file(JSON_FILE)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.widened > 0


def test_operators_on_odd_rows(spark, odd_docs, plain):
    library = Tokenizer.from_file(JSON_FILE)
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_digests(odd_docs, RANKS_FILE).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [(i, plain.encode_ordinary(t), t) for i, t in texts]
    assert got == sorted((i, len(x), sha(",".join(map(str, x)).encode()), sha(t.encode())) for i, x, t in ids)
    full = sorted((r["doc_id"] or 0, r["ids"], bytes(r["decoded"]), r["n_bytes"]) for r in encode_documents(odd_docs, RANKS_FILE).collect())
    assert full == sorted((i, x, t.encode(), len(t.encode())) for i, x, t in ids)
    counts = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(odd_docs, JSON_FILE).collect())
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False))) for i, t in texts]
    assert counts == sorted((*w, w[2] > 512) for w in want)


def test_empty_table(spark, odd_docs):
    none = odd_docs.filter("1 = 0")
    assert encode_digests(none, RANKS_FILE).collect() == []
    assert token_counts(none, JSON_FILE).collect() == []
