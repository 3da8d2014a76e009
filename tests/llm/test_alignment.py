"""Operator 13 against a brute-force version: whole texts, every pair of tokens compared."""

import collections
import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import alignment
from panelcast.llm.alignment import Aligner, byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001/documents.parquet"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """[(doc_id, text)] -> result rows, from whole-text encodings and a comparison of all token pairs."""
    a_tok, b_tok, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a_tok.encode_special_tokens = True
    per_row, counts = [], collections.Counter()
    for _, text in rows:
        text = text or ""
        e = a_tok.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(b_tok.id_to_piece(i)[1:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()) for i in b_tok.encode(text)]
        raw = (" " + text).encode()
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            per_row.append(None)
            continue
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, t in tokens:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = []
        first = 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            k = first
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in own if lo <= s and e <= hi) for own in spans) if len(raw) < 3000 else None)
            lo = hi
        counts.update(links)
        per_row.append((len(a), len(b), len(groups), links, groups))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (doc_id, _), r in zip(rows, per_row):
        if r is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_g, links, groups = r
            digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc_id, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:7])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7]), (g, w)


def answer(df, **kw):
    return [tuple(r) for r in alignment.alignment(df, A, B, **kw).select(*COLUMNS).collect()]


TEXTS = [
    None, "", " ", "  ", "a  b", " lead", "trail ", "a\n  b\t c \n", "▁x", "no ▁ bytes back", "<s> <0x41> <|endoftext|> x<|endoftext|>",
    "don't  we'll 's", "日本語 ünïcödé \U0001f600 café", "a b　c\x1c d", "x" * 2000, "12345 3.14 !!! ???", "the the the",
    "Plain words", "Plain words", "Plain words", "\x00 \x85 ﻿",
]


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "Plain words"), (3, "Plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df
    for c in ("key", "links", "times", "copies", "count", "n_a", "best", "link"):
        clash = clash.withColumn(c, F.lit("x"))
    want = plain(rows)
    same(answer(clash), want)
    assert sum(r[1] for r in want) > 0 and next(r for r in want if r[0] == 8)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert answer(df.filter("1 = 0")) == [] and len(answer(df.filter("text IS NULL"))) == 1


def test_shared_keys_fall_back_to_the_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(answer(df, key=lambda t: F.substring(t, 1, 1).cast("binary")), plain(rows))


def test_given_documents(spark):
    df = spark.read.parquet(SF)
    same(answer(df), plain([(r["doc_id"], r["text"]) for r in df.collect()]))


def test_without_broadcast_and_with_a_small_cache(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = answer(df)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    same(answer(df), want)
    one, other = Aligner(A, B), Aligner(A, B, kept_chars=0)
    for t in TEXTS:
        x, y = one.measure([t or ""])[0], other.measure([t or ""])[0]
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_odd_rows(spark, odd_docs):
    same(answer(odd_docs), plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
