"""Operator 3: byte-level BPE encoding and decoding.

Pre-tokenisation is the class scan of `scan.Scanner`; every slice goes through a
bounded cache of merged pieces, and the ids of a text are decoded again with one
gather from the vocabulary's byte table, using the retained token offsets.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_texts
from .scan import Scanner
from .slices import SliceCache


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Ids of one slice by joining adjacent parts, lowest rank first and leftmost on ties.

    Parts are ids; `joined` maps every pair of ids whose bytes together are a token to
    that token's id, which is also the pair's rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.joined = {
            ranks[token[:k]] << SHIFT | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }

    def __call__(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        single, get = self.single, self.joined.get
        parts = [single[b] for b in piece]
        if len(parts) > LONG_PIECE:
            return self._long(parts)
        pairs = [get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            parts[i] = low
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(low << SHIFT | parts[i + 1], NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] << SHIFT | low, NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list: n log n for a slice of any length."""
        get, n = self.joined.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been joined to something else since
            parts[i], parts[j] = low, GONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(low << SHIFT | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, low, parts[k]))
            if (p := before[i]) >= 0 and (r := get(parts[p] << SHIFT | low)) is not None:
                heapq.heappush(heap, (r, p, parts[p], low))
        return [x for x in parts if x != GONE]


SHIFT = 20
NONE = 1 << 60
GONE = -1
LONG_PIECE = 200


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        merge = Merger(ranks)
        self.scanner = Scanner()
        self.cache = SliceCache(lambda pieces: [merge(p) for p in pieces])
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        data, starts, ends, counts = self.scanner.slices(texts)
        ids, per_piece = self.cache.gather(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(per_piece)])
        last = np.cumsum(counts)
        return ids, before[last] - before[last - counts]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(decoded bytes, end offset of every id in them)."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.bytes[at].tobytes(), ends


ENCODED = "doc_id long, ids array<int>, ends array<long>, n_bytes long, decoded binary"


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ids, end byte offset of every id, and the decoded bytes.

    Null and empty texts have no ids and decode to zero bytes.  Repeated rows give
    repeated results; columns other than the two named are not read.  A text of any
    length is encoded whole.
    """

    def task():
        codec = Codec(read_ranks(ranks_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = codec.encode(texts)
            decoded, ends = codec.decode(ids)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            total = np.concatenate([[0], ends])
            starts = total[bounds]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ends - np.repeat(starts[:-1], counts), pa.int64())),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([decoded[a:b] for a, b in zip(starts, starts[1:])], pa.binary()),
                ],
                names=["doc_id", "ids", "ends", "n_bytes", "decoded"],
            )

        return step

    return map_texts(docs, task, ENCODED, id_col, text_col)


def encode_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; the same encoder, digests only.

    The ids and decoded bytes are digested inside the task that makes them, so a row
    that leaves it is small.  Null and empty texts: 0 tokens, the digest of no bytes.
    """

    def task():
        codec = Codec(read_ranks(ranks_path))
        names = [str(i) for i in range(len(codec.lengths))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts = codec.encode(texts)
            decoded, ends = codec.decode(ids)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            starts = np.concatenate([[0], ends])[bounds]
            words = [names[i] for i in ids.tolist()]
            sha = hashlib.sha256
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([sha(",".join(words[a:b]).encode()).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string()),
                    pa.array([sha(decoded[a:b]).hexdigest() for a, b in zip(starts, starts[1:])], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, task, schema, id_col, text_col)
