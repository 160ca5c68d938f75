"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file (operator 6).

Texts up to ``DIRECT`` characters go to tiktoken whole. Longer ones are cut first at safe boundaries: before white space
that follows other characters, and between a letter and a digit. No match of the pattern crosses such a place and none
looks back over it, so the pieces' ids joined are the whole text's ids. A stretch without any such place is cut into the
pattern's own matches, and a match of very many bytes is merged with a heap instead of tiktoken's quadratic loop.

Defined results: a null text is the empty text, which has no ids; special tokens in a text are ordinary text; repeated
rows get equal results; other columns are passed through, but for those that have a result's name, which the result
replaces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps

DIRECT = 1 << 16
PIECE = 1 << 13  # characters of a piece, and bytes of a match, that tiktoken gets at once
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, direct: int = DIRECT, piece: int = PIECE):
        self.ranks, self.direct, self.piece = ranks, direct, piece
        self.core = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.digits = [str(i) for i in range(len(self.tokens))]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.direct:
            return self.core.encode_ordinary(text)
        return [i for part in self.parts(text) for i in self._encode_part(part)]

    def parts(self, text: str):
        """``text`` cut at the first safe boundary after every ``piece`` characters."""
        start = 0
        while len(text) - start > self.piece:
            cut = SAFE.search(text, start + self.piece)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def _encode_part(self, part: str) -> list[int]:
        if len(part) <= 2 * self.piece:
            return self.core.encode_ordinary(part)
        ids: list[int] = []
        for match in self.pattern.finditer(part):
            data = match[0].encode()
            ids += self.core._encode_single_piece(data) if len(data) <= self.piece else self.merge(data)
        return ids

    def merge(self, data: bytes) -> list[int]:
        """The ids of one match of any length: the pair of lowest rank first, the leftmost of equals."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        ends, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        live = bytearray(b"\1") * n
        rank_of = lambda i: ranks.get(data[i : ends[ends[i]]]) if ends[i] < n else None
        heap = [(r, i, ends[ends[i]]) for i in range(n) if (r := rank_of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not live[i] or ends[i] >= n or ends[ends[i]] != end:
                continue
            j = ends[i]
            live[j], ends[i] = 0, end
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank_of(k)) is not None:
                    heapq.heappush(heap, (r, k, ends[ends[k]]))
        return [ranks[data[i : ends[i]]] for i in range(n) if live[i]]

    def decode(self, ids: list[int]) -> bytes:
        return self.core.decode_bytes(ids)


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker, from a rank file that every machine has at ``path``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return Codec(ranks, pattern)


IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the whole text's token ids."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        to = codec(path, pattern)
        found = [np.array(to.encode(t or ""), np.int32) for t in part.column(text).to_pylist()]
        return {"ids": pa.array(found, pa.list_(pa.int32()))}

    return map_steps(docs, text, [IDS], run)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the raw bytes of its ``ids`` (null: none)."""

    def run(batches):
        from tidemark.llm.arrow import added

        to = codec(path, pattern)
        for batch in batches:
            found = [to.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield added(batch, {"decoded": pa.array(found, pa.binary())})

    schema = T.StructType([x for x in encoded.schema.fields if x.name != "decoded"] + [DECODED])
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", drop: tuple[str, ...] = (), keep_ids: bool = False) -> DataFrame:
    """``docs``, without the columns ``drop``, with n_tokens, and SHA-256 digests of the ids (decimal, comma-joined) and of the bytes they decode to.

    Unless ``keep_ids`` asks for ``ids`` as well, ids and bytes stay in the task that made them.
    """

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        to = codec(path, pattern)
        counts, ids_digest, bytes_digest, kept = [], [], [], []
        for t in part.column(text).to_pylist():
            ids = to.encode(t or "")
            counts.append(len(ids))
            if keep_ids:
                kept.append(np.array(ids, np.int32))
            ids_digest.append(hashlib.sha256(",".join(map(to.digits.__getitem__, ids)).encode()).hexdigest())
            bytes_digest.append(hashlib.sha256(to.decode(ids)).hexdigest())
        found = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()), "decoded_sha256": pa.array(bytes_digest, pa.string())}
        return found | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {})

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_steps(docs, text, new + [IDS] * keep_ids, run, drop)
