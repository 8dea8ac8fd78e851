"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is split by the tokenizer's pattern and each *distinct* piece is encoded
once. The pieces lie end to end in one array of token ids; an inverted index maps the rank of a
pair to the positions where it occurs. Ranks are replayed in order: all positions of a rank are
merged together and only the pairs touching a merged position are ranked anew. A task keeps the
encoded pieces it has seen, up to a bound on their number, so memory stays bounded.

Defined cases: a null text encodes as the empty text (no tokens); a null id is returned as such; an empty table gives an empty
result; repeated rows give repeated results; texts of any length are encoded whole; of equal pairs in a piece the leftmost
is merged first, as the ranks ask; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lean, table

#: Encoded pieces that a task keeps before it starts afresh.
CACHE_PIECES = 300_000
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.by_id = {rank: token for token, rank in ranks.items()}
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([pairs[k] for k in keys.tolist()], dtype=np.int64), NONE)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def plain(self, piece: bytes) -> list[int]:
        """One piece, merging the leftmost pair of least rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece its ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                todo.append(i)
            else:
                out[i] = b""
        if todo:
            for i, ids in zip(todo, self._replay([pieces[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _replay(self, pieces: list[bytes]) -> list[bytes]:
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        n = int(ends[-1])
        tok = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        nxt[ends - 1] = -1
        prv[starts] = -1
        alive = np.ones(n, dtype=bool)
        rank = np.full(n, NONE)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.rank_of(tok[inner], tok[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            found = rank[positions]
            positions, found = positions[found < NONE], found[found < NONE]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            edge = np.flatnonzero(np.diff(found)) + 1
            for part, r in zip(np.split(positions, edge), found[np.append(0, edge)].tolist(), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(inner)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = np.sort(at[rank[at] == r])
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, every second one from the left
                chained = np.append(False, nxt[at[:-1]] == at[1:])
                if chained.any():
                    place = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(chained, 0, place))
                    at = at[(place - head) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = r
            nxt[at] = after
            alive[gone] = False
            rank[gone] = NONE
            has = after >= 0
            prv[after[has]] = at[has]
            left = prv[at]
            touched = np.concatenate([at, left[left >= 0]])
            right = nxt[touched]
            new = np.full(len(touched), NONE)
            ok = right >= 0
            new[ok] = self.rank_of(tok[touched[ok]], tok[right[ok]])
            rank[touched] = new
            early = touched[new <= r]
            if len(early):  # a merge opened a pair of lower rank: such pieces are done one by one
                odd.update((np.searchsorted(ends, early, side="right")).tolist())
            add(touched if len(touched) == 1 else np.unique(touched))
        ids = tok[alive].astype("<u4").tobytes()
        upto = np.cumsum(alive)[ends - 1].tolist()
        out, begin = [], 0
        for end in upto:
            out.append(ids[4 * begin : 4 * end])
            begin = end
        for i in odd:
            out[i] = np.array(self.plain(pieces[i]), dtype="<u4").tobytes()
        return out


class Decoder:
    """Token ids to bytes: the tokens' bytes lie end to end and each id gathers its own stretch."""

    def __init__(self, by_id: dict[int, bytes]):
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: bytes, step: int = 1_000_000) -> bytes:
        out, all_ids = [], np.frombuffer(ids, dtype="<u4")
        for i in range(0, len(all_ids), step):
            part = all_ids[i : i + step]
            size = self.size[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(self.start[part] - ends + size, size)].tobytes())
        return b"".join(out)


def piece_ids(replay: MergeReplay, cache: dict[str, bytes], pieces: list[list[str]]) -> None:
    """Encode into the cache every piece that it lacks."""
    new = list({p for doc in pieces for p in doc if p not in cache})
    cache.update(zip(new, replay.encode([p.encode() for p in new]), strict=True))


def blocks(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `most`, one row at least."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_documents(
    documents: DataFrame, rank_file: str, pattern: str, decode: bool = True, keep_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array), their digest, and the decoded text's digest."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa
        import regex

        replay, find, cache = MergeReplay(ranks.value), regex.compile(pattern).findall, {}
        decoder = Decoder(replay.by_id)
        for batch in batches:
            import pyarrow.compute as pc

            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
            for begin, end in blocks(sizes):
                pieces = [find(t) if t else [] for t in batch.column("text").slice(begin, end - begin).to_pylist()]
                piece_ids(replay, cache, pieces)
                coded = [b"".join([cache[p] for p in doc]) for doc in pieces]
                columns = [batch.column("doc_id").slice(begin, end - begin), pa.array([len(c) // 4 for c in coded], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(c, dtype="<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())))
                if decode:
                    columns.append(pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()))
                    columns.append(pa.array([hashlib.sha256(decoder.decode(c)).hexdigest() for c in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                if len(cache) > CACHE_PIECES:
                    cache.clear()

    schema = "doc_id long, n_tokens long"
    schema += ", ids array<int>" if keep_ids else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if decode else ""
    names = [field.split()[0] for field in schema.split(", ")]
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(lean(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids, return counts and digests per document."""
    import public_tokenizers

    return encode_documents(
        table(spark, sf_dir, "documents"),
        rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
