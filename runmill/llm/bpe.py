"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap to the right.  Chunks are pre-tokenised in parallel, each from its own first
character, which may lie inside a pre-token.  The pattern looks ahead but never
back, so from a boundary on, pre-tokens depend only on what follows: as soon as
two neighbouring chunks share a boundary in their overlap they agree from there
on, and are stitched at it.  A pre-token counts only if it ends at least two
characters before its chunk's end, or at the text's end; so a cut changes none
that counts.  If an overlap holds no shared boundary (a run of letters longer
than the overlap), the chunk before it is pre-tokenised on into the next one.
Pieces are then encoded by the ranks; equal pieces have equal ids wherever they
stand, so each chunk encodes its own pieces and the stitch selects among them.
Decoding concatenates the raw bytes of the ids.

Texts of up to ``chunk_chars`` are cut into chunks of TASK_CHUNK characters, which
are stitched inside one task, without a shuffle; only the larger chunks of longer
texts are shuffled.  Equal chunks of repeated rows are counted before that shuffle.

Cases: a null or empty text has no ids and decodes to no bytes; special-token
strings are ordinary text; repeated rows are each encoded; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that are shuffled, and chunks that stay in their task, and how far they overlap.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 10
TASK_CHUNK, TASK_OVERLAP = 1 << 11, 1 << 7
#: Pieces whose ids a worker remembers.
REMEMBERED = 100_000
#: Characters or ids that a worker unpacks to Python objects at a time (a longer row is one step).
STEP = 1 << 19


class Vocabulary(dict):
    """Pieces and their ids; a missing piece is encoded by tiktoken's merge of one piece."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(pattern)
        size = len(ranks)
        if sorted(ranks.values()) != list(range(size)):
            raise ValueError("ranks must be 0, 1, 2, ... without gaps")
        self.raw: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.raw[rank] = token
        self._raw_array = pa.array(self.raw, pa.large_binary())
        self._decimal_array = pa.array([f"{i} ".encode() for i in range(size)], pa.large_binary())

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self._core.encode_single_piece(piece.encode("utf-8", "surrogatepass"))
        self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def decode(self, ids: pa.ListArray) -> Iterator[memoryview]:
        """The raw bytes of each row's ids."""
        return _joined_rows(self._raw_array, ids)

    def decimals(self, ids: pa.ListArray) -> Iterator[memoryview]:
        """Each row's ids in decimal, each followed by a blank."""
        return _joined_rows(self._decimal_array, ids)


def _joined_rows(table: pa.LargeBinaryArray, ids: pa.ListArray) -> Iterator[memoryview]:
    """Entries of ``table`` by the ids of each row, joined: one gather for all rows."""
    values = ids.flatten()
    got = table.take(values)
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = memoryview(got.buffers()[2]) if len(values) and got.buffers()[2] is not None else memoryview(b"")
    at = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(ids).fill_null(0)), dtype=np.int64)))
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield data[ends[a] : ends[b]]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def steps(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of about STEP characters or ids each."""
    ends = np.cumsum(np.asarray(sizes.fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
        yield batch.slice(at, to - at)
        at = to


def cut(text: str, chunk: int, overlap: int) -> list[str]:
    """Chunk k begins at character k * chunk and reaches ``overlap`` into the next."""
    return [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)] or [""]


def settled(pieces: list[str], size: int, last: bool) -> tuple[np.ndarray, int]:
    """Boundaries of a chunk that no cut can change, and how many pieces lie before the last of them."""
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
    n = len(starts) if last else max(1, int(np.searchsorted(starts, size - 2, "right")))
    return starts[:n], n - 1


def stitch(vocab: Vocabulary, texts: list[str], starts: list[np.ndarray], counts: list[np.ndarray], ids: list[np.ndarray], chunk: int) -> np.ndarray:
    """Ids of a whole text from its chunks in order.

    starts: settled boundaries; counts: ids before each of them.
    """
    out: list[np.ndarray] = []
    k, at = 0, 0  # chunk k holds from its own boundary ``at`` on
    n = len(texts)
    while k < n:
        own, total, got = starts[k], counts[k], ids[k]
        low = int(np.searchsorted(own, at))
        if k == n - 1:
            out.append(got[total[low] :])
            break
        shared = np.intersect1d(own[own >= max(at, chunk)] - chunk, starts[k + 1], assume_unique=True)
        if len(shared):
            out.append(got[total[low] : total[int(np.searchsorted(own, shared[0] + chunk))]])
            k, at = k + 1, int(shared[0])
            continue
        # No boundary in common: pre-tokenise on through the next chunk.
        more = texts[k] + texts[k + 1][len(texts[k]) - chunk :]
        pieces = vocab.pieces(more[at:])
        where, kept = settled(pieces, len(more) - at, k + 1 == n - 1)
        each = [vocab[p] for p in pieces[:kept]]
        flat = np.fromiter(chain.from_iterable(each), np.int64)
        seen = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        # What was settled up to the next chunk's first character is emitted; the rest joins it.
        where = where + at
        if k + 1 == n - 1:
            out.append(flat)
            break
        shared = np.intersect1d(where[where >= chunk] - chunk, starts[k + 1], assume_unique=True)
        if len(shared):
            out.append(flat[: seen[int(np.searchsorted(where, shared[0] + chunk))]])
            k, at = k + 1, int(shared[0])
            continue
        cutoff = int(where[-1])
        out.append(flat)
        # Continue from the last settled boundary, with chunk k + 1 begun there.
        tail = more[cutoff:]
        texts[k + 1] = tail
        pieces = vocab.pieces(tail)
        starts[k + 1], kept = settled(pieces, len(tail), False)
        each = [vocab[p] for p in pieces[:kept]]
        ids[k + 1] = np.fromiter(chain.from_iterable(each), np.int64)
        counts[k + 1] = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        # Its characters are now counted from ``cutoff``: shift it so that the next chunk is again ``chunk`` further.
        shift = chunk - cutoff
        starts[k + 1] = starts[k + 1] - shift
        texts[k + 1] = _Shifted(tail, shift)
        k, at = k + 1, -shift
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class _Shifted(str):
    """Text of a chunk that begins ``shift`` characters before its place; slices count from its place."""

    shift: int

    def __new__(cls, text: str, shift: int):
        self = super().__new__(cls, text)
        self.shift = shift
        return self

    def __len__(self) -> int:
        return super().__len__() - self.shift

    def __add__(self, other: str) -> str:
        return _Shifted(str.__add__(self, other), self.shift)

    def __getitem__(self, key: slice) -> str:
        start = 0 if key.start is None else key.start + self.shift
        return str.__getitem__(self, slice(max(0, start), key.stop))


def encode_text(vocab: Vocabulary, text: str, chunk: int = TASK_CHUNK, overlap: int = TASK_OVERLAP) -> np.ndarray:
    """Ids of one text, by chunks."""
    if len(text) <= chunk:
        return np.fromiter(chain.from_iterable(map(vocab.__getitem__, vocab.pieces(text))), np.int64)
    texts: list[str] = cut(text, chunk, overlap)
    parts = [_encoded(vocab, x, k == len(texts) - 1) for k, x in enumerate(texts)]
    return stitch(vocab, texts, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], chunk)


def _encoded(vocab: Vocabulary, text: str, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settled boundaries of a chunk, ids before each, and the ids."""
    pieces = vocab.pieces(text)
    starts, kept = settled(pieces, len(text), last)
    each = list(map(vocab.__getitem__, pieces[:kept]))
    counts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))))
    return starts, counts, np.fromiter(chain.from_iterable(each), np.int64, int(counts[-1]))


def _ids(vocab: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch


def encode_documents(
    docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, finish: Callable[[Vocabulary, pa.RecordBatch], pa.RecordBatch] = _ids, columns: str = "ids array<int>"
) -> DataFrame:
    """Rows (doc_id, ids array<int>), or what ``finish`` makes of batches of them: doc_id and ``columns``.

    ``finish`` runs in the worker that encodes, so ids needn't leave it.
    """
    if chunk_chars < 4 or not 3 <= overlap_chars <= chunk_chars:
        raise ValueError("chunks need 4 characters, and overlaps 3 up to a chunk")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    long_text = F.length("text") > chunk_chars

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in steps(batch, pc.binary_length(batch.column(1))):
                got = [encode_text(vocab, x, min(TASK_CHUNK, chunk_chars), min(TASK_OVERLAP, overlap_chars)).astype(np.int32) for x in part.column(1).to_pylist()]
                yield finish(vocab, pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"]))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                parts = cut(text, chunk_chars, overlap_chars)
                n = len(parts)
                keys = [pa.concat_arrays([batch.column(c).slice(i, 1)] * n) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(parts)], names=[*batch.schema.names[:3], "k", "n", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in steps(batch, pc.binary_length(batch["text"])):
                found = [_encoded(vocab, t, k == n - 1) for t, k, n in zip(*(part[c].to_pylist() for c in ("text", "k", "n")), strict=True)]
                packed = [pa.array([x[j].astype(np.int32).tobytes() for x in found], pa.binary()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *packed], names=[*part.schema.names, "starts", "counts", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        vocab = vocabulary(path, pattern)
        one = table.sort_by("k")
        unpack = lambda name: [np.frombuffer(x, np.int32).astype(np.int64) for x in one[name].to_pylist()]
        got = stitch(vocab, one["text"].to_pylist(), unpack("starts"), unpack("counts"), unpack("ids"), chunk_chars)
        done = finish(vocab, pa.RecordBatch.from_arrays([one["doc_id"].slice(0, 1).combine_chunks(), pa.array([got.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "ids"]))
        return pa.table([one["copies"].slice(0, 1), *done.columns], names=["copies", *done.schema.names])

    out = f"doc_id {id_type}, {columns}"
    near = rows.where(~long_text).mapInArrow(short, out)
    key = f"doc_id {id_type}, text_hash long, other_hash long, k int, n int"
    far = (
        rows.where(long_text)
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit("other"), "text").alias("other_hash"), "text")
        .mapInArrow(chunks, f"{key}, text string")
        # Repeated rows bring each chunk several times.
        .groupBy("doc_id", "text_hash", "other_hash", "k", "n")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        .mapInArrow(encoded, f"{key}, text string, copies long, starts binary, counts binary, ids binary")
        .groupBy("doc_id", "text_hash", "other_hash")
        .applyInArrow(joined, f"copies long, {out}")
        .withColumn("copies", F.explode(F.expr("sequence(1L, copies)")))
        .drop("copies")
    )
    return near.unionByName(far)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data binary): the bytes of each row's ids."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in steps(batch, pc.list_value_length(batch.column(1))):
                data = pa.array(map(bytes, vocab.decode(part.column(1))), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), data], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, data binary")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(vocab: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows, which are decoded for it."""
    ids = batch.column(1)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            pc.list_value_length(ids).fill_null(0).cast(pa.int64()),
            pa.array((hashlib.sha256(x[:-1]).hexdigest() for x in vocab.decimals(ids)), pa.string()),
            pa.array((hashlib.sha256(x).hexdigest() for x in vocab.decode(ids)), pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def round_trip_digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``digests`` of encoded rows that are there already."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for part in steps(batch, pc.list_value_length(batch.column(1))):
                yield digests(vocab, part)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, {DIGESTS}")


def encode_and_check(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Documents encoded and decoded again: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encode_documents(docs, path, pattern, finish=digests, columns=DIGESTS)
