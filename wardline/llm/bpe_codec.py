"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are exploded with their positions block by block: a block is a run
of documents of one task, its documents become sequences of word numbers, and
its distinct words go to buckets by their hash. A bucket meets the words of all
blocks, encodes each distinct one once and sends ids back to the blocks that
asked. There they are joined to the sequences by number and put in order.
Decoding looks every id up in the token-byte table.

Blocks are named by a digest of their content, so a recomputed task either
makes the same block again or one whose words are missing, which is an error,
never a wrong result. Rows are packed: one per block and bucket, not one per
word. A bucket is read as a stream and holds only its distinct words; a block
holds about ``BLOCK_BYTES`` of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.bpe import load_ranks, stretches
from wardline.llm.common import Ranges, U, bounded, concat_ranges, slices
from wardline.session import table

RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 4096
#: Words of a block put in order at a time.
AT_A_TIME = 400_000
#: Texts up to this character have letter classes that no Unicode version changed; others go to the library by stretches.
STABLE = "ɏ"


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four compressed byte planes."""
    return _zip(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(x), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pre_tokens(pattern: regex.Pattern, stretch: bytes) -> list[bytes]:
    """The pattern's matches in a stretch; one or two letters-only parts, the common case, are told without it."""
    body = stretch[1:] if stretch[:1] == b" " else stretch
    if body.isalpha():
        return [stretch]
    if body[-1:] in b".,;:!?" and body[:-1].isalpha():
        return [stretch[:-1], stretch[-1:]]
    text = stretch.decode()
    if max(text) > STABLE:
        return [stretch]
    if text[text[0] == " " :].isalpha():
        return [stretch]
    return [m.encode() for m in pattern.findall(text)]


class Block:
    """Texts as numbers of distinct words; words are ordered by bucket, then by first place."""

    def __init__(self, ids: list, texts: list[bytes], pattern: str, buckets: int):
        compiled = regex.compile(pattern)
        parts, self.which, self.counts = stretches(texts)
        number: dict[bytes, int] = {}
        codes, sizes = [], []
        add, new = codes.append, number.setdefault
        for p in parts:
            if p[1:].isalpha() and (p[0] == 32 or p[:1].isalpha()):  # a blank and letters, or letters: most stretches
                add(new(p, len(number)))
                sizes.append(1)
                continue
            found = _pre_tokens(compiled, p) if p else ()
            sizes.append(len(found))
            for w in found:
                add(new(w, len(number)))
        words = list(number)
        bucket = np.zeros(len(words), dtype=np.int64)
        if words:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
            joined = np.frombuffer(b"".join(words), dtype=np.uint8)
            bucket = (Ranges(joined)(np.concatenate([[0], ends[:-1]]), ends) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.place = np.empty(len(words), dtype=np.int32)
        self.place[order] = np.arange(len(words), dtype=np.int32)
        self.codes, self.sizes = np.array(codes, dtype=np.int32), np.array(sizes, dtype=np.int64)
        self.words, self.bucket = [words[i] for i in order.tolist()], bucket[order]
        digest = xxhash.xxh3_128(repr(ids).encode())
        for t in texts:
            digest.update(len(t).to_bytes(8, "little"))
            digest.update(t)
        self.key = digest.hexdigest()

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in order, and words per text."""
        heads = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[self.which]
        sequence = self.place[self.codes[concat_ranges(heads[self.which], sizes)]] if len(self.place) else np.zeros(0, dtype=np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return sequence, np.diff(ends[np.concatenate([[0], np.cumsum(self.counts)])])


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, limit: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch, texts in slices(batches, limit=limit):
        yield batch, Block(batch.column(0).to_pylist(), texts, pattern, buckets)


def _asks(pattern: str, buckets: int, limit: int):
    """Per block and bucket: the distinct words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, pattern, buckets, limit):
            cuts = np.flatnonzero(np.diff(block.bucket)) + 1
            heads = np.concatenate([[0], cuts]) if len(block.bucket) else cuts
            rows = []
            for a, b in zip(heads.tolist(), [*cuts.tolist(), len(block.bucket)], strict=False):
                words = block.words[a:b]
                sizes = np.fromiter(map(len, words), dtype="<u4", count=len(words))
                rows.append((block.key, int(block.bucket[a]), _zip(len(words).to_bytes(4, "little") + sizes.tobytes() + b"".join(words))))
            if rows:
                yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows]), "bucket": pa.array([r[1] for r in rows], pa.int32()), "words": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _sequences(pattern: str, buckets: int, limit: int):
    """Per block: document ids, words per document and word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, pattern, buckets, limit):
            sequence, lengths = block.sequence()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block.key]), "ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([pack_numbers(lengths)], pa.binary()), "sequence": pa.array([pack_numbers(sequence)], pa.binary()), "words": pa.array([len(block.words)], pa.int64())})

    return run


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding of a rank file without special tokens, one per worker."""
    if path not in _ENCODINGS:
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return _ENCODINGS[path]


def _answers(path: str, pattern: str):
    """Each bucket's distinct words encoded once; ids go back to every block that asked. Rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        now, known = None, {}
        for batch in batches:
            sizes_out, ids_out = [], []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                raw = _unzip(packed)
                n = int.from_bytes(raw[:4], "little")
                sizes = np.frombuffer(raw, dtype="<u4", count=n, offset=4)
                ends = (4 + 4 * n + np.cumsum(sizes, dtype=np.int64)).tolist()
                got = []
                for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True):
                    w = raw[a:b]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w.decode())
                    got.append(ids)
                sizes_out.append(pack_numbers(np.fromiter(map(len, got), dtype=np.uint32, count=n)))
                ids_out.append(pack_numbers(np.array([i for ids in got for i in ids], dtype=np.uint32)))
            yield pa.RecordBatch.from_pydict({"block": batch.column(0), "bucket": batch.column(1), "sizes": pa.array(sizes_out, pa.binary()), "tokens": pa.array(ids_out, pa.binary())})

    return run


def _assemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block: ids joined to its sequences by word number and put in order."""
    order = np.argsort(right.column("bucket").to_numpy(), kind="stable") if len(right) else []
    sizes, tokens, last = [], [], None
    for i in order:
        bucket = right.column("bucket")[i].as_py()
        if bucket != last:  # an equal block asked twice
            sizes.append(unpack_numbers(right.column("sizes")[i].as_py()))
            tokens.append(unpack_numbers(right.column("tokens")[i].as_py()))
        last = bucket
    size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, dtype=np.int64)
    token = (np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint32)).astype(np.int32)
    heads = np.cumsum(size) - size
    ids_out, lists = [], []
    for row in left.to_pylist():
        if row["words"] != len(size):
            raise RuntimeError("a block was made differently when it was computed again: its input is not deterministic")
        seq, lengths = unpack_numbers(row["sequence"]), unpack_numbers(row["lengths"]).astype(np.int64)
        ids_out += row["ids"]
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):  # some documents at a time
            begin = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + AT_A_TIME)))
            some = seq[begin : ends[last - 1]]
            mine = size[some]
            flat = token[concat_ranges(heads[some], mine)]
            at = np.concatenate([[0], np.cumsum(mine)])[np.concatenate([[0], np.cumsum(lengths[first:last])])]
            lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)))
            first = last
    return pa.table({"doc_id": pa.array(ids_out, pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text), as the tiktoken library would encode its whole text.

    Null and empty texts have no ids. Repeated rows and rows without doc_id
    are encoded like others. Very long texts form a block of their own. Empty
    table: no rows. Other columns are ignored.
    """
    path = ranks or public_tokenizers.path(RANKS)
    # A batch is a block.
    rows = bounded(docs, BLOCK_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, max(1, -(-size // bucket_bytes))))
    asks = rows.mapInArrow(_asks(pattern, buckets, block_bytes), "block string, bucket int, words binary")
    answers = asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers(path, pattern), "block string, bucket int, sizes binary, tokens binary")
    sequences = rows.mapInArrow(_sequences(pattern, buckets, block_bytes), "block string, ids array<long>, lengths binary, sequence binary, words long")
    return sequences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble, "doc_id long, ids array<int>")


def _objects(values: dict[int, object]) -> np.ndarray:
    """A table by id."""
    out = np.empty(max(values, default=-1) + 1, dtype=object)
    for i, v in values.items():
        out[i] = v
    return out


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and decimal text of every id, read once per worker."""
    if path not in _TABLES:
        ranks = load_ranks(path)
        _TABLES[path] = _objects({i: b for b, i in ranks.items()}), _objects({i: str(i) for i in ranks.values()})
    return _TABLES[path]


def _decoder(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of, plain = _tables(path)
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            n, shas, out = [], [], []
            for a, b, k in zip(ends[:-1].tolist(), ends[1:].tolist(), known.tolist(), strict=True):
                ids = flat[a : b if k else a]
                text = b"".join(bytes_of[ids].tolist())
                n.append(len(ids))
                out.append(hashlib.sha256(text).hexdigest() if digest else text)
                if digest:
                    shas.append(hashlib.sha256(",".join(plain[ids].tolist()).encode()).hexdigest())
            if digest:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(out, pa.string())})
            else:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(out, pa.binary())})

    return run


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, text as binary) of (doc_id, ids): each id joined with the token-byte table, a file of fixed size. Null ids: no bytes."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(ranks or public_tokenizers.path(RANKS), False), "doc_id long, text binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"))
    return encoded.mapInArrow(_decoder(public_tokenizers.path(RANKS), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
