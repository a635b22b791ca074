"""Token-id files with Elias-Fano document boundaries.

The file format is a Parquet table of blocks, written by Spark's own writer, so
it can lie in any store that Spark reaches.  A block holds documents that are
neighbours in ascending id order:

  bucket, block      position: blocks ascend by (bucket, block)
  n_docs, n_ids      documents and ids in the block
  first_doc          the least document id
  last_doc           the greatest one
  n_null             rows without an id; they stand first
  docs               document ids as differences to first_doc, Elias-Fano coded
  ids                all ids one after another, `width` bytes each
  ef                 the n_docs + 1 boundaries, Elias-Fano coded (class EliasFano)

Boundaries take about 2 + log2(ids / documents) bits each instead of 64.  Blocks
are cut at BLOCK_IDS ids, so neither writer nor reader holds more than that
and one document.  Null and empty texts are the end id alone.  Rows that repeat
an id are kept, ordered by (id, digest of the ids).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, read_spec, with_specials
from .common import materialize, shuffle_partitions, small_batches
from .pretokens import Memory, taken

BLOCK_IDS = 1 << 20
#: Blocks up to which their offsets are broadcast (24 bytes each).
BROADCAST_BLOCKS = 1_000_000


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value.

    Low halves are packed at `low` bits each; high halves are unary in a bit
    vector, where a directory of the ones before each 512-bit superblock gives
    select without a scan of the whole."""

    SUPER = 512

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, directory: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.directory = n, low, lows, highs, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, (u // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        size = -(-(int(ones[-1]) + 1 if n else 1) // cls.SUPER) * cls.SUPER
        vector = np.zeros(size, np.uint8)
        vector[ones] = 1
        return cls(n, low, lows, np.packbits(vector, bitorder="little"), cls._directory(vector))

    @classmethod
    def _directory(cls, vector: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(vector.reshape(-1, cls.SUPER).sum(axis=1, dtype=np.int64)))).astype("<u4")

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.int64)
        a = first * self.low
        raw = np.unpackbits(self.lows[a // 8 : -(-(a + count * self.low) // 8)], bitorder="little")[a % 8 :]
        return (raw[: count * self.low].reshape(count, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value i: the position of one number i in the high bits, and the low bits."""
        s = int(np.searchsorted(self.directory, i, side="right")) - 1
        part = np.unpackbits(self.highs[s * self.SUPER // 8 : (s + 1) * self.SUPER // 8], bitorder="little")
        one = s * self.SUPER + int(np.flatnonzero(part)[i - int(self.directory[s])])
        return ((one - i) << self.low) | int(self._lows(i, 1)[0])

    def least(self, value: int) -> int:
        """The place of the first value that is not less than `value` (n if there is none)."""
        a, b = 0, self.n
        while a < b:
            mid = (a + b) // 2
            if self.select(mid) < value:
                a = mid + 1
            else:
                b = mid
        return a

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low) | self._lows(0, self.n)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low, len(self.lows), len(self.highs)], "<u4")
        return head.tobytes() + self.lows.tobytes() + self.highs.tobytes() + self.directory.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low, a, b = np.frombuffer(raw, "<u4", 4).tolist()
        at = 16
        return cls(n, low, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", offset=at + a + b))


class LibraryWords:
    """Ids by the tokenizers library, which encodes each distinct pre-token; joining the
    ids of a text's pre-tokens gives the ids of the text."""

    #: Words that go to the library in one call.
    LOT = 256

    def __init__(self, spec: str, width: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = Vocabulary(spec)
        self.kind = f"<u{width}"
        self.memory = Memory(self._learn, self.kind)
        of = self.vocabulary.token_bytes
        self.line_feed = self.vocabulary.byte_id[10]
        self.blank_led = np.array([of.get(i, b"")[:1] == b" " for i in range(max(of) + 1)])

    def _learn(self, pieces: list[str], letters: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Letters after a blank, or at the start of a line, are one pre-token, so these go
        to the library many at a time: only their first token starts with the blank, or
        the line feed between them is a token of its own."""
        led = [i for i, p in enumerate(pieces) if letters[i] and p[0] == " "]
        bare = [i for i, p in enumerate(pieces) if letters[i] and p[0] != " "]
        rest = [i for i in range(len(pieces)) if not letters[i]]
        order, ids, sizes = [*led, *bare, *rest], [np.empty(0, self.kind)], []
        for some, mark in ((led, ""), (bare, "\n")):
            lots = [some[i : i + self.LOT] for i in range(0, len(some), self.LOT)]
            for got in self.library.encode_batch_fast([mark + mark.join([pieces[i] for i in lot]) for lot in lots], add_special_tokens=False):
                x = np.array(got.ids, self.kind)
                head = x == self.line_feed if mark else self.blank_led[x]
                sizes.append(np.diff(np.flatnonzero(np.append(head, True))) - len(mark))
                ids.append(x[~head] if mark else x)
        got = self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)
        sizes.append(np.array([len(g.ids) for g in got], np.int64))
        flat, size = np.concatenate([*ids, *(np.array(g.ids, self.kind) for g in got)]), np.concatenate(sizes)
        # from the order in which they were encoded to that of the pieces
        start, place = np.cumsum(size) - size, np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return taken(flat, start[place], size[place]), size[place]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return with_specials(texts, self.vocabulary.split, self.vocabulary.special, self.memory)


def id_width(spec: str) -> int:
    import json

    data = json.loads(spec)
    top = max([*data["model"]["vocab"].values(), *(t["id"] for t in data.get("added_tokens", []))])
    return 2 if top < 1 << 16 else 4


_WORKER: dict[int, LibraryWords] = {}


def _words(spec: str, width: int) -> LibraryWords:
    key = hash(spec)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = LibraryWords(spec, width)
    return _WORKER[key]


def write_token_files(docs: DataFrame, vocabulary: str, label: str = "token-files", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, append end_id, and write the blocks in ascending id order.

    Returns the written table, read from its files.  One shuffle, of the encoded
    ids; its ranges come from quantiles of the id column (a scan of that column)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = read_spec(vocabulary)
    spec, width = spark.sparkContext.broadcast(text), id_width(text)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    buckets = 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    cuts = np.unique(np.array([x for x in cuts if x is not None], np.int64))
    end = np.array([end_id], f"<u{width}").tobytes()
    coded = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        for batch in batches:
            words = _words(spec.value, width)
            ids = [x.tobytes() + end for x in words.encode(batch.column(1).to_pylist())]
            doc = batch.column(0)
            where = np.searchsorted(cuts, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), doc, pa.array(ids, pa.binary())], schema=coded)

    block = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_null", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("ef", pa.binary())])

    def pack(batches):
        bucket, number, docs_, parts, size = None, 0, [], [], 0

        def made():
            known = [x for x in docs_ if x is not None]
            first, last = (known[0], known[-1]) if known else (None, None)
            ends = np.cumsum([0, *(len(p) // width for p in parts)])
            coded_docs = EliasFano.of(np.array([x - first for x in known], np.uint64)).to_bytes()
            row = [bucket, number, len(docs_), int(ends[-1]), width, first, last, len(docs_) - len(known), coded_docs, b"".join(parts), EliasFano.of(ends).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, block, strict=True)], schema=block)

        for batch in batches:
            for b, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if docs_ and (b != bucket or size >= BLOCK_IDS):
                    yield made()
                    number = number + 1 if b == bucket else 0
                    docs_, parts, size = [], [], 0
                bucket = b
                docs_.append(d)
                parts.append(ids)
                size += len(ids) // width
        if docs_:
            yield made()

    encoded = rows.mapInArrow(encode, "bucket int, doc_id bigint, ids binary")
    dealt = encoded.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("ids"))
    blocks = dealt.mapInArrow(pack, "bucket int, block int, n_docs bigint, n_ids bigint, width int, first_doc bigint, last_doc bigint, n_null bigint, docs binary, ids binary, ef binary")
    return materialize(blocks, label)


def read_token_files(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the blocks alone.

    Offsets of buckets are a running sum over at most 4 * shuffle partitions rows,
    those of the blocks inside a bucket a window by bucket."""
    inside = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("bucket", "block", "n_ids")
    totals = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("total"))
    before = totals.select("bucket", F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = (
        sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(before, "bucket")
        .select("bucket", "block", (F.col("before") + F.col("inner")).alias("base"))
    )
    few = blocks.count() <= BROADCAST_BLOCKS
    placed = blocks.join(F.broadcast(base) if few else base, ["bucket", "block"]).select("base", "width", "first_doc", "n_null", "docs", "ids", "ef")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano.from_bytes(row["ef"]).all()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
                doc = [None] * row["n_null"] + (EliasFano.from_bytes(row["docs"]).all() + (row["first_doc"] or 0)).tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], schema=out)

    return placed.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fetch(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents asked for, found by select: neither the ids nor the
    boundaries of a block are decoded as a whole.  Only blocks whose range of ids holds
    one that is asked for are read; rows that repeat an id are all returned."""
    wanted = sorted(set(doc_ids))
    ranges = F.exists(F.array(*[F.lit(d).cast("long") for d in wanted]), lambda d: d.between(F.col("first_doc"), F.col("last_doc")))
    near = blocks.where(F.col("last_doc") >= wanted[0]).where(F.col("first_doc") <= wanted[-1]).where(ranges) if wanted else blocks.limit(0)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, ends = EliasFano.from_bytes(row["docs"]), EliasFano.from_bytes(row["ef"])
                found: list[tuple[int, list[int]]] = []
                for d in wanted:
                    i = docs.least(d - row["first_doc"])
                    while i < docs.n and docs.select(i) == d - row["first_doc"]:
                        a, b = ends.select(i + row["n_null"]), ends.select(i + row["n_null"] + 1)
                        found.append((d, np.frombuffer(row["ids"], f"<u{row['width']}", b - a, a * row["width"]).tolist()))
                        i += 1
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], out[1].type)], schema=out)

    return near.select("width", "first_doc", "n_null", "docs", "ids", "ef").mapInArrow(look, "doc_id bigint, ids array<bigint>")
