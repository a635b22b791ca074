"""Byte-level BPE encoding and decoding with segment trees over pair ranks.

A piece (a pre-token) of n symbols gets a segment tree whose leaf i holds
rank(symbol i, symbol i+1) * size + i.  The root is the leftmost pair of the
lowest rank; merging it changes at most three leaves, each updated along one
path to the root.  Trees of many pieces of one size class are held side by
side in numpy arrays and step together, so a merge of thousands of pieces is a
few array operations; the few very long pieces have their trees walked one by one.

Null and empty texts encode to no ids.  The vocabulary file is read on the
driver and broadcast (about 2 MB, whatever the data).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches
from .pretokens import Memory

#: Stands for the rank of a pair that has no merge; above all ranks.
NO_MERGE = 1 << 20
#: Pieces of one size class up to which their trees are walked one by one.
FEW = 8


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Pair ranks and token bytes of a byte-level BPE file (JSON of the tokenizers library)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab, to_byte = data["model"]["vocab"], byte_symbols()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token_bytes = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.token_bytes |= {i: s.encode("utf-8") for s, i in self.special.items()}
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int32)
        pair = np.array([(vocab[a] << 24) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.rank_of: dict[int, int] = {}
        self.memory = Memory(self._learn, "<u4")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NO_MERGE where there is no merge or a symbol is missing (-1)."""
        key = (left.astype(np.int64) << 24) | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.rank[at], NO_MERGE)

    def _merge_all(self, sym: np.ndarray) -> np.ndarray:
        """sym: pieces by row, padded with -1 to a power-of-two width; merged in place."""
        rows, width = sym.shape
        kind = np.int32 if NO_MERGE * width < 1 << 31 else np.int64
        none = kind(NO_MERGE * width)
        tree = np.full((rows, 2 * width), none, kind)
        place = np.arange(width, dtype=kind)
        tree[:, width:-1] = np.minimum(self.ranks(sym[:, :-1], sym[:, 1:]).astype(kind) * kind(width) + place[:-1], none)
        lo = width
        while lo > 1:
            np.minimum(tree[:, lo : 2 * lo : 2], tree[:, lo + 1 : 2 * lo : 2], out=tree[:, lo // 2 : lo])
            lo //= 2
        # symbol i stands at column i + 1, so that the neighbours of the outermost exist
        line = np.full((rows, width + 2), -1, np.int32)
        line[:, 1:-1] = sym
        after = np.broadcast_to(np.arange(1, width + 3, dtype=np.int32), (rows, width + 2)).copy()
        before = np.broadcast_to(np.arange(-1, width + 1, dtype=np.int32), (rows, width + 2)).copy()
        flat, line_f, after_f, before_f = tree.ravel(), line.ravel(), after.ravel(), before.ravel()
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = flat[live * (2 * width) + 1]
            at, rank = root % width + 1, root // width
            base = live * (width + 2)
            here = base + at
            gone = after_f[here]
            then = after_f[base + gone]
            ahead = before_f[here]
            new = self.merged[rank]
            line_f[here] = new
            line_f[base + gone] = -1
            after_f[here] = then
            before_f[base + then] = at
            both = self.ranks(np.concatenate((new, line_f[base + ahead])), np.concatenate((line_f[base + then], new))).astype(kind)
            n, top = len(live), live * (2 * width) + width
            value = np.minimum(both[:n] * kind(width) + (at - 1), none)
            prior = np.minimum(both[n:] * kind(width) + (ahead - 1), none)
            flat[top + gone - 1] = none
            flat[top + at - 1] = value
            has = ahead >= 1
            flat[(top + ahead - 1)[has]] = prior[has]
            root_at = live * (2 * width)
            nodes = [gone - 1 + width, at - 1 + width, np.where(has, ahead - 1, at - 1) + width]
            size = width
            while size > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    k = root_at + x
                    two = k + x
                    flat[k] = np.minimum(flat[two], flat[two + 1])
                size >>= 1
            live = live[flat[root_at + 1] < none]
        return line[:, 1:-1]

    def _merge_one(self, sym: list[int]) -> list[int]:
        """One long piece: the same tree in a list, without array operations."""
        n = len(sym)
        width = 1 << (n - 1).bit_length()
        none = NO_MERGE * width
        first = np.minimum(self.ranks(np.array(sym[:-1]), np.array(sym[1:])) * width + np.arange(n - 1), none)
        levels = [np.concatenate((first, np.full(width - n + 1, none)))]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        if not self.rank_of:
            self.rank_of = dict(zip(self.pair.tolist(), self.rank.tolist(), strict=True))
            self.merged_list = self.merged.tolist()
        rank_of, merged = self.rank_of, self.merged_list
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, value: int) -> None:
            k = i + width
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b

        def rank(i: int, j: int) -> int:
            return rank_of.get((sym[i] << 24) | sym[j], NO_MERGE) * width + i if j < n else none

        while tree[1] < none:
            r, at = divmod(tree[1], width)
            gone = after[at]
            then, ahead = after[gone], before[at]
            sym[at], sym[gone], after[at] = merged[r], -1, then
            if then < n:
                before[then] = at
            put(gone, none)
            put(at, min(none, rank(at, then)))
            if ahead >= 0:
                put(ahead, min(none, rank(ahead, at)))
        return [x for x in sym if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit little-endian integers."""
        out = [b""] * len(pieces)
        single = self.byte_id.astype("<u4")
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) == 1:
                out[i] = single[p[0]].tobytes()
            elif p:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in classes.items():
            if len(members) <= FEW:
                for i in members:
                    out[i] = np.array(self._merge_one(self.byte_id[np.frombuffer(pieces[i], np.uint8)].tolist()), "<u4").tobytes()
                continue
            step = max(1, (1 << 20) // width)
            for k in range(0, len(members), step):
                some = members[k : k + step]
                raw = np.zeros((len(some), width), np.uint8)
                size = np.array([len(pieces[i]) for i in some])
                flat = np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)
                mask = np.arange(width) < size[:, None]
                raw[mask] = flat
                sym = self._merge_all(np.where(mask, self.byte_id[raw], np.int32(-1)))
                keep = sym >= 0
                ids, ends = sym[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(axis=1))).tolist()
                at = 0
                for i, end in zip(some, ends, strict=True):
                    out[i] = ids[at:end]
                    at = end
        return out

    def _learn(self, pieces: list[str], letters: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        got = self.encode_pieces([p.encode("utf-8", "replace") for p in pieces])
        return np.frombuffer(b"".join(got), "<u4"), np.array([len(x) // 4 for x in got], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; special tokens that occur in a text are single ids."""
        return with_specials(texts, self.split, self.special, self.memory)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def with_specials(texts: list[str | None], split, special: dict[str, int], memory: Memory) -> list[np.ndarray]:
    """Ids of each text; texts are cut at special tokens, which are single ids."""
    plain: list[str] = []
    shape: list[list[int]] = []  # per text: a special id, or -1 for the next plain part
    for text in texts:
        parts, at = [], 0
        for m in split.finditer(text) if text and split else ():
            if m.start() > at:
                plain.append(text[at : m.start()])
                parts.append(-1)
            parts.append(special[m[0]])
            at = m.end()
        if text and at < len(text):
            plain.append(text[at:])
            parts.append(-1)
        shape.append(parts)
    got = iter(memory.encode(plain))
    one = lambda p: next(got) if p < 0 else np.array([p], memory.kind)
    return [one(parts[0]) if len(parts) == 1 else np.concatenate([np.empty(0, memory.kind), *map(one, parts)]) for parts in shape]


_LOADED: dict[str, Vocabulary] = {}


def loaded(spec: str) -> Vocabulary:
    """The vocabulary of a worker, made once per process and file content."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of each whole text.  No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches):
        vocab = None
        for batch in batches:
            vocab = vocab or loaded(spec.value)
            ids = vocab.encode_batch(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], names=["id", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))

    def run(batches):
        for batch in batches:
            vocab = loaded(spec.value)
            texts = [vocab.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one
    pass, so that neither ids nor texts leave the worker."""
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        sha = hashlib.sha256
        decimal: list[str] = []
        for batch in batches:
            vocab = loaded(spec.value)
            decimal = decimal or [str(i) for i in range(max(vocab.token_bytes) + 1)]
            all_ids = [x.tolist() for x in vocab.encode_batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in all_ids], pa.int64()),
                    pa.array([sha(",".join([decimal[i] for i in ids]).encode()).hexdigest() for ids in all_ids]),
                    pa.array([sha(vocab.decode(ids).encode("utf-8")).hexdigest() for ids in all_ids]),
                ],
                schema=schema,
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
