"""N-gram Jaccard join over globally ordered sets in prefix trees.

1. Every text becomes its set of k-word shingles (64-bit hashes).  Sets travel as
   packed blobs of (document, shingle), dealt by the low bits of the shingle hash; 48
   further bits travel, so two shingles are told apart by those and the part's number
   (53 bits at 8 shuffle partitions, 64 from 16,384 on).
2. Where a shingle's whole list is, its document frequency is known.  Shingles of
   one document only cannot be shared; of those only the number goes back.  The
   others return to their documents with their frequency.
3. The global order is (frequency, hash).  A set of n shingles that has a partner
   of the wanted similarity shares one of its first n - ceil(t n) + 1 shingles with
   it, so sets whose prefix is all unshared are done.  The rest post their prefix.
4. Sets that meet at a posted shingle, directly or over others, lie together in one
   task if they hold at most BLOCK shingles.  A larger group is parted: two sets that
   meet at a shingle posted by at most LIGHT sets are compared as a pair; sets that
   meet at shingles posted by more form groups of their own, cut into blocks of
   about BLOCK shingles, and each pair of blocks goes to a task of its own.  So chains
   of sets that share little are never compared all with all.
5. In a task, the sets of one block stand in a prefix tree: the walk goes from a range
   of sorted sequences to the ranges that go on with the same shingle.  A node holds
   the overlap with those sets of the other block that can still reach what they
   need with the longest set below the node; when none can, the subtree is left.
6. Links become components.  Texts with the same set are one class from step 3 on,
   so copies are never compared with each other.

Null and empty texts (and texts of blanks) have the empty set: 0 shingles, own
component.  Rows that repeat an id are returned one by one.  Rows with a null id
take no part and get a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions, small_batches
from .graph import UnionFind, components, forest_edges
from .pretokens import taken
from .shingles import fingerprint, shingle_sets
from .streams import runs

#: Shingles that a writer gathers before it sends blobs, and documents at most.
CHUNK, CHUNK_DOCS = 1 << 20, 60_000
#: Shingles of a block in a candidate group.
BLOCK = 100_000
#: Sets at a shingle of a large group up to which they are compared in pairs.
LIGHT = 8
#: Shingles of a path that are taken at a time.
STEP = 64


def prefix_length(n, percent: int):
    """n - ceil(percent * n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _frequencies(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, fp, unshared, shared): steps 1 to 3, one row per input row.

    shared: the shingles of two or more documents in global order; null where the
    prefix is all unshared."""
    spark = rows.sparkSession
    parts = 4 * shuffle_partitions(spark)
    shift = max(16, (parts - 1).bit_length())
    low = np.uint64((1 << shift) - 1)
    blob = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
    kind = "part int, chunk bigint, data binary"

    def spread(batches):
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 24, 0
        ids, sets, size = [], [], 0

        def made():
            lengths = np.array([len(s) for s in sets], np.int64)
            known = np.array([i is not None for i in ids], np.uint8)
            head = [np.array([len(ids)], "<i8"), np.array([i or 0 for i in ids], "<i8"), known, lengths.astype("<i4")]
            header = b"".join(x.tobytes() for x in head) + b"".join(fingerprint(s) for s in sets)
            chunk = base + number
            out = [(-1 - chunk % parts, chunk, header)]
            taken = np.where(known > 0, lengths, 0)
            h = np.concatenate([s for s, use in zip(sets, known, strict=True) if use] or [np.empty(0, np.uint64)])
            doc = np.repeat(np.arange(len(sets)), taken).astype("<u2")
            part = ((h & low) * np.uint64(parts)) >> np.uint64(shift)
            order = np.argsort(part.astype(np.uint32), kind="stable")
            key, doc, part = (h >> np.uint64(shift))[order], doc[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = cut[p], cut[p + 1]
                if b > a:
                    x = key[a:b]
                    out.append((p, chunk, doc[a:b].tobytes() + (x & np.uint64(0xFFFF)).astype("<u2").tobytes() + (x >> np.uint64(16)).astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(blob)], schema=blob)

        for batch in batches:
            ids += batch.column(0).to_pylist()
            got = shingle_sets(batch.column(1).to_pylist(), k)
            sets += got
            size += sum(map(len, got))
            if size >= CHUNK or len(ids) >= CHUNK_DOCS - 1000:
                yield made()
                number, ids, sets, size = number + 1, [], [], 0
        if ids:
            yield made()

    def count(batches):
        for (part,), group in runs(batches, ["part"]):
            chunks, data = group.column("chunk").to_pylist(), group.column("data").to_pylist()
            if part < 0:  # headers pass through
                for c, d in zip(chunks, data, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([c], pa.int64()), pa.array([d], pa.binary())], schema=blob)
                continue
            sizes = [len(d) // 8 for d in data]
            doc = np.concatenate([np.frombuffer(d, "<u2", n) for d, n in zip(data, sizes, strict=True)])
            key = np.concatenate([np.frombuffer(d, "<u2", n, 2 * n).astype(np.uint64) | (np.frombuffer(d, "<u4", n, 4 * n).astype(np.uint64) << np.uint64(16)) for d, n in zip(data, sizes, strict=True)])
            which = np.repeat(np.arange(len(data), dtype=np.int32), sizes)
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
            df = np.diff(np.concatenate((np.flatnonzero(first), [len(sorted_)])))
            df = np.repeat(df, df)
            shared = df > 1
            order, df = order[shared], np.minimum(df[shared], 65535).astype("<u2")
            token = (sorted_[shared] << np.uint64(shift)) | np.uint64(part)
            by_chunk = np.argsort(which[order], kind="stable")
            order, df, token = order[by_chunk], df[by_chunk], token[by_chunk]
            cut = np.searchsorted(which[order], np.arange(len(data) + 1))
            for c, a, b in zip(chunks, cut[:-1], cut[1:], strict=True):
                if b > a:
                    body = doc[order[a:b]].tobytes() + df[a:b].tobytes() + token[a:b].astype("<u8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([c], pa.int64()), pa.array([body], pa.binary())], schema=blob)

    done = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("unshared", pa.int64()), ("shared", pa.list_(pa.int64()))])

    def assemble(batches):
        for _, group in runs(batches, ["chunk"]):
            part, data = group.column("part").to_pylist(), group.column("data").to_pylist()
            head = data[part.index(-1)]
            n = int(np.frombuffer(head, "<i8", 1)[0])
            ids, known, size = np.frombuffer(head, "<i8", n, 8), np.frombuffer(head, np.uint8, n, 8 + 8 * n) > 0, np.frombuffer(head, "<i4", n, 8 + 9 * n).astype(np.int64)
            prints = [head[8 + 13 * n + 16 * i :][:16] for i in range(n)]
            body = [(d, len(d) // 12) for p, d in zip(part, data, strict=True) if p >= 0]
            doc = np.concatenate([np.frombuffer(d, "<u2", m) for d, m in body] or [np.empty(0, "<u2")])
            df = np.concatenate([np.frombuffer(d, "<u2", m, 2 * m) for d, m in body] or [np.empty(0, "<u2")])
            token = np.concatenate([np.frombuffer(d, "<u8", m, 4 * m) for d, m in body] or [np.empty(0, "<u8")])
            shared = np.bincount(doc, minlength=n)
            wanted = (shared > 0) & (size - shared < prefix_length(size, percent))
            keep = wanted[doc]
            doc, df, token = doc[keep], df[keep], token[keep]
            order = np.lexsort((token, df, doc))
            ends = np.cumsum(np.bincount(doc, minlength=n))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(token[order].view(np.int64)), mask=pa.array(~wanted))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(size), pa.array(prints, pa.binary()), pa.array(size - shared), lists], schema=done)

    n = shuffle_partitions(spark)
    blobs = rows.mapInArrow(spread, kind).repartition(n, "part").sortWithinPartitions("part", "chunk")
    back = blobs.mapInArrow(count, kind).repartition(n, "chunk").sortWithinPartitions("chunk", "part")
    return back.mapInArrow(assemble, "doc_id bigint, n bigint, fp binary, unshared bigint, shared array<bigint>")


class Block:
    """Sets (in global order) of one block and their total sizes."""

    def __init__(self, ids: list[int], sizes: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes, self.sets = ids, np.array(sizes, np.int64), sets


def tree_join(left: Block, right: Block | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of left x right (or inside left) with Jaccard >= percent / 100.

    The sets' shingles stand in an order that all sets share."""
    other = right or left
    numbers, where = np.unique(np.concatenate(left.sets), return_inverse=True)
    ends = np.cumsum([0, *map(len, left.sets)])
    seqs = [where[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    # the sets of the other block at each shingle
    flat = np.concatenate(other.sets)
    at = np.minimum(np.searchsorted(numbers, flat), len(numbers) - 1)
    met = numbers[at] == flat
    owner = np.repeat(np.arange(len(other.sets)), [len(s) for s in other.sets])[met]
    by = np.argsort(at[met], kind="stable")
    owner, first = owner[by], np.searchsorted(at[met][by], np.arange(len(numbers) + 1))
    order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
    seqs = [seqs[i] for i in order]
    length, size = np.array([len(s) for s in seqs]), left.sizes[order]
    n = len(other.sets)

    def need(own: int, ids: np.ndarray) -> np.ndarray:  # 100 o >= percent (a + b - o)
        return -(-percent * (own + other.sizes[ids]) // (100 + percent))

    smallest = int(other.sizes.min())
    found: list[tuple[int, int]] = []
    none = np.empty(0, np.int64)
    stack = [(0, len(seqs), 0, none, none)]
    while stack:
        lo, hi, depth, ids, count = stack.pop()
        path, last = seqs[lo], seqs[hi - 1]
        shared = min(len(path), len(last))
        differ = np.flatnonzero(path[:shared] != last[:shared])
        shared = int(differ[0]) if len(differ) else shared
        longest, least = int(length[lo:hi].max()), int(size[lo:hi].min())
        enter = -(-percent * (least + smallest) // (100 + percent))
        while depth < shared:
            some = path[depth : min(shared, depth + STEP)]
            sizes = first[some + 1] - first[some]
            got = taken(owner, first[some], sizes)
            if longest - depth < enter:  # too late for sets that were not met before
                place = np.searchsorted(ids, got)
                place = place[(place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == got)] if len(ids) else none
                count = count + np.bincount(place, minlength=len(ids)) if len(ids) else count
            elif 8 * (len(got) + len(ids)) < n:
                ids, place = np.unique(np.concatenate((ids, got)), return_inverse=True)
                count = np.bincount(place, np.concatenate((count, np.ones(len(got), np.int64))), len(ids)).astype(np.int64)
            else:
                dense = np.bincount(got, minlength=n)
                dense[ids] += count
                ids = np.flatnonzero(dense)
                count = dense[ids]
            depth += len(some)
            alive = count + (longest - depth) >= need(least, ids)
            ids, count = ids[alive], count[alive]
            if not len(ids) and longest - depth < enter:
                break
        if depth < shared or not len(ids) and longest - depth < enter:
            continue
        while lo < hi and length[lo] == shared:  # sets that end here
            hit = ids[count >= need(int(size[lo]), ids)]
            found += [(order[lo], q) for q in hit.tolist() if right is not None or q > order[lo]]
            lo += 1
        if lo < hi:
            heads = np.array([s[shared] for s in seqs[lo:hi]])
            cuts = [lo, *(np.flatnonzero(heads[1:] != heads[:-1]) + lo + 1).tolist(), hi]
            stack += [(a, b, shared, ids, count) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return found


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) among (id, n, unshared, shared) that span what its links join."""
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - F.col("unshared")
    posted = sets.withColumn("pre", prefix.cast("int")).select("id", "n", F.size("shared").alias("m"), F.explode(F.expr("slice(shared, 1, pre)")).alias("token"))
    member = materialize(_groups(posted, sets.select("id", F.size("shared").alias("m"))), "candidates")
    small = _blocked(member.where(F.col("total") <= BLOCK), sets, percent)
    large = member.where(F.col("total") > BLOCK).select("id")
    if large.isEmpty():
        return small
    crowd = materialize(posted.join(large, "id"), "crowded")
    met = crowd.groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    light = crowd.join(met.where((F.col("sets") > 1) & (F.col("sets") <= LIGHT)), "token").select("token", "id", "n")
    heavy = crowd.join(met.where(F.col("sets") > LIGHT), "token").drop("sets")
    pairs = light.select("token", F.col("id").alias("a"), F.col("n").alias("na")).join(light.select("token", F.col("id").alias("b"), F.col("n").alias("nb")), "token")
    pairs = pairs.where((F.col("a") > F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b").distinct()
    of = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("shared").alias(f"s{side}"))
    overlap = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(overlap * 100 >= (F.col("na") + F.col("nb") - overlap) * percent).select("a", "b")
    grouped = materialize(_groups(heavy, heavy.select("id", "m").distinct()), "crowded-candidates")
    return small.union(near).union(_blocked(grouped, sets, percent))


def _groups(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, component, m, total) of the sets that meet others at posted shingles."""
    least = posted.groupBy("token").agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b < top")
    meet = posted.select("token", "id").join(least.select("token", "b"), "token").where("id > b").select(F.col("id").alias("a"), "b")
    member = sizes.join(components(forest_edges(meet)), "id").select("id", "component", "m")
    return member.join(member.groupBy("component").agg(F.sum("m").alias("total")), "component")


def _blocked(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning edges of the links inside each group, one task for each pair of blocks."""
    n = shuffle_partitions(sets.sparkSession)
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    placed = member.select("id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    ready = pairs.join(sets.select("id", "n", "shared"), "id")

    def join_blocks(batches):
        for (_, i, j), group in runs(batches, ["component", "i", "j"]):
            block = np.array(group.column("block").to_pylist())
            ids, sizes = group.column("id").to_pylist(), group.column("n").to_pylist()
            lists = group.column("shared").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            values, cut = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            take = lambda rows: Block([ids[r] for r in rows], [sizes[r] for r in rows], [values[cut[r] : cut[r + 1]] for r in rows])  # noqa: B023, E731
            left = take(np.flatnonzero(block == i))
            right = take(np.flatnonzero(block == j)) if j != i else None
            if not left.ids or right is not None and not right.ids:
                continue
            known = sorted({*left.ids, *(right.ids if right else ())})
            place = {x: k for k, x in enumerate(known)}
            sets_ = UnionFind(len(known))
            edges = [(left.ids[x], (right or left).ids[y]) for x, y in tree_join(left, right, percent) if sets_.union(place[left.ids[x]], place[(right or left).ids[y]])]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    dealt = ready.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    return dealt.select("component", "i", "j", "block", "id", "n", "shared").mapInArrow(join_blocks, "a bigint, b bigint")


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per input row.

    Two texts link when 100 * |intersection| >= percent * |union| of their word
    shingles; component_id is the least id that links reach."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sets = materialize(_frequencies(rows, words, percent), "shingle-sets")
    filled = sets.where("n > 0 and doc_id is not null")
    classes = materialize(filled.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "fp")
    chosen = (
        sets.where("shared is not null and doc_id is not null").withColumnRenamed("doc_id", "id").join(reps, ["id", "fp"]).dropDuplicates(["id", "fp"]).select("id", "n", "unshared", "shared")
    )
    found = components(links(materialize(chosen, "candidate-sets"), percent))
    in_class = sets.select("doc_id", "n", "fp").join(classes, "fp", "left")
    # several texts may bear one id: what any of them reaches counts for the id
    merged = in_class.where("n > 0 and doc_id is not null").join(found.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return sets.select("doc_id", "n").join(merged, "doc_id", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
