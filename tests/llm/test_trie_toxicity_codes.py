"""Conversation trie, toxicity and vector codes: brute force, odd input, held-out rows."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from cityweave.llm import codes, prefix_trie, queries, toxicity

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string, k1 string"


def brute_trie(rows):
    """Straight from the contract's words."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = said.get(base, [])[:h] + said[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for key, who in members.items():
        inside = [k for k in members if k[: len(key)] == key]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(key))
        out[min(who), len(key)] = (
            min(members[key[:-1]]) if key else None, len(who), sum(len(k) == len(key) + 1 for k in inside), sum(map(leaf, inside)),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in inside if k), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def trie(spark, rows, monkeypatch=None, **sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(prefix_trie, k, v)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = prefix_trie.conversation_trie(df.repartition(3)).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(found) == len(got)
    return found


def test_trie_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(95, 125), *range(200, 203), 777, -5, -150]:
        n = rng.choice([1, 2, 3, 5, 8, 9, 17])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", None])) for t in range(n)]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(20)]  # a long opening that many share
    rows += [(400, t, "user", "deep") for t in range(70)] + [(None, 0, "user", "no id")]
    rows += [(500, None, "user", "first"), (500, 0, "user", "second"), (500, 0, "user", "second")]
    monkeypatch.setattr(prefix_trie.subtree_sums, "__defaults__", (3,))
    assert trie(spark, rows, monkeypatch, BLOCK=4, CHUNK=7) == brute_trie(rows)


def test_trie_of_one_long_conversation(spark):
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(700)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie(spark, []) == {}
    short = next(c for c in range(1, 90) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "gone: the opening is longer")]
    assert trie(spark, rows) == brute_trie(rows) == {(short, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_vector_codes"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def brute_codes(vectors, labels, parts=8, entries=16, rounds=6):
    """Python integers throughout; vectors in the order of their ids."""
    q = [[int(np.floor(4096 * x)) for x in v] for v in vectors]
    width = -(-max(map(len, q)) // parts) * parts
    q = [v + [0] * (width - len(v)) for v in q]
    step = width // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    books = [[cut(v)[p] for v in q[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(cut(v)[p], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[best(v, p)[1] for v in q] for p in range(parts)]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [cut(v)[p] for v, a in zip(q, at[p], strict=True) if a == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[best(v, p) for p in range(parts)] for v in q]
    error = [sum(d for d, _ in f) for f in found]
    by = [sum(e for e, x in zip(error, labels, strict=True) if x == y) for y in labels]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{i:02x}" for _, i in f) for f in found], error, by, digest


VECTORS = "vec_id long, embedding array<double>, label int, code string, q string"


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e12])
def test_codes_against_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 21)) * scale
    x[40:60] = x[3]  # copies, more than there are entries
    vectors = [v.tolist() for v in x] + [[0.0] * 21, [1.0, -2.0], []]
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(vectors))]
    odd = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 21, 1), (903, [float("inf")] * 21, 1)]
    rows = [(i, v, y) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))] + odd
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(4)
    got, books = codes.compress(df)
    code, error, by, digest = brute_codes(vectors, labels)
    capped = [min(e, 2**63 - 1) for e in error], [min(e, 2**63 - 1) for e in by]
    found = {r.id: (r.code, r.error) for r in got.collect()}
    assert found == dict(enumerate(zip(code, capped[0], strict=True))) and books.digest() == digest
    if scale < 1e6:
        assert {r.id: r.label_error for r in got.collect()} == dict(enumerate(capped[1]))


def test_codes_of_few_rows_and_none(spark):
    none, books = codes.compress(spark.createDataFrame([(1, None, 1, "", "")], VECTORS))
    assert none.count() == 0 and books is None
    got, books = codes.compress(spark.createDataFrame([(2, [0.5, -0.25], None, "", ""), (None, [1.0, 1.0], 3, "", "")], VECTORS))
    rows = got.collect()
    assert sorted((r.id is None, r.code, r.error) for r in rows) == [(False, "00" * 8, 0), (True, "0101" + "00" * 6, 0)]
    assert {tuple(r.vector[:2]) for r in codes.decoded(got, books).collect()} == {(0.5, -0.25), (1.0, 1.0)}


def test_limbs_give_exact_products():
    rng = np.random.default_rng(0)
    for most in (3, 4095, 4096, 1 << 20, 1 << 27):
        x, y = rng.integers(-most, most + 1, (200, 9)), rng.integers(-most, most + 1, (17, 9))
        assert (codes.dots(x, y).astype(object) == x.astype(object) @ y.astype(object).T).all()
        at, far = codes.nearest(x, np.vstack((y, y)))  # equal entries: the first one
        plain = ((x[:, None] - y[None]).astype(object) ** 2).sum(axis=2)
        assert (at == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_on_held_out_rows(spark):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.1")
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = got.toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got.predicted == (got.score >= 0.5).astype(int)).all()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    held = got.join(labels, how="inner").query("held_out")
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = ((toxic[:, None] > clean).sum() + 0.5 * (toxic[:, None] == clean).sum()) / (len(toxic) * len(clean))
    assert auc > 0.97 and (clean >= 0.5).mean() < 0.02 and (toxic >= 0.5).mean() > 0.88


def _talk(rng, bad=()):
    words = [rng.choice(["the", "weather", "today", "river", "seems", "calm", "garden", "music", "slowly", "train"]) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 120))]
    for w in bad:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


def test_misspelt_words_and_long_texts():
    rng = random.Random(2)
    texts = [_talk(rng) for _ in range(150)] + [_talk(rng, rng.choices(["blockhead", "nincompoop", "numbskull"], k=5)) for _ in range(60)]
    model = toxicity.fit(texts, np.array([0] * 150 + [1] * 60))
    calm, unseen = model.score(_talk(rng)), model.score("today the weather seems calm you bl0ckhead and numbskulll")
    assert calm < 0.5 < unseen
    long = " ".join(_talk(rng) for _ in range(4000))
    assert model.score(long) < 0.5
    assert model.score(None) == model.score("") == model.score(" \n\t") and 0 <= model.score("") <= 1
    assert 0 <= model.score("x" * 2_000_000) <= 1


def test_gram_windows_cut_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [_talk(rng) for _ in range(40)] + [_talk(rng, ["blockhead"] * 4) for _ in range(40)]
    model = toxicity.fit(texts, np.array([0] * 40 + [1] * 40))
    text = " ".join(texts) + " " + "y" * 500
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "WINDOW", 1000)
    assert model.score(text) == pytest.approx(whole, abs=1e-9)


def test_toxicity_on_odd_rows(spark, nasty):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(nasty, toxicity.train(nasty, labels))
    assert got.columns.count("score") == 1 and got.count() == nasty.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    for known in (labels.where("toxic = 1"), labels.limit(0)):
        rows = toxicity.score(nasty, toxicity.train(nasty, known)).collect()
        assert len({r.score for r in rows}) == 1
    assert toxicity.score(nasty.limit(0), toxicity.train(nasty.limit(0), labels)).count() == 0
