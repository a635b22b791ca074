"""The registered opN_ queries and the pipeline's stages: columns, digests and effects."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityweave.llm import chat, mixing, near_vectors, ngram_join, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FIRST = {
    "op1_secret_scans": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_embedding_near_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_bpe_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op10_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in FIRST[name]} == FIRST[name]
    return df.toPandas()


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def base_spans(text):
    """Straight from the contract's words."""
    kinds = [
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
        ("access", r"AKIA[A-Z0-9]+", 18, 0),
        ("hex", r"[0-9a-f]+", 16, 0),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, least, g) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= least]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secret_digests(spark):
    texts, got = documents(spark), run(spark, "op1_secret_scans")
    assert len(got) == len(texts)
    for r in got.itertuples():
        base = base_spans(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_neighbours_are_ranked(spark):
    got = run(spark, "op2_nearest_neighbours")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert set(got.query_id) == {i for i in rows if i % 20 == 0}
    right = total = 0
    for q, part in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        score = {i: float((rows[q] * v).sum()) for i, v in rows.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, [score[i] for i in part.vec_id], atol=1e-12)
        right, total = right + len(set(best) & set(part.vec_id)), total + 20
    assert right >= 0.95 * total


def test_links_against_brute_force(spark):
    got = run(spark, "op6_embedding_near_dedup").set_index("vec_id")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    assert (got.loc[ids].n_links.to_numpy() == near.sum(axis=1) - 1).all()
    assert (got.kept == (got.index == got.component_id)).all()


def test_held_out_rows_and_predictions(spark):
    got = run(spark, "op8_quality_classifier")
    assert len(got) == len(documents(spark)) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3).astype(int)).all()


def test_formatted_conversations(spark):
    got = run(spark, "op9_chat_formatting").set_index("conv_id")
    turns = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got.index) == set(turns)
    for conv, said in turns.items():
        learnt = "".join(t for role, t in said if role == "assistant")
        r = got.loc[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_conversations_without_an_id(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert got == {None: (2, 1), 3: (1, 0)}


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op5_html_extraction", "op7_bpe_codec", "op10_token_files"])
def test_columns(spark, name):
    got = run(spark, name)
    table, key = ("pages", "page_id") if name.startswith("op5") else ("documents", "doc_id")
    assert sorted(got[key]) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    if name.startswith("op5"):
        assert (got.n_chars == got.text.str.len()).all()


def test_mix_is_in_the_order_of_its_places(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.when(F.col("id") < 500, "a").otherwise("b").alias("source"))
    got = [r.doc_id for r in mixing.mix(docs, target_entropy=0.99, max_repeat=4.0).collect()]
    rows = mixing.token_rows(docs)
    placed = mixing.drawn(rows, mixing.mixing_plan(rows, 0.99, 4.0)).select("id", "place").collect()
    assert got == [r.id for r in sorted(placed, key=lambda r: r.place)]
    assert got != sorted(got) and {d for d in got} == set(range(600))


def test_chains_and_crowds_are_parted(spark, monkeypatch):
    """Large groups: texts that each share a little with the next, and near copies."""
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    chain = [(i, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 6))) for i in range(200)]
    crowd = [(1000 + i, " ".join(f"v{j}" if j != i % 60 else f"x{i}" for j in range(120))) for i in range(60)]
    df = spark.createDataFrame(chain + crowd, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(df, words=4, percent=85).collect()}
    assert all(got[i] == i for i, _ in chain) and {got[i] for i, _ in crowd} == {1000}


def test_forest_finds_pairs_at_the_limit():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((3000, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = rng.standard_normal(u.shape)
    v -= (v * u).sum(axis=1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    forest = near_vectors.Forest(u, 2_000_000, 0.95)
    of = lambda x: [set(part.tolist()) for part in np.split(*(lambda row, leaf, by: (leaf[by], np.searchsorted(row[by], np.arange(1, len(x)))))(*(lambda p: (*p, np.argsort(p[0], kind="stable")))(forest.leaves(x))))]
    a, b = of(u), of(0.951 * u + np.sqrt(1 - 0.951**2) * v)
    assert sum(not (x & y) for x, y in zip(a, b, strict=True)) <= 12
    assert np.mean([len(x) for x in a]) <= 2 * np.log2(2_000_000)


def test_pipeline_stages(spark, nasty):
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]
    words = " ".join(f"word{i}" for i in range(60))
    secret = "token = abcdef1234567890abcdef"
    rows = [(1, words), (2, words + " end"), (3, f"{secret} and {secret}"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages["near_duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5] and kept.columns == docs.columns
    clean = {r.doc_id: r for r in stages["secrets"](spark, kept, SF).collect()}
    assert "abcdef1234" not in clean[3].text and clean[3].n_chars == len(clean[3].text) and clean[1].text == words and clean[4].text is None
    mixed = stages["mixing"](spark, docs, SF)
    assert {r.doc_id for r in mixed.collect()} == {1, 2, 3, 4, 5} and mixed.columns == docs.columns
    coded = {r.doc_id: r.n_tokens for r in stages["encoding"](spark, docs, SF).collect()}
    assert set(coded) == {1, 2, 3, 4, 5} and coded[4] == coded[5] == 0 and coded[1] > 60
    good = stages["quality"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert 0 < good.count() <= len(documents(spark)) and good.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
