"""Chat formatting and near-duplicate vectors against plain code; SQL of the registered queries."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroframe.llm import neardup
from aeroframe.llm.catalog import oracle_sql, queries
from aeroframe.llm.chat import CLOSE, MAPPINGS, OPEN, canonical_turns, chat_digests, fingerprint, format_turns, read_back, with_control_case
from aeroframe.llm.neardup import near_duplicates

SAYS = ["hi", "", None, "a\\b <|im_end|>\n <|im_start|>user\n", "</s>[INST] ok [/INST]", "<\\<\\\\[", "ends with <", "ends with \\", "ß 😀 < x", "\n\n", "long " * 30_000]


def chats(seed=0, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "assistant", None, "odd\nrole <|im_end|>", "system\\"]), rng.choice(SAYS)))
    return rows + rows[:3]


def test_chat(spark):
    rows = chats()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("r", F.lit("clash")).withColumn("layout", F.lit(1))
    got = {r.conv_id: r for r in chat_digests(with_control_case(table)).collect()}
    rows = rows + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (role or "").encode(), (text or "").encode(), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_digests(table.limit(0)).count() == 0


def test_no_control_string_survives_in_a_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", s) for i, s in enumerate(SAYS)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_turns(canonical_turns(table.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("r"))))
    row = formatted.first()
    assert row.formatted.count(OPEN) == row.formatted.count(CLOSE.strip()) == len(SAYS)
    for token in ("[INST]", "[/INST]", "</s>"):
        assert token not in row.formatted
    assert [s for s in read_back(formatted).first().loss] == [SAYS[i] or "" for i in range(1, len(SAYS), 2)]
    assert [row.formatted[s.start : s.end] for s in row.loss_mask][0] == "" and len(row.loss_mask) == len(SAYS) // 2


def test_layouts_become_turns(spark):
    records = {
        '{"prompt": "p", "response": "r"}': [("user", "p"), ("assistant", "r")],
        '{"completion": "c", "prompt": null}': [("user", None), ("assistant", "c")],
        '{"question": "q", "answer": 5}': [("user", "q"), ("assistant", "5")],
        '{"instruction": "i", "output": "o"}': [("user", "i"), ("assistant", "o")],
        '{"output": "o", "input": "x", "instruction": "i"}': [("user", "i\n\nx"), ("assistant", "o")],
        '{"instruction": "i", "input": "", "output": "o"}': [("user", "i"), ("assistant", "o")],
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}': [("system", "s"), ("user", "u")],
        '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}': [("user", "h"), ("assistant", "g")],
        '{"text": "x", "role": "user", "turn": 3}': [("user", "x")],
        '{"unknown": 1}': None,
        "not json": None,
        "[1, 2]": None,
    }
    table = spark.createDataFrame([(k,) for k in records], "json string").select("json", F.try_parse_json("json").alias("r"))
    for row in canonical_turns(table).select("json", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")).collect():
        assert (None if row.turns is None else [tuple(t) for t in row.turns]) == records[row.json], row.json
    counted = format_turns(canonical_turns(table).select(F.lit(1).alias("conv_id"), "turns")).first()
    assert counted.unknown == 3 and counted.formatted.count(OPEN) == 17
    assert len({fingerprint_value(spark, m.example) for m in MAPPINGS}) == len(MAPPINGS)
    assert fingerprint_value(spark, '{"a": {"b": 1, "c": "x"}}') == fingerprint_value(spark, '{"a": {"c": null, "b": 2.5}}') != fingerprint_value(spark, '{"a": {"b": 1}, "c": 1}')


def fingerprint_value(spark, json):
    return spark.range(1).select(fingerprint(F.parse_json(F.lit(json)))).first()[0]


def test_chat_stays_in_the_jvm(spark):
    table = spark.range(3).select(F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    assert "Python" not in chat_digests(with_control_case(table))._jdf.queryExecution().executedPlan().toString()


def vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    rows, knot = [], rng.standard_normal(dim)
    for i in range(n):
        kind = rng.integers(0, 10)
        v = rng.standard_normal(dim)
        if kind < 2:
            v = knot + 0.1 * rng.standard_normal(dim)
        elif kind < 4 and rows:
            v = np.array(rows[rng.integers(0, len(rows))][1]) * rng.choice([1.0, 2.0]) + 0.15 * rng.standard_normal(dim) * rng.integers(0, 2)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


def brute_vectors(rows, least=0.93):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float) / np.abs(v).max()
            good[k] = x / np.sqrt((x * x).sum())
    links = {k: [j for j in good if k in good and j != k and rows[k][2] == rows[j][2] and len(good[j]) == len(good[k]) and good[j] @ good[k] >= least] for k in range(len(rows))}
    out = {}
    for k in links:
        seen, left = {k}, [k]
        while left:
            for j in links[left.pop()]:
                if j not in seen:
                    seen.add(j)
                    left.append(j)
        out[k] = (rows[k][0], len(links[k]), min(rows[j][0] for j in seen))
    return sorted(out.values())


@pytest.mark.parametrize("tile", [2048, 20])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = vectors(1)
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [float("inf")] + [1.0] * 15, 1), (1005, rows[0][1], None), (1006, [], 1), (1007, rows[0][1], rows[0][2]), (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash")).withColumn("weight", F.lit(0))
    got = near_duplicates(table).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_duplicates(table.limit(0)).count() == 0


def test_forest_finds_what_it_splits(spark, monkeypatch):
    """Many leaves: recall against brute force, and nothing beyond it."""
    monkeypatch.setattr(neardup, "LEAF", 40)
    monkeypatch.setattr(neardup, "LEAST", 20)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((150, 32))
    rows = [(i, [float(x) for x in centres[i % 150] + 0.2 * rng.standard_normal(32)], 0) for i in range(900)]
    truth = {i: n for i, n, _ in brute_vectors(rows)}
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] <= truth[i] for i in truth) and sum(got.values()) >= 0.9 * sum(truth.values()) > 100


def test_large_leaves_are_split_again(spark, monkeypatch):
    """A sample far too small for the vectors: leaves stay small, recall high, and a knot is compared whole."""
    monkeypatch.setattr(neardup, "LEAF", 50)
    monkeypatch.setattr(neardup, "TILE", 60)
    monkeypatch.setattr(neardup, "SAMPLE", 200)
    monkeypatch.setattr(neardup, "LEAST", 100)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 32))
    rows = [(i, [float(x) for x in centres[i % 300] + 0.2 * rng.standard_normal(32)], 0) for i in range(1500)]
    rows += [(5000 + i, [float(x) for x in centres[7] + 0.01 * rng.standard_normal(32)], 0) for i in range(150)] + [(5000, rows[3][1], 0)] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    truth = brute_vectors(rows)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(table).collect())
    assert [g[0] for g in got] == [t[0] for t in truth]
    assert all(g[1] <= t[1] for g, t in zip(got, truth)) and sum(g[1] for g in got) >= 0.99 * sum(t[1] for t in truth)

    seen = []
    split = neardup.split_large
    monkeypatch.setattr(neardup, "split_large", lambda *a: seen.append(split(*a)) or seen[-1])
    for n in (400, 1600):
        near_duplicates(table.where(F.col("vec_id") < n)).count()
    most = [m.groupBy("leaf").count().agg(F.max("count")).first()[0] for m in seen]
    assert max(most) <= 2 * neardup.LEAF and seen[1].count() < 8 * seen[0].count()


DATA = os.environ.get("AEROFRAME_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_small_tables_have_several_leaves(spark, monkeypatch):
    fitted = []
    fit = neardup.fit_tree
    monkeypatch.setattr(neardup, "fit_tree", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    near_duplicates(spark.read.parquet(f"{DATA}/embeddings.parquet")).count()
    assert len(fitted) == 6 and all(len(t.cut) >= 3 for t in fitted)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    # A column of whole numbers with nulls is one of floats in pandas on one side.
    cell = lambda v: "-" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.6f}" if isinstance(v, float) else str(v)
    show = lambda f: sorted(tuple(map(cell, row)) for row in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert show(queries()[name](spark, DATA).toPandas()) == show(db.execute(oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_of_marks_and_line_breaks(spark, seed):
    """Texts and roles of escapes, control signs, line breaks and letters, all read back as they were."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["\\", "<", "[", "\n", "n", "|", ">", "im_start", "<|im_end|>\n", "x"]) for _ in range(rng.randrange(7)))
    rows = [(c, t, rng.choice(["assistant", "user", word()]), rng.choice([word(), "\\frac{a}{b} is", "\\"])) for c in range(150) for t in range(rng.randint(1, 4))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_turns(canonical_turns(table.select("conv_id", F.to_variant_object(F.struct("turn", "role", "text")).alias("r"))))
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    for c, row in got.items():
        own = [(role, text) for at, _, role, text in rows if at == c]
        assert [tuple(t) for t in row.turns] == own and row.loss == [text for role, text in own if role == "assistant"]
        assert row.formatted.count(OPEN) == row.formatted.count(CLOSE.strip()) == len(own)


def test_records_with_further_fields(spark):
    """The mapping of the most paths that a record has; other fields are left out."""
    records = {
        '{"id": 7, "messages": [{"role": "user", "content": "u"}]}': [("user", "u")],
        '{"messages": [{"role": "user", "content": "u", "name": "me"}, {"role": "assistant", "content": "a"}]}': [("user", "u"), ("assistant", "a")],
        '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": null, "tool": [1]}]}': [("user", "u"), ("assistant", None)],
        '{"system": "be brief", "conversations": [{"from": "human", "value": "h"}]}': [("system", "be brief"), ("user", "h")],
        '{"id": 1, "system": "", "conversations": [{"from": "human", "value": "h", "weight": 1}]}': [("user", "h")],
        '{"instruction": "i", "output": "o", "source": "s"}': [("user", "i"), ("assistant", "o")],
        '{"instruction": "i", "input": "x", "output": "o", "source": {"a": 1}}': [("user", "i\n\nx"), ("assistant", "o")],
        '{"messages": []}': [],
        '{"id": 3, "messages": []}': [],
        '{"messages": [{"content": "without a role"}]}': None,
        '{"messages": 5}': None,
        '{"prompt": "alone"}': None,
    }
    table = spark.createDataFrame([(k,) for k in records], "json string").select("json", F.try_parse_json("json").alias("r"))
    got = canonical_turns(table)
    for row in got.select("json", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")).collect():
        assert (None if row.turns is None else [tuple(t) for t in row.turns]) == records[row.json], row.json
    assert format_turns(got.select(F.lit(1).alias("conv_id"), "turns")).first().unknown == 3
