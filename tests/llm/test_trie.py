"""The trie of conversation prefixes against a trie of dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from aeroframe.llm import trie
from aeroframe.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = f"{len(role or '')}:{role or ''}{text or ''}"
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(said.encode()).digest()[:16], (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rest = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = (own.get(rest, [])[:h], turns[h:])
        whole[c] = tuple(whole[c][0] + whole[c][1])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(q[:-1] == p and q for q in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        children = sum(1 for q in nodes if q and q[:-1] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def chats(seed, n, longest):
    rng = random.Random(seed)
    says = ["a", "b", "", None, "ü😀", "long " * 4000]
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(-150, 350), rng.randrange(0, 20)])
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "user", "user", "assistant", None]), rng.choice(says[: rng.choice([1, 2, 6])])))
    return rows + rows[:4] + [(None, 1, "user", "a")]


@pytest.mark.parametrize("seed, n, longest, parts", [(1, 60, 7, 4), (2, 25, 20, 3), (3, 1, 1, 1), (4, 12, 45, 2)])
def test_against_a_plain_trie(spark, seed, n, longest, parts):
    rows = chats(seed, n, longest)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("p", F.lit("clash")).withColumn("name", F.lit(1)).repartition(parts)
    assert found(conversation_trie(table)) == brute(rows)


def test_small_runs_and_lists(spark, monkeypatch):
    """Conversations longer than a run of turns, and lists of members longer than a run of ids."""
    monkeypatch.setattr(trie, "CHUNK_BITS", 1)
    monkeypatch.setattr(trie, "LIST_BITS", 1)
    rows = chats(5, 30, 18) + [(c, 0, "user", "same") for c in range(1000, 1040)]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "gone")]  # its one turn is replaced by those of conversation 0, which isn't there
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
