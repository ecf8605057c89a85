"""Collocations against plain counting, with budgets so small that prefixes are extended."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aeroframe.llm.collocations import collocations, frequent_phrases, partition_vertically
from aeroframe.llm.storage import Scratch

SCHEMA = "doc_id long, text string, lang string"


def counted(rows):
    found, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(4, len(words) - i) + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return found, totals


def brute(rows, least, top):
    found, totals = counted(rows)
    out = []
    for lang in totals:
        own = {p: f for (at, p), f in found.items() if at == lang and f >= least}
        scored = []
        for p, a in own.items():
            if len(p) < 2:
                continue
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * f >= 80 * a for q, f in own.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, l, r))
        out += [(lang, i + 1, p.decode(), a, l, r, totals[lang], -s) for i, (s, _, p, a, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "ZÜRICH", "a\x01", "a", "b\x00", "x|y", "ß", "😀", "(ok)", *(f"w{i}" for i in range(300))]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", " ; ", "\x0b", "\r\n"]
    rows = []
    for i in range(n):
        n_words = rng.choice([0, 1, 2, 5, 60, 300])
        text = "".join(rng.choice(words[: rng.choice([4, 13, 313])]) + rng.choice(ends) for _ in range(n_words))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(n, "New York City " * 400 + "the the the the " * 300, "en"), (n + 1, None, "en"), (n + 2, "", None), (n + 3, " \t", "de")]
    return rows + rows[:5]


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("seed, budget, parts", [(1, 1 << 20, 2), (2, 200, 3), (3, 25, 5)])
def test_against_plain_counting(spark, seed, budget, parts):
    rows = texts(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(parts)
    assert found(collocations(table, least=6, budget=budget, top=40)) == brute(rows, 6, 40)


def test_groups_hold_the_budget_and_long_prefixes_are_extended(spark):
    rows = texts(4)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') as lang", "text")
    scratch = Scratch(spark, "collocations")
    plan, totals = partition_vertically(scratch, table, least=5, budget=100)
    assert plan.groups.max() > 3 and [len(h) > 0 for h in plan.heavy] == [True] * len(plan.heavy) and len(plan.heavy) >= 3
    want, totalled = counted(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequent_phrases(scratch, table, plan).collect()} == {k: f for k, f in want.items() if f >= 5}
    assert {r.lang: r.n for r in totals.collect() if r.n} == {k: n for k, n in totalled.items() if n}


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "one two", "en")], SCHEMA)).count() == 0
