"""Licence scans against comparing every template everywhere, and on passages changed in some words."""

import random

import pytest
from pyspark.sql import functions as F

from aeroframe.llm.licenses import NAMES, PASSAGES, SLACK, license_digests, license_matches, words_of

SCHEMA = "doc_id long, text string"


def shares(template, words):
    """Share of equal words, phrases required, for every window of beginnings."""
    sought = template.words
    for start in range(-len(sought) // SLACK * SLACK - 2 * SLACK, len(words) + SLACK, SLACK):
        same = sum(any(0 <= q + s < len(words) and words[q + s] == w for s in range(start, start + 2 * SLACK)) for q, w in enumerate(sought)) / len(sought)
        inside = words[max(0, start) : max(0, start + 2 * SLACK + len(sought))]
        has = all(any(inside[i : i + len(p)] == p for i in range(len(inside) - len(p) + 1)) for p in map(words_of, template.phrases))
        if same >= template.share and has:
            yield same


def brute(text):
    words = words_of(text or "")
    base, labels, best = [], set(), 0.0
    for t in NAMES:
        own = [i for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
        base += [(i, t.label) for i in own]
    for t in PASSAGES:
        for share in shares(t, words):
            labels.add(t.label)
            best = max(best, share)
    named = {x for _, x in base}
    places = [i for i, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(named)), ",".join(sorted(named | labels)), pytest.approx(1.0 if base else best))


def changed(rng, text, share, longer):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = rng.choice(["x", "software", "the", "license"])
    for _ in range(longer):
        words.insert(rng.randrange(len(words)), rng.choice(["new", "the"]))
    return " ".join(words)


def texts(seed, n=70):
    rng = random.Random(seed)
    plain = ["the", "software", "license", "permission", "copy", "mit", "General", "public", "apache", "é", "x1", "gnu", *(f"w{i}" for i in range(60))]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(plain, k=rng.choice([0, 1, 30, 200])))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [changed(rng, rng.choice(PASSAGES).text, rng.choice([0, 0, 0.1, 0.2, 0.35]), rng.choice([0, 0, 2, 5])), " ".join(rng.choices(plain, k=12))]
        parts += rng.choice([[], [], ["Released under the MIT License."], ["GNU General  Public-License, the Apache_License! mit license"], ["mit licenses amit license"]])
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", ". "]).join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " - "), (n + 3, "MIT"), (n + 4, "license mit license " * 3000), (n + 5, rows[0][1])] + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_place(spark, seed):
    rows = texts(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("matches", F.lit(1)).repartition(3)
    got = license_digests(table).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(text) for i, text in rows}
    assert len(got) == len(rows)


def test_passages_changed_in_some_words_are_found_and_plain_texts_left_alone(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(300):
        t = PASSAGES[i % len(PASSAGES)]
        noise = [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(80))) for _ in range(2)]
        text = t.text.split(" ")
        free = [k for k in range(len(text)) if not any(w in " ".join(t.phrases).split(" ") for w in words_of(text[k]))]
        for k in rng.sample(free, min(len(free), len(text) // 8)):
            text[k] = "other"
        rows.append((i, f"{noise[0]}\n{' '.join(text)}\n{noise[1]}" if i % 2 else noise[0]))
        want[i] = t.label if i % 2 else ""
    got = {r.doc_id: r.labels for r in license_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    hit = [i for i in want if want[i]]
    assert sum(want[i] in got[i].split(",") for i in hit) >= 0.95 * len(hit)
    assert all(got[i] == "" for i in want if not want[i])


def test_matches_say_where(spark):
    text = "one two " + PASSAGES[2].text + " three"
    (row,) = license_matches(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    (match,) = row.matches
    assert (match.label, match.base, match.first, match.words, match.share) == ("bsd", False, 2, len(PASSAGES[2].words), 1.0) and row.n_words == len(words_of(text))
    assert license_matches(spark.createDataFrame([], SCHEMA)).count() == 0
