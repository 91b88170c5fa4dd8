"""The pipeline's near copies: against brute force over exact sets of five-word shingles."""

from __future__ import annotations

import itertools
import random
import uuid

import corpus_pipeline
from cloakframe.llm import near_copies
from cloakframe.llm.simhash_ring import fingerprint


def plain_set(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_stage_drops_every_near_copy_and_nothing_else(spark):
    rnd = random.Random(5)
    texts: list[str | None] = [None, "", " ", "one two", "One  two", "one two three"]
    line = [f"line{i}" for i in range(30)]
    for base in range(40):
        words = [f"b{base}w{rnd.randrange(400)}" for _ in range(200)] + line
        for changes in (0, 1, 2, 3, 4, 5, 6, 8, 12):
            new = list(words)
            for at in rnd.sample(range(200), changes):
                new[at] = f"x{rnd.random()}"
            texts.append(" ".join(new))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    rows += [(None, texts[8]), (None, "alone by itself right here now"), rows[0]]
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    best: dict[int, tuple] = {}
    for i, (doc, _) in enumerate(rows):
        best[top(i)] = min(best.get(top(i), (True, 0)), (doc is None, doc or 0))
    want = sorted((None if last else doc for last, doc in best.values()), key=str)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_ring_finds_copies_without_any_band(spark, monkeypatch):
    """Copies whose fingerprints are equal or within two bits are found by the ring alone, and only near ones are dropped."""
    monkeypatch.setattr(near_copies, "make_bands", lambda: lambda found: [uuid.uuid4().int >> 65])
    rnd = random.Random(9)
    rows = []
    for base in range(12):
        words = [f"b{base}w{rnd.randrange(4000)}" for _ in range(2000)]
        rows.append((2 * base, " ".join(words)))
        words[rnd.randrange(2000)] = "other"
        rows.append((2 * base + 1, " ".join(words)))
    bits = [(fingerprint(rows[i][1]) ^ fingerprint(rows[i + 1][1])).bit_count() for i in range(0, 24, 2)]
    assert min(bits) <= 2
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string")
    want = [2 * i for i in range(12)] + [2 * i + 1 for i in range(12) if bits[i] > 2]
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == sorted(want)
