"""Every stage of the pipeline against a plain computation over the rows it was given, and over odd rows."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from cloakframe.llm import quality_nbsvm, queries, secret_ledger, sentencepiece_scan, source_mix


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(rows before, rows after) of every stage, as lists of dicts."""
    place, docs, out = tmp_path_factory.mktemp("stages"), queries.table(spark, sf, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        if i < 4:
            assert made.columns == docs.columns and made.schema.simpleString() == docs.schema.simpleString()
        made.write.parquet(f"{place}/{i}")
        after = spark.read.parquet(f"{place}/{i}")
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return out


def by_id(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["doc_id"], str(r["text"])))


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "secret scans", "mixing sources", "SentencePiece encoding"]


def test_classifier_keeps_what_it_predicts_good(spark, sf, stages):
    before, after = stages[0]
    model = quality_nbsvm.fit(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    features = quality_nbsvm.Features()
    assert by_id(after) == by_id([r for r in before if model.score(features(r["text"] or "")) >= 0.5])
    good = {r.doc_id for r in queries.table(spark, sf, "labels").where("quality = 1").collect()} & {r["doc_id"] for r in before}
    assert len(good & {r["doc_id"] for r in after}) >= 0.97 * len(good) and len(after) < len(before)


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[1]
    sets, up = [shingles(r["text"]) for r in before], list(range(len(before)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best: dict = {}
    for i, r in enumerate(before):
        best[top(i)] = min(best.get(top(i), r["doc_id"]), r["doc_id"])
    assert by_id(after) == by_id([r for i, r in enumerate(before) if best[top(i)] == r["doc_id"]]) and len(after) < len(before)


def test_secrets_are_marked_and_nothing_else_changes(stages):
    before, after = stages[2]
    want = []
    for r in before:
        spans = [{"start": a, "end": b} for _, a, b in secret_ledger.scan_text(r["text"] or "")]
        text = secret_ledger.mask(r["text"], spans) if spans else r["text"]
        want.append({**r, "text": text, "n_chars": len(text) if r["n_chars"] == len(r["text"]) else r["n_chars"]})
    assert by_id(after) == by_id(want)


def test_mix_takes_whole_documents_by_their_keys(stages):
    before, after = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted({r["source"] for r in before})
    sizes = {s: sum(size(r["text"]) for r in before if r["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in open_}
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want = []
    for s in names:
        rows = []
        for r in before:
            if r["source"] == s:
                text = r["text"] or ""
                d = digest(f"mix-1|{r['doc_id']}|{digest(text)}")
                marks = sum(c in source_mix.MARKS for c in text)
                rows.append((-math.log((int(d[:13], 16) + 0.5) / 2**52) / (1 - marks / (len(text) + 1)), d, size(text), r))
        epochs = int(target[s] // sizes[s])
        budget, ahead = int(target[s]) - epochs * sizes[s], 0
        for _, _, n, r in sorted(rows, key=lambda x: x[:3]):
            want += [r] * (epochs + (n > 0 and 2 * ahead + n <= 2 * budget or n == 0 and ahead < budget))
            ahead += n
    got = by_id(after)
    assert [r["doc_id"] for r in got if size(r["text"])] == [r["doc_id"] for r in by_id(want) if size(r["text"])]


def test_pieces_are_the_librarys(stages):
    before, after = stages[4]
    model = sentencepiece_scan.Pieces(queries.tokenizer_file("piece_bpe_32k.model")).model
    want = sorted((r["doc_id"], tuple(model.encode(r["text"] or ""))) for r in before)
    assert sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<i4").tolist())) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in after)


def test_run_gives_the_rows_of_its_stages_and_removes_folders(spark, sf, stages):
    import os

    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    had = set(os.listdir(place))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r["doc_id"], r["n_tokens"]) for r in stages[4][1])
    made = [x for x in set(os.listdir(place)) - had if x.startswith("pipeline-")]
    assert len(made) == 1 and os.listdir(f"{place}/{made[0]}") == ["3"]


def test_stages_take_odd_rows_and_empty_tables(spark, sf):
    good = queries.table(spark, sf, "documents").limit(5).collect()
    odd = [(None, None, None, None, None, 1, "x"), (10**9, None, "en", None, 5, 2, "y"), (10**9 + 1, "", "en", "s", 0, 3, "z"), (10**9 + 2, "a " * 200_000 + "password=abcdefgh", None, "s", None, 4, None)]
    odd += [(r.doc_id, r.text, r.lang, r.source, r.n_chars, i, "n") for i, r in enumerate([*good, good[0], good[0]])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row int, fp string"
    docs = spark.createDataFrame(odd, schema)
    for table in (docs, docs.limit(0)):
        rows = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            # each stage takes the odd rows, and what the one before kept of them
            direct, rows = stage(spark, table, sf), stage(spark, rows, sf)
            assert i == 4 or direct.columns == rows.columns == docs.columns
            if i in (1, 2):
                told = {(r.doc_id, r.__row if hasattr(r, "__row") else 0) for r in direct.collect()}
                assert not table.limit(1).count() or {d for d, _ in told} >= {10**9 + 2, good[0].doc_id}
            assert (direct.count() > 0) == (rows.count() > 0) == bool(table.limit(1).count())
    assert corpus_pipeline.STAGES[2][1](spark, docs, sf).where("text like '%[SECRET]'").count() == 1
