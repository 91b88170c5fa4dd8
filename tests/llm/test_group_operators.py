"""Chat, mixing, near-duplicates, the classifier and the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cloakframe.llm import chat_format, components, embedding_join, quality_nbsvm, queries, simhash_ring, source_mix


class Sets:
    """Union-find by smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def test_chat_reads_back_whole_and_in_order(spark):
    rnd, said = random.Random(2), r"</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (None, 0, None, None), (7, None, "assistant", r"[\INST] <\\/s> [ROLE]"), (7, 3, "[/ROLE]", "é😀<s>"), (8, 0, "user", "tail"), (7, 3, "[/ROLE]", "é😀<s>")]
    rows += [(9, i // 2, rnd.choice(["user", "assistant"]), f"t<s>{i}") for i in range(200)]
    blocks = chat_format.format_blocks(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, block int, segment string"))
    got = {r.conv_id: r for r in chat_format.conversation_digest(blocks).collect()}
    examples = sorted(chat_format.render_examples(blocks).collect(), key=lambda r: (str(r.conv_id), r.turn_no))
    key = lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    for conv, group in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        group = list(group)
        loss = "".join(t or "" for _, _, r, t in group if r == "assistant")
        assert got[conv].n_turns == len(group)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in group).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        mine = [x for x in examples if x.conv_id == conv]
        # every reply is one example: all turns before it as context, and only it under the loss
        ends = [i for i, r in enumerate(group) if r[2] == "assistant"]
        whole = [segment(*r[2:]) for r in group]
        assert [x.text for x in mine] == ["".join(whole[: i + 1]) for i in ends] and [chat_text(x) for x in mine] == [group[i][3] or "" for i in ends]
        assert got[conv].formatted_chars == sum(len(x.text) for x in mine) + sum(map(len, whole[ends[-1] + 1 if ends else 0 :]))
    assert blocks.selectExpr("max(size(turns))").first()[0] <= chat_format.BLOCK
    empty = chat_format.format_blocks(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert chat_format.expand_examples(empty).count() == chat_format.conversation_digest(empty).count() == 0


def segment(role: str | None, text: str | None) -> str:
    hide = lambda t: re.sub(r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))", r"\1\\\2\3", t or "")
    body = f"[INST] {hide(text)} [/INST]" if role == "user" else hide(text)
    return f"<s>[ROLE]{hide(role)}[/ROLE]{body}</s>"


def test_chat_of_hot_and_long_turns(spark):
    """One conversation of many rows with null and equal turns, repeated rows and a very long text."""
    rows = [(1, None, "assistant", f"x{i % 50}") for i in range(400)] + [(1, 5, "user", "same")] * 300 + [(2, 0, "user", "q"), (2, 1, "assistant", "é" * 1_000_000)]
    blocks = chat_format.format_blocks(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5))
    got = {r.conv_id: r for r in chat_format.conversation_digest(blocks).collect()}
    order = sorted(rows[:700], key=lambda r: (r[1] is None, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    assert got[1].n_turns == 700 and got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in order).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(r[3] for r in order if r[2] == "assistant").encode()).hexdigest() and got[2].loss_chars == 1_000_000
    assert blocks.selectExpr("max(size(turns))").first()[0] <= chat_format.BLOCK


def test_chat_examples_are_whole_for_long_conversations(spark):
    """Each example of a conversation of many blocks holds all turns before its reply, also when its examples are dealt over parts."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"t</s>{i}") for i in range(45)] + [(2, 0, "user", "tail")]
    blocks = chat_format.format_blocks(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    whole = [segment(*r[2:]) for r in rows[:45]]
    want = ["".join(whole[: i + 1]) for i in range(1, 45, 2)]
    tail = (2, 1, len(segment("user", "tail")))
    for size in (chat_format.PART_CHARS, 2000):
        examples = sorted(chat_format.expand_examples(blocks, size).collect(), key=lambda r: r.turn_no)
        assert [x.text for x in examples] == want and [chat_text(x) for x in examples] == [f"t</s>{i}" for i in range(1, 45, 2)]
        got = sorted((r.conv_id, r.n_turns, r.formatted_chars) for r in chat_format.conversation_digest(blocks, size).collect())
        assert got == [(1, 45, sum(map(len, want)) + len(whole[-1])), tail]
    assert chat_format.whole_conversations(blocks, 2000).where("conv_id = 1").count() > 2


def chat_text(example) -> str:
    inside = example.text[example.loss_start : example.loss_end]
    return re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE\]))", r"\1\2\3", inside)


def test_chat_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = [tuple(r) for r in queries.op3_prefix_target_chat(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()]
    assert sorted(got) == sorted(con.execute(queries.OP3_SQL).fetchall())


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, k) for k in range(1001, 1060)] + [(rnd.randrange(2000, 2200), rnd.randrange(2000, 2200)) for _ in range(120)]
    sets = Sets()
    for a, b in links:
        sets.link(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*links, (None, 5)], "a bigint, b bigint")).collect()}
    assert got == {x: sets.top(x) for link in links if link[0] != link[1] for x in link}


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", " \n", "a", "A b", "a b c", "É a b C d", " x\x0by\x1cz q r s a b c a b c"]:
        assert simhash_ring.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_hot_ids_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "PER_TASK", 7)
    links = [(0, k) for k in range(1, 100)] + [(k, 1000) for k in range(100, 200)] + [(150, 50)] + [(k, 999) for k in range(300, 350)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 300 if k == 999 or 300 <= k < 350 else 0 for k in [*range(200), 1000, 999, *range(300, 350)]}


def test_few_links_are_not_counted_by_id_and_stars_end_at_once(spark, monkeypatch):
    """On check_h the pipeline's driver ran out of memory over the jobs of these rounds."""
    steps, counted, step, deal = [], [], components.point_to_smallest, components.dealt_join
    monkeypatch.setattr(components, "point_to_smallest", lambda *a: steps.append(a[1:]) or step(*a))
    monkeypatch.setattr(components, "dealt_join", lambda *a: counted.append(1) or deal(*a))
    find = lambda links: {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    stars = [(k % 3, k) for k in range(3, 60)] + [(5, 2)]
    assert find(stars) == {k: k % 3 for k in range(60)}
    assert not steps
    assert find([(k, k + 1) for k in range(20)]) == dict.fromkeys(range(21), 0)
    assert steps and not counted
    assert not any(dealt for _, dealt in steps)
    monkeypatch.setattr(components, "PER_TASK", 7)
    assert find([(k, k + 1) for k in range(20)]) == dict.fromkeys(range(21), 0)
    assert counted


@pytest.mark.parametrize(("paired", "distance"), [(64, 2), (2, 2), (64, 1), (2, 1), (64, 3), (64, 4), (4, 3)])
def test_ring_finds_every_pair_within_the_distance(spark, paired, distance):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:15]:
        for _ in range(12):
            x = b
            for _ in range(rnd.randrange(1, 4)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    for _ in range(150):
        x = base[0]
        for _ in range(rnd.randrange(6)):
            x ^= 1 << rnd.randrange(20)
        prints.add(x)
    prints = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    sets = Sets()
    for a, b in itertools.combinations(prints, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
            sets.link(a, b)
    links = simhash_ring.ring_links(spark.createDataFrame([(f,) for f in prints], "fp bigint"), distance, paired)
    got = {r.id: r.component for r in components.components(links).collect()}
    assert all(got.get(f, f) == sets.top(f) for f in prints)


def test_near_duplicate_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long), (3, long), (9, long + " extra"), (1, None), (2, ""), (4, "other words here"), (None, long), (None, "alone by itself now"), (4, "other words here")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, component_id int")
    got = sorted([(r.doc_id, r.component_id) for r in simhash_ring.near_duplicates(docs).collect()], key=str)
    near = 3 if ((plain_fingerprint(long) ^ plain_fingerprint(long + " extra")).bit_count() <= 2) else 9
    assert got == sorted([(5, 3), (3, 3), (9, near), (1, 1), (2, 1), (4, 4), (None, 3), (None, None), (4, 4)], key=str)
    kept = sorted([r.doc_id for r in simhash_ring.keep_representatives(docs).collect()], key=str)
    assert kept == sorted([3, 1, 4, None, *([9] if near == 9 else [])], key=str)
    assert simhash_ring.near_duplicates(docs.limit(0)).count() == simhash_ring.keep_representatives(docs.limit(0)).count() == 0
    other = docs.unionByName(spark.createDataFrame([(3, long, 7), (3, long, -7)], docs.schema))
    for again in (other, other.repartition(3)):
        assert [r.component_id for r in simhash_ring.keep_representatives(again).where("doc_id = 3").collect()] == [-7]


def test_a_long_text_is_hashed_whole(spark):
    words = [f"w{i}" for i in range(200_000)]
    assert simhash_ring.fingerprint(" ".join(words)) & (2**64 - 1) == plain_fingerprint(" ".join(words))
    assert simhash_ring.fingerprint(" ".join(words[:-50_000])) != simhash_ring.fingerprint(" ".join(words))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in (0.02, 0.1, 0.3)] + [rng.normal(size=16) for _ in range(100)]
    vectors += [vectors[0]] * 5
    rows = [(i, list(map(float, v)), i) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [1.0], 0), (1005, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, node int")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    sets = Sets()
    for a, b in np.argwhere(close):
        sets.link(int(a), int(b))
    got = {r.vec_id: r for r in embedding_join.near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(vectors)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum() - 1, sets.top(i), sets.top(i) == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1006))
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_split_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, list(map(float, base + rng.normal(size=8) * 0.05))) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = sorted(map(tuple, embedding_join.near_vectors(df).collect()))
    monkeypatch.setattr(embedding_join, "BLOCK", 40)
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == want
    monkeypatch.setattr(embedding_join, "PER_PIVOT", 20)
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == want


def test_many_cells_and_long_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "PER_PIVOT", 16)
    monkeypatch.setattr(embedding_join, "BLOCK", 8)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 48))
    vectors = np.array([c + rng.normal(size=48) * s for c in centres for s in (0.1, 0.2, 0.22, 0.25, 0.3, 0.5, 0.1, 0.22)])
    close = (unit := vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ unit.T >= 0.95
    sets = Sets()
    for a, b in np.argwhere(close):
        sets.link(int(a), int(b))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding_join.near_vectors(df).collect()}
    assert all((got[i].n_links, got[i].component_id) == (close[i].sum() - 1, sets.top(i)) for i in range(len(vectors)))


def test_vectors_of_any_length_and_size_link_with_their_own(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [2e-200, 0.0]), (5, [1e-200, 0.0]), (6, [1e200, 0.0]), (7, [5e-324, 0.0]), (8, [1.0, 2.0, 1e-3]), (9, [-1.0, -2.0]), (None, [3.0, 6.0]), (2, [0.0, -1.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [7.0])]
    got = sorted([tuple(r) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()], key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, False), (3, 1, 3, True), (8, 1, 3, False), (4, 3, 4, True), (5, 3, 4, False), (6, 3, 4, False), (7, 3, 4, False), (9, 0, 9, True), (2, 0, 2, True), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)]
    assert got == sorted(want, key=str)
    floats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert {r.n_links for r in embedding_join.near_vectors(floats).collect()} == {1}


def test_mix_meets_targets(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randrange(1, 60), rnd.choice(["a", "b", "c", "d", None]), 0) for i in range(600)]
    rows += [(i, "w " * 20, "hot", 0) for i in range(1000, 1400)] + [(5000, None, "a", 0), (5001, "", "empty", 0), (7, "w w", "a", 0), (None, "w w w", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, source_mix.mix(docs.repartition(3)).collect()), key=str)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    out = source_mix.mixed_documents(docs)
    assert out.columns == docs.columns
    words: dict = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(words.get(s, 0) - target[s]) <= 60 for s in names)
    assert source_mix.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [1, None])
def test_ties_at_the_edge_take_as_many_as_fit(spark, doc_id):
    """One document of 20 words repeated 50 times beside a source that leaves it a target of less."""
    rows = [(doc_id, "w " * 20, "a", i) for i in range(50)] + [(100 + i, "v " * 7, "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, __row int")
    for share in (20, 75, 110, 150):
        got = source_mix.mix(docs, share_percent=share).where("source = 'a'").collect()
        assert len(got) == 50 and abs(sum(r.taken for r in got) - got[0].target) <= 1 and all(0 <= r.taken <= 40 for r in got)
        whole = source_mix.mixed_documents(docs, share_percent=share)
        assert whole.columns == docs.columns
        words = sum(len(r.text.split()) for r in whole.where("source = 'a'").collect())
        assert abs(words - got[0].target) <= 10
    assert source_mix.mixed_documents(docs.limit(0)).count() == 0


def test_key_ranges_are_small_whatever_the_weights(spark):
    """A source of texts that are marks only, another of plain words, and one of both: no range holds a hundredth of a source."""
    rows = [(i, ("#$%&*" * 52)[: 250 + i % 20] if i % 3 == 0 or (i % 3 == 2 and i % 2) else "plain words here", "abc"[i % 3]) for i in range(24_000)]
    sized = source_mix.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source", "s")
    held = sized.groupBy("source", "key_range").count().groupBy("source").agg({"count": "max"}).collect()
    assert len(held) == 3 and max(r[1] for r in held) < 80


def test_rows_without_ids_are_drawn_apart(spark):
    docs = spark.createDataFrame([(None, f"w{i} " * (1 + i % 5), "a") for i in range(300)], "doc_id bigint, text string, source string")
    rows = source_mix.sized(docs, "doc_id", "text", "source", "s").collect()
    assert len({r.key_range for r in rows}) > 200
    got = source_mix.mix(docs).collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 1


def test_mixed_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.OP10_SQL).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in queries.op10_source_mix(spark, sf).collect())
    assert [(w[0], w[1], w[2], w[4]) for w in want] == [(g[0], g[1], g[2], g[4]) for g in got]


def test_classifier_holds_out_and_learns(spark, sf):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    out = quality_nbsvm.score(docs, quality_nbsvm.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)
    import zlib

    held = {r.doc_id for r in quality_nbsvm.score(docs, quality_nbsvm.Model(np.zeros(0), np.zeros(0), 0.0, 0.5)).collect() if r.held_out}
    assert held == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_classifier_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "a b", 0.1), (3, "good words here", 0.1), (4, "BAD!! BAD!!", 0.1), (4, "BAD!! BAD!!", 0.1)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_nbsvm.fit(docs, labels)
    got = quality_nbsvm.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = quality_nbsvm.fit(docs, labels.limit(0))
    assert {r.score for r in quality_nbsvm.score(docs, none).collect()} == {0.5}
    assert quality_nbsvm.keep_good(docs, labels).columns == docs.columns


def test_nb_ratios_and_descent():
    docs = [np.array([1, 2]), np.array([1, 3]), np.array([4, 2]), np.array([4, 3])]
    good = np.array([True, True, False, False])
    ratio = quality_nbsvm.log_ratio(docs, good)
    assert ratio[1] > 0 > ratio[4] and abs(ratio[2]) < 1e-9
    model = quality_nbsvm.Model(ratio, *quality_nbsvm.dual_descent(docs, good, ratio))
    assert [model.score(d) >= 0.5 for d in docs] == [True, True, False, False]


def solved_apart(rows: np.ndarray, sign: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """The weights of the hinge loss with a constant column, and the dual's value, by accelerated projected gradients on the whole dual."""
    q = (rows * sign[:, None]) @ (rows * sign[:, None]).T
    step = 1 / np.linalg.eigvalsh(q)[-1]
    alpha = ahead = np.zeros(len(rows))
    t = 1.0
    for _ in range(20_000):
        new = np.clip(ahead - step * (q @ ahead - 1), 0, cost)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, alpha = new + (before - 1) / t * (new - alpha), new
    return (alpha * sign) @ rows, float(alpha.sum() - alpha @ q @ alpha / 2)


def test_descent_equals_an_independent_solver(spark, sf, monkeypatch):
    """The fit on given documents, against a dense version that shares no more than the indicators."""
    joined = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").orderBy("doc_id").select("text", "quality").limit(200).collect()
    features = quality_nbsvm.Features()
    found, good = [features(r.text or "") for r in joined], np.array([r.quality == 1 for r in joined])
    used = sorted({int(i) for f in found for i in f})
    column = {b: i for i, b in enumerate(used)}
    counts = [[quality_nbsvm.SMOOTHING] * len(used) for _ in range(2)]
    for f, y in zip(found, good, strict=True):
        for b in f:
            counts[int(y)][column[int(b)]] += 1
    # indicators that nobody has count in the totals
    unused = (quality_nbsvm.BUCKETS - len(used)) * quality_nbsvm.SMOOTHING
    share = [np.array(c) / (sum(c) + unused) for c in counts]
    dense = np.zeros((len(found), len(used) + 1))
    for i, f in enumerate(found):
        at = [column[int(b)] for b in f]
        dense[i, at] = np.log(share[1] / share[0])[at]
        dense[i] /= np.linalg.norm(dense[i]) or 1.0
    dense[:, -1] = 1.0
    weights, dual = solved_apart(dense, np.where(good, 1.0, -1.0), quality_nbsvm.COST)
    ratio = quality_nbsvm.log_ratio(found, good)
    # as the query descends, and further: the gap closes, and the margins meet
    for epochs, gap, apart in ((quality_nbsvm.EPOCHS, 0.05, 0.1), (600, 1e-3, 5e-3)):
        monkeypatch.setattr(quality_nbsvm, "EPOCHS", epochs)
        model = quality_nbsvm.Model(ratio, *quality_nbsvm.dual_descent(found, good, ratio))
        own = np.append(model.weight[used], model.bias)
        primal = own @ own / 2 + quality_nbsvm.COST * np.maximum(0, 1 - np.where(good, 1, -1) * (dense @ own)).sum()
        assert -1e-9 <= primal - dual <= gap * dual
        margins = np.array([model.margin(f) for f in found])
        assert np.abs(margins - dense @ weights).max() < apart and ((margins > 0) == (dense @ weights > 0)).mean() > 0.99


def test_fit_takes_one_row_an_id(spark, monkeypatch):
    """A labelled id that ten thousand rows repeat counts once, and the bound holds for rows."""
    import zlib

    one, two, three = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = [(one, "good words in a sentence", 0)] * 5000 + [(two, "BAD!! BAD!! $$$", 0)] * 5000 + [(three, "good words here", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(one, 1), (two, 0), (three, 1)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality_nbsvm, "log_ratio", lambda found, good: seen.append(len(found)) or np.zeros(quality_nbsvm.BUCKETS))
    quality_nbsvm.fit(docs, labels)
    assert seen == [3]
    quality_nbsvm.fit(docs, labels, sample=2)
    # two rows at most; rows of one class need no ratios
    assert seen in ([3], [3, 2])


def test_shapes_are_whole():
    assert quality_nbsvm.shape("a1" * 20) == "x0" * 20 and quality_nbsvm.shape("Word") == "Xx" and quality_nbsvm.shape("WORD-9") == "X-0"
    one, two = (quality_nbsvm.Features()("a1" * 20 + end) for end in ("!", "?"))
    assert set(one) != set(two)


def test_classifier_of_long_texts_and_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "good words here " * 100_000), (2, "BAD!! $$ " * 1000), (3, "q" * 2_000_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = quality_nbsvm.fit(docs, labels)
    assert len(quality_nbsvm.score(docs, model).collect()) == 3
    none = docs.limit(0)
    assert quality_nbsvm.score(none, quality_nbsvm.fit(none, labels)).count() == quality_nbsvm.keep_good(none, labels).count() == 0
