"""Joins that move only rows that may find a partner, and what is built on them: against plain joins and Python."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import membership, pii
from cloakframe.functions import patterns as P
from cloakframe.operators import pseudonymize as ps


@pytest.fixture(params=["broadcast", "bitmap"])
def either_way(request, monkeypatch):
    if request.param == "bitmap":
        monkeypatch.setattr(membership, "FEW", 0)
    return request.param


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_left_join_equals_a_plain_one(spark, either_way):
    rows = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1), (None, -2)], "k bigint, id bigint"))
    side = spark.range(0, 4000, 37).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    got = membership.left_join(rows, side, "k", F.lit(20))
    want = rows.join(side, "k", "left")
    assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))
    none = membership.left_join(rows, side.limit(0), "k", F.lit(20))
    assert none.count() == 3002 and none.where("v is not null").count() == 0
    assert membership.left_join(rows.limit(0), side, "k", F.lit(20)).count() == 0


def test_rows_that_may_hold_a_key(spark, either_way):
    rows = spark.range(20_000).select((F.col("id") % 10_000).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    side = spark.range(0, 10_000, 25).select(F.col("id").cast("int").alias("k"))
    kept = membership.may_hold(rows, side, "k")
    assert kept.where("k % 25 = 0").count() == 800 and kept.count() < 800 + 1000 and kept.columns == ["k", "id"]
    assert "hashpartitioning(k" not in plan_of(kept) and membership.may_hold(rows, side.limit(0), "k").count() == 0


def test_bitmaps_hold_all_keys_and_few_others(spark):
    side = spark.range(0, 100_000, 50).select(F.col("id").alias("k"))
    bits = membership.ROW_BITS * 2
    rows = spark.range(100_000).select(F.col("id").alias("k"))
    map_ = membership.bitmap(side, "k", bits)
    at = membership.place(F.col("k"), bits)
    marked = rows.join(F.broadcast(map_), F.bitmap_bucket_number(at) == F.col("bucket"), "left").select("k", membership.is_set(F.col("bits"), at).alias("may"))
    assert marked.where("k % 50 = 0 and not may").count() == 0
    assert 2000 <= marked.where("may").count() < 2000 + 0.05 * 100_000


def test_rows_without_a_partner_are_not_shuffled(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    broadcast, _ = ps.pseudonymize_corpus(docs, "doc_id", "text", secret=b"k")
    assert "hashpartitioning" not in plan_of(broadcast)
    monkeypatch.setattr(membership, "FEW", 0)
    out, _ = ps.pseudonymize_corpus(docs, "doc_id", "text", secret=b"k")
    lines = plan_of(out).splitlines()
    top = next(i for i, x in enumerate(lines) if "Union" in x)
    indent = re.match(r"[ :+-]*", lines[top]).end()
    second = next(i for i in range(top + 1, len(lines)) if lines[i][indent:].startswith("+- ") or lines[i][indent - 3 :].startswith("   +- "))
    # rows that may hold spans meet them by a shuffle; the others are read and leave
    moved, stay = "\n".join(lines[top:second]), "\n".join(lines[second:])
    assert "hashpartitioning(__row" in moved and "FileScan" in stay and "hashpartitioning(__row" not in stay and "SortMergeJoin" not in stay


ODD = [(1, "q@r.com"), (1, "s@t.com and q@r.com now"), (None, "mail q@r.com"), (None, "no one"), (1, "q@r.com"), (2, None), (3, ""), (None, None)]


def hidden(text: str | None, seen: dict[str, int]) -> str | None:
    return None if text is None else re.sub(r"\w+@\w\.com", lambda m: f"[EMAIL_{seen[m[0]]:03d}]", text)


def test_null_and_repeated_ids_keep_their_own_texts(spark, either_way):
    df = spark.createDataFrame([(*r, "x", 5) for r in ODD], "doc_id bigint, text string, spans string, row int")
    out, labels = ps.pseudonymize_corpus(df.repartition(3), "doc_id", "text", secret=b"k")
    # nulls come first, so q is the first address of all
    seen = {"q@r.com": 1, "s@t.com": 2}
    assert sorted(((r.doc_id, r.text, r.spans, r.row) for r in out.collect()), key=repr) == sorted(((i, hidden(t, seen), "x", 5) for i, t in ODD), key=repr)
    assert out.columns == df.columns and labels.count() == 2
    # the same rows with ids that are long texts
    long = spark.createDataFrame([(None if i is None else "/a/very/long/folder/of/many/letters/" + str(i), t) for i, t in ODD], "doc_id string, text string")
    again, _ = ps.pseudonymize_corpus(long, "doc_id", "text", secret=b"k")
    assert sorted((r.text for r in again.collect()), key=repr) == sorted((hidden(t, seen) for _, t in ODD), key=repr)
    assert ps.pseudonymize_corpus(df.limit(0), "doc_id", "text", secret=b"k")[0].count() == 0


def test_tables_and_pages_with_null_and_repeated_ids(spark, either_way):
    cells = [(None, "a@x.org", "=c@x.org", 1), (7, "b@x.org", None, 2), (7, "b@x.org see a@x.org", "=c@x.org", 3), (None, None, "", 4)]
    df = spark.createDataFrame(cells, "row_id bigint, mail string, note string, col_no int")
    got = sorted(((r.row_id, r.mail, r.note, r.col_no) for r in ps.pseudonymize_table(df, "row_id", secret=b"k").collect()), key=lambda r: r[3])
    assert got[0] == (None, "[EMAIL_001]", "=c@x.org", 1) and got[3] == (None, None, "", 4)
    assert {got[1][1], got[2][1]} == {"[EMAIL_002]", "[EMAIL_002] see [EMAIL_001]"} and got[2][2] == "=c@x.org"
    pages = [(None, "<p>a@x.org"), (5, "<p>b@x.org</p>"), (5, "<i title='a@x.org'>c</i>"), (None, None), (6, "<p>none")]
    out, labels = ps.pseudonymize_html_corpus(spark.createDataFrame(pages, "page_id bigint, html string"), "page_id", "html", secret=b"k")
    rows = out.collect()
    assert labels.count() == 2 and len(rows) == 5 and not any("@" in r.html for r in rows)
    assert {r.html for r in rows if r.page_id is None} == {"<p>[EMAIL_001]", ""} and {r.html for r in rows if r.page_id == 5} == {"<p>[EMAIL_002]</p>", '<i title="[EMAIL_001]">c</i>'}


def test_many_literals_are_found_in_one_pass(spark, either_way):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))) for _ in range(1000)]
    texts = [(1, " ".join(rnd.choices(words, k=300)) + " mail abc@x.org"), (1, "ab ab abab"), (2, " ".join(words[:50])), (None, "ab z@x.org"), (3, None)]
    literals = [(d, rnd.choice(P.LITERAL_TYPES), w) for d in (1, 2, 3, None) for w in set(words)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    listed = spark.createDataFrame(literals, "doc bigint, entity string, literal string")
    got = sorted((str(r.doc), r.start, r.end, r.entity, r.value, r.status) for r in ps.literal_spans(docs, "doc_id", "text", listed).collect())
    kinds = {(d, w): e for d, e, w in literals}
    want = []
    for doc, text in texts:
        if doc is None or text is None:
            continue
        direct = [m.span() for m in re.finditer(P.EMAIL, text)]
        found = []
        for w in set(words):
            at = text.find(w)
            while at >= 0:
                found.append((at, at + len(w), kinds[doc, w]))
                at = text.find(w, at + len(w))
        free = 0
        for s, e, kind in sorted(found, key=lambda x: (x[0], x[0] - x[1], P.LITERAL_TYPES.index(x[2]))):
            if any(s < de and ds < e for ds, de in direct):
                status = "direct_conflict"
            elif s >= free:
                free, status = e, "accepted"
            else:
                status = "literal_conflict"
            want.append((str(doc), s, e, kind, text[s:e], status))
    assert got == sorted(want)
    out, spans = ps.replace_dictionary_literals(docs, "doc_id", "text", listed, b"k")
    rows = out.collect()
    assert len(rows) == 5 and not any("@" in (r.text or "") for r in rows) and [r.text for r in rows if r.doc_id is None] == ["ab [EMAIL_001]"]
    counts = {r.doc: r for r in ps.conflict_counts(spans).collect()}
    assert counts[2].accepted == sum(w[0] == "2" and w[5] == "accepted" for w in want)


def test_nominations_of_repeated_unknown_and_null_ids(spark, either_way):
    docs = spark.createDataFrame([(1, "aaaa bb"), (1, "aa"), (2, None), (None, "aa")], "doc_id int, text string")
    payload = '[{"type": "PERSON", "literal": "aa"}, {"type": "PERSON", "literal": "bb"}, {"type": "PERSON"}]'
    payloads = spark.createDataFrame([(1, payload), (2, payload), (9, payload), (None, payload)], "doc_id bigint, payload string")
    rows = ps.validate_nominations(docs, payloads, "doc_id", "text", "payload").collect()
    # accepted pairs once a document id; a document without text holds nothing
    assert sorted((r.doc_id, r.literal or "", r.reject_reason or "") for r in rows) == sorted(
        [(1, "aa", ""), (1, "bb", ""), (1, "bb", "not_in_source"), (1, "", "no_type_or_literal"), (1, "", "no_type_or_literal"), (2, "aa", "not_in_source"), (2, "bb", "not_in_source"), (2, "", "no_type_or_literal")]
    )


def test_a_broken_map_is_refused(spark):
    first = spark.createDataFrame([("EMAIL", "new", 1, 0)], "entity string, digest string, doc bigint, start int")
    fine = ("EMAIL", "a", "[EMAIL_001]", 1)
    for bad in ([fine, fine], [fine, ("EMAIL", "b", "[EMAIL_001]", 1)], [("EMAIL", "a", "[EMAIL_1]", 1)], [("EMAIL", "a", "[EMAIL_002]", 1)]):
        known = spark.createDataFrame(bad, "entity string, digest string, label string, seq bigint")
        with pytest.raises(ValueError, match="cannot be reused"):
            ps.extend_entity_map(known, first)
    good = ps.extend_entity_map(spark.createDataFrame([fine], "entity string, digest string, label string, seq bigint"), first)
    assert sorted(r.label for r in good.collect()) == ["[EMAIL_001]", "[EMAIL_002]"]


def test_numbers_of_one_place_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ps, "PER_RANGE", 20)
    rows = [("EMAIL", f"d{i}", None if i % 3 else 4, f"{i * 7919 % 1000:03d}", 0, i) for i in range(200)]
    got = {r.digest: r.seq for r in ps.numbered(spark.createDataFrame(rows, "entity string, digest string, doc int, row string, unit int, start int")).collect()}
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4], r[5]))
    assert got == {r[1]: i for i, r in enumerate(order, 1)}


def test_addresses_equal_pythons(spark):
    rnd = random.Random(6)
    group = lambda: rnd.choice(["0", "1", "ab", "FFFF", "12345", "", "9", "c0de"])
    dotted = lambda: ".".join(str(rnd.choice([0, 1, 10, 99, 255, 256, 300, "01", "007", ""])) for _ in range(rnd.choice([3, 4, 4, 4, 5])))
    tokens = []
    for _ in range(100_000):
        parts = [group() for _ in range(rnd.choice([2, 3, 6, 7, 8, 8, 8, 9]))]
        if rnd.random() < 0.5:
            parts = [p for p in parts if p]
            parts.insert(rnd.randint(0, len(parts)), "")
        t = dotted() if rnd.random() < 0.3 else ":".join(parts)
        if rnd.random() < 0.2:
            t += ":" + dotted()
        tokens.append(rnd.choice(["", "", "", ":", "::", ".", "1"]) + t + rnd.choice(["", "", "", ":", "::", "."]))
    want = [sum(valid(x.strip(P.IP_TRIM)) for x in re.findall(P.IP_TOKEN, f"at {t}, ok")) for t in tokens]
    df = spark.createDataFrame(list(enumerate(f"at {t}, ok" for t in tokens)), "i int, t string")
    got = [r.n for r in df.select("i", pii.ip_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == want and 5000 < sum(want) < 95_000


def valid(token: str) -> bool:
    try:
        ipaddress.ip_address(token)
    except ValueError:
        return False
    return True
