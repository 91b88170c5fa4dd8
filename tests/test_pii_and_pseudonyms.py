"""Scans and labels: against Python's patterns, by hand, and for leaks."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import keys, pii
from cloakframe.functions import patterns as P
from cloakframe.operators import pii as scans
from cloakframe.operators import pseudonymize as ps

TEXTS = [
    "mail Jo.Doe@Example.org or jo.doe@example.ORG, not émail@x.org? call +44 20 7946 0958.",
    "on 2026-09-18 and 2026/9/1",
    "ip 10.1.2.3. and ::1 and 2001:db8::1 and 999.1.1.1 and 01.2.3.4",
    "id 11010519491231002X",
    "at SW1A 1AA and gir 0aa",
    "٠١٢٣٤٥٦٧٨٩ 😀 a@b.co 中文a@b.co",
    "",
    None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").cache()


def plain_counts(text: str) -> dict[str, int]:
    phones = [m[0].strip() for m in re.finditer(P.PHONE, text)]
    tokens = [t.strip(P.IP_TRIM) for t in re.findall(P.IP_TOKEN, text)]
    return {
        "email": len(re.findall(P.EMAIL, text)),
        "phone": sum(not re.fullmatch(P.WHOLE_DATE, p) and sum(c.isdigit() for c in p) >= 9 for p in phones),
        "cn_national_id": len(re.findall(P.NATIONAL_ID, text)),
        "uk_postcode": len(re.findall(P.POSTCODE, text)),
        "ip_address": sum(map(pii.is_ip, tokens)),
    }


def test_counts_equal_pythons(texts):
    for r in scans.scan_text_column(texts, "doc_id", "text", ipv6=True).collect():
        assert {e: r[e] for e in P.ENTITIES} == plain_counts(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]


#: What Java's Unicode word class reads otherwise than Python: combining mark, connector, joiner, circled letter, superscript, fraction.
BESIDE = ("\u0301", "\u203f", "\u200d", "\u24b6", "\u00b2", "\u00bd", "\u00e9", "_", ".")


def test_what_stands_beside_an_identifier_is_read_as_python_reads_it(spark):
    held = ("a@b.org", "020 7946 0958", "11010519491231002X", "SW1A 1AA", "10.1.2.3", "10.1.2.3 10.4.5.6")
    said = [t for x in held for c in BESIDE for t in (f"on {c}{x} on", f"on {x}{c} on")]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")

    def plain(text: str) -> str:
        for p, tag in ((P.EMAIL, "EMAIL"), (P.PHONE, "PHONE"), (P.NATIONAL_ID, "NATIONAL_ID"), (P.POSTCODE, "POSTCODE"), (P.LOOSE_IPV4, "IP_ADDRESS")):
            text = re.sub(p, f"[{tag}]", text)
        return text

    for r in scans.scan_text_column(df, "doc_id", "text", ipv6=True).collect():
        assert {e: r[e] for e in P.ENTITIES} == plain_counts(said[r.doc_id]), ascii(said[r.doc_id])
    for r in df.select("text", pii.redact_preview(F.col("text")).alias("told"), scans.redact_baseline(F.col("text")).alias("base")).collect():
        assert r.told == plain(r.text), ascii(r.text)
        assert ("a@b.org" in r.base, "SW1A 1AA" in r.base) == ("a@b.org" in r.told, "SW1A 1AA" in r.told), ascii(r.text)


def test_words_and_numbers_of_texts_are_read_as_python_reads_them(spark):
    said = [f"longword{c}tail {c}longerword 12{c}34 {c}77 x" for c in BESIDE]
    cols = [F.regexp_extract_all("text", F.lit(P.java(p)), F.lit(0)) for p in (P.LONG_WORD, P.NUMBER_TOKEN)]
    for r in spark.createDataFrame([(t,) for t in said], "text string").select("text", *[c.alias(n) for c, n in zip(cols, "wn", strict=True)]).collect():
        assert (r.w, r.n) == (re.findall(P.LONG_WORD, r.text), re.findall(P.NUMBER_TOKEN, r.text)), ascii(r.text)


def test_table_scan_counts_and_tells_no_values(texts):
    rows = scans.scan_table(texts, ["text"], ipv6=True).collect()
    want: dict[str, int] = {}
    for t in TEXTS:
        for e, n in plain_counts(t or "").items():
            want[e] = want.get(e, 0) + n
    assert {r.entity: r.hits for r in rows} == {e: n for e, n in want.items() if n}
    assert "example" not in json.dumps([r.asDict() for r in rows]).lower()


def test_one_scan_of_the_table(texts):
    plan = scans.scan_table(texts.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_structured_leaves_and_keys(spark):
    df = spark.sql("select named_struct('m', map('a@b.org', array(1.123456789012345)), 's', 'x@y.org', 'n', 123456789012) as p")
    assert {r.entity: r.hits for r in scans.scan_structured(df).collect()} == {"email": 2}
    js = spark.createDataFrame([('{"k@x.org": [1.123456789012345, {"a": "b@x.org"}]}',)], "j string")
    assert {r.entity: r.hits for r in scans.scan_structured(js, ("j",)).collect()} == {"email": 2}


def test_spans_use_code_points_and_priorities(texts):
    got = {r.doc_id: r.s for r in texts.select("doc_id", scans.identifier_spans(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert all(t[s.start : s.end] == s.value for s in got[i])
    assert [s.entity for s in got[3]] == ["NATIONAL_ID"] and [s.entity for s in got[1]] == []


def test_redaction_order(texts, spark):
    got = {r.doc_id: r.t for r in texts.select("doc_id", pii.redact_preview(F.col("text")).alias("t")).collect()}
    assert got[3] == "id [PHONE]X" and "[EMAIL]" in got[0] and got[7] is None
    base = {r.doc_id: r.t for r in texts.select("doc_id", scans.redact_baseline(F.col("text")).alias("t")).collect()}
    assert base[2].count("[IP_ADDRESS]") == 3


def test_detector_plugs_in(texts):
    rows = scans.scan_with_detector(texts, lambda: lambda t: {"digits": sum(c.isdigit() for c in t)}, ["text"]).collect()
    assert [(r["column"], r.entity) for r in rows] == [("text", "digits")]


def test_secret_rules_name_no_secret(spark):
    df = spark.createDataFrame([("a", "password=hunter22"), ("a", "AKIA" + "B" * 16), ("b", None)], "source string, text string")
    rows = scans.scan_secrets(df, "source", "text").collect()
    assert {(r.rule, r.source, r.findings, r.records) for r in rows} == {("assigned-secret", "a", 1, 1), ("access-key", "a", 1, 1)}


def test_labels_within_a_document(spark):
    df = spark.createDataFrame([(1, "a@x.org then B@x.org, A@X.org; ip 10.0.0.1"), (2, None), (3, "")], "doc_id bigint, text string")
    out = ps.pseudonymize_per_document(df, "text")
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "[EMAIL_001] then [EMAIL_002], [EMAIL_001]; ip [IP_ADDRESS_001]" and got[1].replacements == {"EMAIL": 3, "IP_ADDRESS": 1}
    again = {r.doc_id: r.text for r in ps.pseudonymize_per_document(out.drop("replacements"), "text").collect()}
    assert again == {k: r.text for k, r in got.items()} and got[2].text is None


CORPUS = [(1, "a@x.org b@x.org"), (2, "A@x.org and c@x.org"), (3, "none")]


def test_labels_over_a_corpus(spark):
    df = spark.createDataFrame(CORPUS, "doc_id bigint, text string")
    for parts in (1, 5):
        out, labels = ps.pseudonymize_corpus(df.repartition(parts), "doc_id", "text", secret=b"k")
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == {1: "[EMAIL_001] [EMAIL_002]", 2: "[EMAIL_001] and [EMAIL_003]", 3: "none"}
        assert "x.org" not in str(labels.collect())


def test_labels_over_a_corpus_whose_order_is_text(spark):
    rows = [(f"dir/{i:03d}.txt", f"m{i}@x.org and m{i // 2}@x.org") for i in range(60)]
    df = spark.createDataFrame(rows, "path string, text string")
    seen: dict[str, int] = {}
    want = {}
    for path, text in rows:
        want[path] = re.sub(r"\S+@x\.org", lambda m: f"[EMAIL_{seen.setdefault(m[0], len(seen) + 1):03d}]", text)
    out, _ = ps.pseudonymize_corpus(df.repartition(4), "path", "text", secret=b"k")
    assert {r.path: r.text for r in out.collect()} == want


def test_no_secret_no_labels_and_no_secret_in_plans(spark):
    df = spark.createDataFrame(CORPUS, "doc_id bigint, text string")
    with pytest.raises(ValueError):
        ps.first_seen(ps.corpus_spans(df, "doc_id", "text"), b"")
    plan = df.select(keys.keyed_digest(b"hidden key", F.col("text")))._jdf.queryExecution().toString()
    assert "hidden" not in plan and b"hidden".hex() not in plan.lower()


def test_keys_fold_case_as_python_does(spark):
    values = ["\u017fam@X.ORG", "\u212aim@x.org", "Jo@X.org"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(keys.identifier_key(F.lit("EMAIL"), F.col("v"))).collect()] == [v.casefold() for v in values]


def test_map_is_extended_sealed_and_checked(spark):
    df = spark.createDataFrame(CORPUS, "doc_id bigint, text string")
    known = ps.entity_map(df.where("doc_id = 1"), "doc_id", "text", b"k")
    more = ps.extend_entity_map(known, ps.first_seen(ps.corpus_spans(df, "doc_id", "text"), b"k"))
    assert sorted(r.label for r in more.collect()) == ["[EMAIL_001]", "[EMAIL_002]", "[EMAIL_003]"] and ps.validate_map(more).count() == 0
    bad = more.unionByName(more.limit(1)).unionByName(spark.createDataFrame([("EMAIL", "d", "EMAIL-9", 9)], more.schema))
    assert {r.reason for r in ps.validate_map(bad).collect()} == {"duplicate_key", "malformed_label", "duplicate_label"}
    sealed, seal = ps.seal_map(more, b"s")
    assert ps.verify_map(sealed, seal, b"s") and not ps.verify_map(sealed, seal, b"t")
    assert not ps.verify_map(sealed.where("seq > 1"), seal, b"s")
    assert not ps.verify_map(sealed.withColumn("label", F.lit("[EMAIL_009]")), seal, b"s")


def test_digest_is_hmac(spark):
    for secret in (b"k", b"long" * 40):
        got = spark.createDataFrame([("é msg",)], "m string").select(keys.keyed_digest(secret, F.col("m")).alias("d")).first()["d"]
        assert got == hmac.new(hashlib.sha256(secret).digest() if len(secret) > 64 else secret, "é msg".encode(), hashlib.sha256).hexdigest()


def test_numbering_has_no_single_task_window(spark):
    first = spark.createDataFrame([("EMAIL", str(i), i, 0) for i in range(50)], "entity string, digest string, doc bigint, start int")
    plan = ps.numbered(first)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_literals_give_way_to_identifiers_and_to_each_other(spark):
    docs = spark.createDataFrame([(1, "Ann Lee wrote to ann.lee@x.org about Project Ann")], "doc_id bigint, text string")
    literals = spark.createDataFrame([(1, "PERSON", "Ann Lee"), (1, "ALIAS", "Ann"), (1, "ALIAS", "lee"), (1, "DATE", "Ann")], "doc bigint, entity string, literal string")
    out, spans = ps.replace_dictionary_literals(docs, "doc_id", "text", literals, b"k")
    assert out.first()["text"] == "[PERSON_001] wrote to [EMAIL_001] about Project [ALIAS_001]"
    assert sorted((r.value, r.status) for r in spans.collect()) == [("Ann", "accepted"), ("Ann", "literal_conflict"), ("Ann Lee", "accepted"), ("lee", "direct_conflict")]


def test_nominations(spark):
    docs = spark.createDataFrame([(1, "林晚在上海的海棠计划中工作，2026年")], "doc_id bigint, text string")
    good = [{"type": "person", "literal": "林晚"}, {"type": "LOCATION", "literal": "上海"}, {"type": "PROJECT", "literal": "海棠计划"}, {"type": "DATE", "literal": "2026"}, {"type": "PERSON", "literal": "林晚"}]
    bad = [{"type": "PERSON", "literal": "nobody"}, {"type": "THING", "literal": "上海"}, {"type": "PERSON", "literal": "[X_001]"}, {"type": "ROLE", "literal": "x"}, {"type": "ROLE", "literal": "2026"}, {"type": "ROLE"}]
    fence = "`" * 3
    payloads = spark.createDataFrame([(1, f"{fence}json\n{json.dumps(good)}\n{fence}"), (1, json.dumps({"entities": bad}))], "doc_id bigint, payload string")
    rows = ps.validate_nominations(docs, payloads, "doc_id", "text", "payload").collect()
    assert sum(r.reject_reason is None for r in rows) == 4
    assert sorted(r.reject_reason for r in rows if r.reject_reason) == ["length", "no_letters", "no_type_or_literal", "not_in_source", "placeholder", "unknown_type"]


def test_nominations_are_summed_up(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob"), (2, "none")], "doc_id bigint, text string")
    items = [{"type": "PERSON", "literal": "Ann"}, {"type": "PERSON", "literal": "Bob"}, {"type": "ROLE", "literal": "x"}, {"type": "PERSON", "literal": "Zed"}]
    payloads = spark.createDataFrame([(1, json.dumps(items)), (2, json.dumps(items[-1:]))], "doc_id bigint, payload string")
    got = {r.doc_id: r for r in ps.nomination_summary(ps.validate_nominations(docs, payloads, "doc_id", "text", "payload"), "doc_id").collect()}
    assert (got[1].accepted, got[1].accepted_total, got[1].rejected, got[1].reasons) == ({"PERSON": 2}, 2, 2, {"length": 1, "not_in_source": 1})
    assert (got[2].accepted, got[2].accepted_total, got[2].rejected) == ({}, 0, 1)


def test_paragraphs_are_packed_as_far_as_they_go():
    import random

    rnd = random.Random(4)
    for _ in range(300):
        text = "\n".join("x" * rnd.choice([0, 1, 3, 7, 12, 30]) for _ in range(rnd.randrange(8)))
        chunks = ps.paragraph_spans(text, 10)
        lines = [x for x in text.split("\n") if x]
        assert "".join(chunks).replace("\n", "") == "".join(lines) and all(len(c) <= 10 for c in chunks if c != text)
        # no chunk could have taken the next whole line
        for a, b in zip(chunks, chunks[1:], strict=False):
            assert len(a) + len(b.split("\n")[0]) + 2 > 10 or len(a) == 10 or max(map(len, lines)) > 10


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 4000 + "\n" + "b" * 4000), (2, None), (3, "")], "doc_id bigint, text string")
    packed = [r.chunk for r in ps.paragraph_chunks(df.where("doc_id = 1"), "doc_id", "text", 5000).orderBy("chunk_no").collect()]
    assert packed == ["a" * 4000, "b" * 4000]
    slid = [r.chunk for r in ps.sliding_chunks(df.where("doc_id = 1"), "doc_id", "text", 1000, 200).orderBy("chunk_no").collect()]
    text = "a" * 4000 + "\n" + "b" * 4000
    assert slid[0] + "".join(c[200:] for c in slid[1:]) == text
    long = spark.range(1).selectExpr("id as doc_id", "repeat('abcdefgh', 1250000) as text")
    assert ps.sliding_chunks(long, "doc_id", "text").selectExpr("sum(length(chunk)) - 256 * (count(*) - 1)").first()[0] == 10_000_000
    with pytest.raises(ValueError):
        ps.sliding_chunks(df, "doc_id", "text", 500, 0)


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var m="s@x.org";</script></head><body><!-- c@x.org --><p>Mail a@x.org &amp; co</p><a href="mailto:a@x.org" aria-label="write to b@x.org">x</a><td>10.0.0.1</td></body></html>'


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>plain")], "page_id bigint, html string")
    seen = {r.page_id: r for r in ps.html_visible_text(df, "page_id", "html").collect()}
    assert seen[1].text == "T\nMail a@x.org & co\nx\n10.0.0.1" and seen[1].attributes == ["mailto:a@x.org", "write to b@x.org"] and seen[2].text == ""
    made = {r.page_id: r for r in ps.pseudonymize_html(df, "page_id", "html").collect()}
    assert made[1].html == PAGE.replace("Mail a@x.org", "Mail [EMAIL_001]").replace("mailto:a@x.org", "mailto:[EMAIL_001]").replace("b@x.org", "[EMAIL_002]").replace("10.0.0.1", "[IP_ADDRESS_001]")
    assert made[1].residual_hits == 2 and made[1].status == "LOCAL_ONLY" and made[3].status == "MANUAL_REVIEW_REQUIRED"


def test_pages_lose_nothing(spark):
    page = "<p>a<![CDATA[keep me]]>b</p><!--[if mso]>x<![endif]--><![if !mso]><b>y</b><![endif]><?pi z?>a\u001eb@x.org<script>c@x.org</script>"
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    got = ps.pseudonymize_html(df, "page_id", "html").first()
    assert got.html == page.replace("b@x.org", "[EMAIL_001]") and got.ignored_units == 1 and got.processed_units >= 4


def test_pages_share_a_map(spark):
    df = spark.createDataFrame([(2, "<p>b@x.org</p><a title='a@x.org'>c@x.org</a>"), (10, "<p>c@x.org &amp; b@x.org</p>"), (11, None)], "page_id bigint, html string")
    out, labels = ps.pseudonymize_html_corpus(df, "page_id", "html", secret=b"k")
    got = {r.page_id: r for r in out.collect()}
    assert got[2].html == '<p>[EMAIL_001]</p><a title="[EMAIL_003]">[EMAIL_002]</a>' and got[10].html == "<p>[EMAIL_002] &amp; [EMAIL_001]</p>"
    assert got[11].html == "" and labels.count() == 3 and got[2].processed_units == 3


def test_table_residuals(spark):
    df = spark.createDataFrame([(1, "x", "=mail(a@x.org)"), (2, "b@x.org", None)], "row bigint, `c@x.org` string, note string")
    row = ps.table_residuals(df, "row").first()
    assert (row.name_hits, row.cell_hits, row.formula_hits, row.residual_hits, row.status) == (1, 1, 1, 3, "LOCAL_ONLY")
    clean = ps.pseudonymize_table(df.select("row", "note"), "row", secret=b"k")
    assert ps.table_residuals(clean.where("row = 2"), "row").first().status == "MANUAL_REVIEW_REQUIRED"


def test_tables(spark):
    df = spark.createDataFrame([(1, "a@x.org", "=a@x.org"), (2, "b@x.org", "see a@x.org"), (3, None, "")], "row bigint, mail string, note string")
    got = {r.row: (r.mail, r.note) for r in ps.pseudonymize_table(df, "row", secret=b"k").collect()}
    assert got == {1: ("[EMAIL_001]", "=a@x.org"), 2: ("[EMAIL_002]", "see [EMAIL_001]"), 3: (None, "")}


def test_pending_status_and_summary(spark):
    inputs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path_token string, input_sha256 string")
    done = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "0", "z")], "path_token string, input_sha256 string, output_sha256 string")
    stored = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "z")], "path_token string, output_sha256 string")
    assert sorted(r.path_token for r in ps.pending_documents(inputs, done, stored).collect()) == ["b", "c"]
    df = spark.createDataFrame([(1, "a@x.org"), (2, "fine")], "doc_id bigint, text string")
    status = ps.residual_status(df, "doc_id", "text")
    assert {r.doc_id: r.status for r in status.collect()} == {1: "LOCAL_ONLY", 2: "MANUAL_REVIEW_REQUIRED"}
    assert ps.batch_summary(status.withColumn("resumed", F.lit(False))).first()["status"] == "LOCAL_ONLY"


def test_scans_and_gates_count_ipv6_by_default(spark, tmp_path):
    from cloakframe.operators import release, requests
    from cloakframe.sources import tables

    df = spark.createDataFrame([(1, "seen at 2001:db8::1 today")], "doc_id bigint, note string")
    assert [(r.column, r.entity, r.hits) for r in scans.scan_table(df, ["note"]).collect()] == [("note", "ip_address", 1)]
    assert scans.scan_text_column(df, "doc_id", "note").first()["ip_address"] == 1
    assert scans.inspect_texts(df, "doc_id", "note").first()["pii_hits"] == 1
    assert ps.residual_status(df, "doc_id", "note").first()["status"] == "LOCAL_ONLY"
    assert not release.final_scan_gate(df, True).first()["passed"]
    assert not tables.stage_release(df, True, f"{tmp_path}/staged").first()["allow_after_final_scan"]
    request = "select 'GET' as method, 'https://a.example/x' as url, cast(array() as array<struct<name:string,value:string>>) as headers, cast(array() as array<struct<name:string,value:string>>) as cookies, 'from 2001:db8::1' as body"
    assert any(v == 1 for k, v in requests.inspect_requests(spark.sql(request)).first().asDict().items() if "hits" in k)
