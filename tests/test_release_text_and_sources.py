"""Release decisions, requests, text audits, sources, streams and the registry."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloakframe.operators import release, requests, stats, text_audit
from cloakframe.plans import data_plans
from cloakframe.sources import tables
from cloakframe.streaming import streams


def test_only_validated_aggregates_are_allowed(spark):
    rows = [("raw", None, None), ("pseudonymized", True, True), ("aggregate", None, True), ("aggregate", None, None), ("synthetic", None, None), ("synthetic", False, None), ("synthetic", True, True), ("x", True, True)]
    got = release.decide_release(spark.createDataFrame(rows, "release_class string, audit_passed boolean, aggregate_validated boolean")).collect()
    assert [r.allow for r in got] == [False, False, True, False, False, False, False, False]
    assert [r.reason for r in got][4:] == ["audit_missing", "audit_failed", "rows_locked_by_policy", "no_rule"]


def test_purposes(spark):
    df = spark.createDataFrame([(" Code-Generation",), ("group summary",), ("columns",), ("share",)], "purpose string")
    assert {r.purpose: r["mode"] for r in release.route_purpose(df, "purpose").collect()} == {" Code-Generation": "synthetic", "group summary": "local_exact", "columns": "schema_only", "share": "block"}


EVIDENCE = {
    "backend_approved": True,
    "direct_pii_hits": 0,
    "exact_row_overlap": 0,
    "identifier_overlap": 0,
    "rare_quasi_overlap": 0,
    "near_copy_rate": 0.005,
    "membership_max_auc": 0.55,
    "attribute_inference_uplift": -0.05,
    "longitudinal_linkage_rate": 0.01,
    "benchmark_reproducible": True,
    "policy_reviewed": True,
    "human_review_recorded": True,
}


def test_evidence(spark):
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in EVIDENCE.items())
    rows = [EVIDENCE, {**EVIDENCE, "near_copy_rate": None, "membership_max_auc": 0.9, "backend_approved": False}]
    good, bad = release.evaluate_row_release(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()
    assert good.criteria_satisfied and not good.release_allowed
    assert bad.failed_conditions == ["backend_not_approved", "near_copy_evidence_missing", "membership_attack_signal"]
    cases = {
        None: EVIDENCE,
        "unknown_field": {**EVIDENCE, "x": 1},
        "missing_field": {k: v for k, v in EVIDENCE.items() if k != "policy_reviewed"},
        "policy_reviewed_not_boolean": {**EVIDENCE, "policy_reviewed": "true"},
        "direct_pii_hits_not_a_count": {**EVIDENCE, "direct_pii_hits": -1},
        "exact_row_overlap_not_a_count": {**EVIDENCE, "exact_row_overlap": True},
        "membership_max_auc_out_of_range": {**EVIDENCE, "membership_max_auc": 1.2},
        "near_copy_rate_out_of_range": {**EVIDENCE, "near_copy_rate": "0.1"},
    }
    lines = spark.createDataFrame([(str(k), json.dumps(v)) for k, v in cases.items()] + [("malformed", "{")], "want string, line string")
    assert all(str(r.reject_reason) == r.want for r in release.validate_evidence(lines, "line").collect())


def test_ledger_and_artifacts(spark):
    files = spark.createDataFrame([("d", "a", "s1"), ("d", "b", "s2"), ("d", "c", "s3")], "dir string, name string, sha256 string")
    scan = "artifact string, artifact_sha256 string, dir string, allow boolean, allow_after_final_scan boolean, release_class string, final_scan struct<passed:boolean>"
    manifests = spark.createDataFrame([("a", "s1", "d", True, True, "aggregate", (True,)), ("b", "0", "d", True, True, "aggregate", (True,))], scan)
    assert [r.name for r in release.issue_approvals(files, manifests, "teaching").collect()] == ["a"]
    with pytest.raises(ValueError):
        release.issue_approvals(files, manifests, " ")
    ledger = spark.createDataFrame([("p", "s1", "t", 1, "a1"), ("p", "s2", "t", 2, "a2"), ("q", "s3", "t", 3, "a3")], "path string, sha256 string, purpose string, ledger_pos int, approval_id string")
    asked = spark.createDataFrame([("p", "s1", "t"), ("p", "s1", "other"), ("q", "s9", "t")], "path string, sha256 string, purpose string")
    assert sorted((r.path, r.sha256, r.decision) for r in release.match_approvals(asked, ledger).collect()) == [("p", "s1", "allow"), ("p", "s1", "deny"), ("q", "s9", "deny")]
    current = spark.createDataFrame([("p", "s1"), ("q", "s3")], "path string, sha256 string")
    assert [r.path for r in release.list_approved(ledger, current, "t").collect()] == ["q"]
    sha = ["%064x" % i for i in range(3)]
    manifest = spark.createDataFrame([("a", sha[0], 1), ("b", sha[1], 1), ("c", sha[2], 1), ("../x", sha[0], 1), ("d", "zz", 1)], "path string, sha256 string, bytes bigint")
    actual = spark.createDataFrame([("a", sha[0], 1), ("b", sha[2], 1)], "path string, sha256 string, bytes bigint")
    got = {r.path: r.problem for r in release.verify_artifacts(manifest, actual).collect()}
    assert got == {"a": None, "b": "sha256_mismatch", "c": "missing", "../x": "path_outside_run", "d": "invalid_artifact_record"}
    assert release.set_digest(actual).first() == release.set_digest(actual.repartition(5)).first()


def test_fallback_ladder(spark):
    df = spark.createDataFrame([(i, 20 + i % 3, float(i)) for i in range(10)], "participant_id int, age int, score double")
    rows = release.resolve_release(df, False).collect()
    assert {r.name for r in rows} == {"age", "score"} and rows[0].status == "READY" and rows[0].n_bucket == "10-19"
    assert release.resolve_release(df, False, release.PROFILES["clinical"]).first()["status"] == "LOCAL_ONLY"
    assert release.resolve_release(df, True).first()["release_class"] == "row_level"
    codes = spark.createDataFrame([(1, ["near_copy_rate", "exact_row_overlap"]), (2, [])], "id int, codes array<string>")
    told = {r.id: r.actions for r in release.next_actions(codes, "id", "codes").collect()}
    assert len(told[1]) == 3 and told[1][0] == dict(release.ACTIONS)["exact_row_overlap"] and told[2] == [release.LAST_ACTION]


HAR = {
    "log": {
        "entries": [
            {
                "request": {
                    "method": "post",
                    "url": "https://api.openai.com./v1?api_key=hidden&x=1",
                    "headers": [{"name": "Authorization", "value": "hidden"}, {"name": "Content-Type", "value": "Application/JSON; q=1"}],
                    "cookies": [{"name": "c"}],
                    "postData": {"text": '{"password": "hidden", "to": "jo@x.org"}'},
                }
            },
            {"request": {"url": "http://user@relay.example:8080/a?b", "headers": []}},
            {"request": {"url": "nothing"}},
            {"other": 1},
        ]
    }
}


def test_request_captures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.har").write_text(json.dumps(HAR))
    rows = requests.inspect_requests(tables.read_har(spark, str(tmp_path / "in")))
    one, two = rows.orderBy("host").collect()
    assert (one.host, one.method, one.classification, one.provider_hint, one.content_type) == ("api.openai.com", "POST", "OFFICIAL_PROVIDER_ENDPOINT", "OpenAI", "application/json")
    assert (one.sensitive_headers, one.sensitive_query, one.secret_fields, one.cookies, one.pii_hits) == (["authorization"], ["api_key"], 1, 1, 1)
    assert (two.host, two.method, two.relay_possible) == ("relay.example", "UNKNOWN", True)
    assert "hidden" not in str([one, two]) and "jo@" not in str([one, two])
    total = requests.summarize_requests(rows).first()
    assert (total.entries, total.with_sensitive_headers, total.with_sensitive_query, total.with_secret_fields) == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        tables.read_har(spark, str(tmp_path / "in"), limit=10)
    ends = requests.classify_endpoints(spark.createDataFrame([("https://x.openai.azure.com/a",), ("http://H:81",), ("ftp://h/",)], "url string"), "url").orderBy("endpoint").collect()
    assert [(r.endpoint, r.port) for r in ends] == [(None, None), ("http://h:81", 81), ("https://x.openai.azure.com", 443)]


def test_text_audit(spark):
    pairs = [
        (1, "On 2024-05-06 Archibald Featherstone called 555-1234 about the zephyrine contract." * 1, "On 2024-05-06 Archibald Featherstone called 555-1234 about the zephyrine contract."),
        (2, "A person met another person in spring and they talked.", "Two people spoke at some length about matters of no consequence, and nothing else was said."),
        (3, None, None),
    ]
    df = spark.createDataFrame(pairs, "id bigint, source string, output string")
    got = {r.id: r for r in text_audit.audit_pairs(df.select("id", F.col("source").alias("text")), df.select("id", F.col("output").alias("text")), "id", size=16).collect()}
    assert got[1].reused_numbers == 2 and got[1].ngram_reuse_rate > 0.9 and got[1].token_reuse_rate == 1.0
    assert got[1].failed_conditions == ["source_number_reuse", "character_ngram_reuse", "distinctive_token_reuse"]
    assert got[2].eligible_for_manual_review and not got[2].release_allowed
    with pytest.raises(ValueError):
        text_audit.ngram_reuse_udf(4)


def test_ngrams_equal_plain_sets(spark):
    import random
    import unicodedata

    rnd = random.Random(1)
    pick = lambda n: "".join(rnd.choice("aB é_Ⅳ½9你.") for _ in range(n))
    pairs = [(i, s := pick(rnd.randrange(200)), s[: rnd.randrange(100)] + pick(rnd.randrange(60))) for i in range(80)] + [(90, None, "x" * 50), (91, "x" * 50, None), (92, "ab" * 40, "ab" * 30)]
    df = spark.createDataFrame(pairs, "id bigint, source string, output string")
    plain = lambda t: "".join(filter(str.isalnum, unicodedata.normalize("NFKC", t or "").lower()))
    for size in (8, 11, 32):
        want = {}
        for i, s, o in pairs:
            s, o = plain(s), plain(o)
            held = {s[k : k + size] for k in range(len(s) - size + 1)}
            said = [o[k : k + size] for k in range(len(o) - size + 1)]
            want[i] = (sum(g in held for g in said), len(said))
        assert {r.id: (r.reused_ngrams, r.output_ngrams) for r in text_audit.char_ngram_reuse(df, "id", "source", "output", size).collect()} == want


def test_ngrams_of_null_and_repeated_ids(spark):
    pairs = [(1, "a" * 300, "b" * 200), (1, (t := "".join(map(str, range(200)))), t), (None, t, t), (None, None, t)]
    df = spark.createDataFrame(pairs, "id bigint, source string, output string")
    got = sorted((str(r.id), r.reused_ngrams, r.output_ngrams) for r in text_audit.char_ngram_reuse(df, "id", "source", "output").collect())
    n = len(t) - 31
    assert got == sorted([("1", 0, 169), ("1", n, n), ("None", n, n), ("None", 0, n)])


@pytest.mark.parametrize("weak", [False, True])
def test_ngram_shares_and_collisions_change_nothing(monkeypatch, weak):
    """Hashes in shares give what they give at once, and equal hashes of different n-grams count for nothing."""
    import random

    rnd = random.Random(9)
    cases = []
    for _ in range(60):
        s = "".join(rnd.choice("abc") for _ in range(rnd.randrange(120)))
        o = s[rnd.randrange(60) :][: rnd.randrange(80)] + "".join(rnd.choice("abc") for _ in range(rnd.randrange(60)))
        held = {s[k : k + 8] for k in range(len(s) - 7)}
        cases.append((s, o, (sum(o[k : k + 8] in held for k in range(len(o) - 7)), max(len(o) - 7, 0))))
    if weak:
        strong = text_audit.ngram_hashes
        monkeypatch.setattr(text_audit, "ngram_hashes", lambda points, size: strong(points, size) % 7)
    for held in (4_000_000, 50, 9):
        monkeypatch.setattr(text_audit, "HELD", held)
        assert [text_audit.reused_ngrams(s, o, 8) for s, o, _ in cases] == [want for _, _, want in cases]


def test_words_that_come_once(spark):
    df = spark.createDataFrame([(1, "alphabet alphabet Betamaxx gammaray's", "the BETAMAXX and the alphabet"), (2, None, "x"), (3, "deltawing", None)], "id bigint, source string, output string")
    got = {r.id: tuple(r)[1:] for r in text_audit.distinctive_token_reuse(df, "id", "source", "output").collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (1, 0, 0.0)}


def test_redteam(spark):
    cases = [("c1", "direct", "Write to jo@x.org about pumps", ["jo@x.org"], [["pump", "engine"]]), ("c2", "names", "Zed runs the mill", ["zed"], [["mill"], ["river"]])]
    df = spark.createDataFrame(cases, "id string, attack_family string, source string, forbidden_literals array<string>, utility_concepts array<array<string>>")
    matrix = text_audit.redteam_matrix(df)
    got = {(r.id, r.baseline): r for r in matrix.collect()}
    assert got[("c1", "identity")].attack_success == 1 and got[("c1", "regex")].attack_success == 0 and got[("c2", "regex")].attack_success == 1
    assert got[("c1", "regex")].utility_retention == 1.0 and got[("c2", "identity")].utility_retention == 0.5
    rows = {(r.baseline, r.attack_family): r.attack_success for r in text_audit.summarize_redteam(matrix).collect()}
    assert rows[("identity", None)] == 1.0 and rows[("regex", None)] == 0.5 and len(rows) == 6


def test_remediation_reruns_only_what_fails(spark):
    text = "Quite a long report that says in many plain words what was seen near the old harbour that day, and no more."
    df = spark.createDataFrame([(1, text), (2, "Call 0123456789 now")], "id bigint, text string")
    seen = []

    def transform(rows, i):
        seen.append(sorted(r.id for r in rows.collect()))
        other = "Something was noticed, somewhere, by somebody, and it was later told in a general way to those who asked."
        return rows.withColumn("text", F.when(F.col("id") == 1, F.lit(other)).otherwise(F.lit("short")))

    final, log = text_audit.remediate(df, "id", "text", transform, 3)
    assert {r.id: r.status for r in final.collect()} == {1: "MANUAL_REVIEW_CANDIDATE", 2: "LOCAL_ONLY"}
    assert seen == [[1, 2], [2], [2]] and log.count() == 4


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', 1.5), (2, None, None)], "i int, t string, v double")
    for suffix in ("csv", "json", "parquet"):
        tables.write_table(df, f"{tmp_path}/t.{suffix}")
        assert sorted(tuple(r) for r in tables.read_table(spark, f"{tmp_path}/t.{suffix}").select("i", "t", "v").collect()) == sorted(tuple(r) for r in df.collect())
    (tmp_path / "whole.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    assert tables.read_table(spark, f"{tmp_path}/whole.json").count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_corpus_and_lines(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("sub/b.HTML", "<p>"), ("sub/c.html", "<p>é"), ("d.bin", "no")):
        (tmp_path / "c" / name).write_text(text)
    got = {r.path: (r.kind, r.text) for r in tables.read_corpus(spark, f"{tmp_path}/c").collect()}
    assert got["a.txt"] == ("text", "one") and got["sub/c.html"] == ("html", "<p>é") and "d.bin" not in got
    (tmp_path / "c" / "A.txt").write_text("two")
    with pytest.raises(ValueError):
        tables.read_corpus(spark, f"{tmp_path}/c")
    (tmp_path / "lines.txt").write_text('{"id": "a", "x": 1}\n\n{"id": "b"}\n{"id": "a", "x": 2}\nbroken\n{"id": " ", "x": 1}\n{"id": "c", "x": 3}\n')
    valid, rejects = tables.read_jsonl_checked(spark, f"{tmp_path}/lines.txt", "id string, x int", "id", ("x",))
    assert [r.id for r in valid.collect()] == ["c"]
    assert sorted((r.reason, r.line_no) for r in rejects.collect()) == [("duplicate_key", 1), ("duplicate_key", 4), ("empty_key", 6), ("malformed", 5), ("missing:x", 3)]
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        tables.read_jsonl_checked(spark, f"{tmp_path}/none.txt", "id string", "id")


def test_links_are_left_out_and_order_folds_case(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "away").mkdir()
    for place, text in (("c/b 1+.txt", "b"), ("c/A.md", "a"), ("away/x.txt", "x")):
        (tmp_path / place).write_text(text)
    (tmp_path / "c" / "link.txt").symlink_to(tmp_path / "away" / "x.txt")
    (tmp_path / "c" / "far").symlink_to(tmp_path / "away")
    rows = tables.read_corpus(spark, f"{tmp_path}/c").orderBy("order_key").collect()
    assert [r.text for r in rows] == ["a", "b"] and rows[0].order_key == "a.md"


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f"line {i}" if i % 3 else "" for i in range(2000)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.line_no: r.value for r in tables.numbered_lines(spark, f"{tmp_path}/long.txt").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines, 1))


def test_summaries_are_sorted_and_hold_no_text(spark, tmp_path):
    df = spark.createDataFrame([("e2", "m", 1.0, "secret"), ("e1", "m", 2.0, "secret")], "experiment_id string, metric string, mean double, text string")
    tables.write_summary(df, f"{tmp_path}/s")
    said = [x for f in (tmp_path / "s").glob("*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x)["experiment_id"] for x in said] == ["e1", "e2"] and "secret" not in "".join(said) and list(json.loads(said[0])) == ["experiment_id", "mean", "metric"]


def test_staging_needs_permission_and_a_clean_scan(spark, tmp_path):
    clean, dirty = spark.createDataFrame([("A", 1)], "g string, n int"), spark.createDataFrame([("a@x.org", 1)], "g string, n int")
    assert tables.stage_release(clean, True, f"{tmp_path}/a").first()["allow_after_final_scan"]
    assert not tables.stage_release(clean, False, f"{tmp_path}/b").first()["allow_after_final_scan"]
    with pytest.raises(Exception):  # noqa: B017
        tables.stage_release(clean.selectExpr("g", "raise_error('broken') as n"), True, f"{tmp_path}/e")
    assert not (tmp_path / "e" / "payload").exists()
    row = tables.stage_release(dirty, True, f"{tmp_path}/c").first()
    assert not row["allow_after_final_scan"] and row["final_scan"]["by_entity"] == {"email": 1}
    assert (tmp_path / "a" / "payload").exists() and not (tmp_path / "b" / "payload").exists() and not (tmp_path / "c" / "payload").exists() and (tmp_path / "c" / "manifest").exists()
    digests = tables.artifact_digests(spark, f"{tmp_path}/a").collect()
    assert digests and all(len(r.sha256) == 64 for r in digests)


def test_contents_of_mounted_files_are_not_read_by_the_listing(spark, tmp_path):
    """Spark reads no contents beyond maxLength (2 GB at most), and would read every file a second time."""
    (tmp_path / "x").mkdir()
    texts = {"a.bin": b"0" * 5000, "x/b.bin": b"1" * 7}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        got = {r.path: (r.sha256, r.bytes) for r in tables.artifact_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {n: (hashlib.sha256(t).hexdigest(), len(t)) for n, t in texts.items()}


def arrives(spark, folder: str, rows: list, schema: str):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_streamed_labels_agree_with_earlier_batches(spark, tmp_path):
    folder, schema = str(tmp_path), "doc_id bigint, text string"
    drops = [[(1, "a@x.org b@x.org")], [(2, "b@x.org c@x.org"), (None, "a@x.org"), (2, "none")], [(3, "d@x.org a@x.org"), (3, "d@x.org"), (4, None)]]
    for drop in drops:
        arriving = arrives(spark, folder, drop, schema)
        streams.stream_pseudonymize(arriving, "doc_id", "text", folder, b"k", shards=1).awaitTermination()
    got = sorted((str(r.doc_id), r.text or "") for r in spark.read.parquet(f"{folder}/documents").collect())
    want = [("1", "[EMAIL_001] [EMAIL_002]"), ("2", "[EMAIL_002] [EMAIL_003]"), ("2", "none"), ("3", "[EMAIL_004]"), ("3", "[EMAIL_004] [EMAIL_001]"), ("4", ""), ("None", "[EMAIL_001]")]
    assert got == want
    labels = spark.read.parquet(f"{folder}/labels").collect()
    assert "x.org" not in str(labels) and sorted(r.label for r in labels) == [f"[EMAIL_{i:03d}]" for i in (1, 2, 3, 4)]


def test_a_stream_that_fails_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    schema = "doc_id bigint, text string"
    drops = [[(10 * b + i, f"m{(i * (b + 1)) % 17}@x.org and m{i}@x.org") for i in range(9)] for b in range(4)]
    results = {}
    for kind in ("whole", "broken"):
        folder = f"{tmp_path}/{kind}"
        for drop in drops:
            arriving = arrives(spark, folder, drop, schema)
        start = lambda: streams.stream_pseudonymize(arriving, "doc_id", "text", folder, b"k", shards=3)  # noqa: E731, B023
        if kind == "broken":
            # the third batch stops after its documents, before its labels
            real = streams.rebuild

            def failing(docs, *rest, real=real):
                if docs.where("doc_id >= 20 and doc_id < 30").count():
                    raise RuntimeError("lost")
                return real(docs, *rest)

            monkeypatch.setattr(streams, "rebuild", failing)
            with pytest.raises(Exception, match="lost"):
                start().awaitTermination()
            monkeypatch.setattr(streams, "rebuild", real)
            assert spark.read.parquet(f"{folder}/documents").count() == 18
        start().awaitTermination()
        labels = spark.read.parquet(f"{folder}/labels").collect()
        assert len({r.label for r in labels}) == len({r.digest for r in labels}) == len(labels)
        by_value = {}
        for r in spark.read.parquet(f"{folder}/documents").collect():
            original = next(t for drop in drops for i, t in drop if i == r.doc_id)
            for value, label in zip(original.split(" and "), r.text.split(" and "), strict=True):
                assert by_value.setdefault(value, label) == label
        results[kind] = (len(by_value), len(labels), spark.read.parquet(f"{folder}/documents").count())
    values = len({v for drop in drops for _, t in drop for v in t.split(" and ")})
    assert results["whole"] == results["broken"] == (values, values, 36)


def test_monitored_requests(spark, tmp_path):
    import datetime as dt

    folder, schema = str(tmp_path), "id bigint, ts timestamp, method string, url string, headers array<struct<name:string,value:string>>, cookies array<struct<name:string,value:string>>, body string"
    at = lambda minute: dt.datetime(2024, 5, 1) + dt.timedelta(minutes=minute)
    row = lambda i, minute, url, body="": (i, at(minute), "get", url, [], [], body)
    ai, other = "https://api.openai.com/v1", "https://x.example/?token=1&password=2"
    first = [row(1, 0, ai, "a@x.org"), row(2, 20, other), row(2, 20, other), row(3, 65, ai), row(4, 10, "no host")]
    second = [row(1, 0, ai, "a@x.org"), row(5, 400, other)]
    third = [row(6, 5, ai), row(7, 410, other)]
    for i, drop in enumerate((first, second, third)):
        arriving = arrives(spark, folder, drop, schema)
        query = streams.stream_request_monitor(arriving, "ts", "id", "1 hour", "2 hours", folder)
        query.awaitTermination()
        # the third drop brings a row whose window is closed
        assert streams.late_rows(query) == (i == 2)
    got = {(r.window_start, r.classification): (r.entries, r.pii_hits, r.with_sensitive_query) for r in spark.read.parquet(f"{folder}/totals").collect()}
    official, custom = "OFFICIAL_PROVIDER_ENDPOINT", "CUSTOM_OR_UNKNOWN_ENDPOINT"
    assert got == {(at(0), official): (1, 1, 0), (at(0), custom): (1, 0, 1), (at(60), official): (1, 0, 0)}


def test_registry_and_entry(spark):
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and __spark_entry__.entry(spark).columns == ["column", "entity", "hits"]
    letters = {n[0] for n in names if not n.startswith(("op", "pipeline"))}
    assert letters == set("abcdefghijkl")


def test_fallback_of_many_rows_is_no_phone_number(spark, tmp_path):
    """A range such as 15000-15009 is a count; a phone number in its place, or elsewhere, is still found."""
    df = spark.range(15_000).select(F.col("id").alias("subject_id"), (F.col("id") % 90).alias("age"))
    rows = release.resolve_release(df, False, folder=f"{tmp_path}/r").collect()
    assert [(r.name, r.status, r.n_bucket) for r in rows] == [("age", "READY", "15000-15009")]
    assert spark.read.json(f"{tmp_path}/r/manifest").first()["allow_after_final_scan"]
    for name, bucket in (("a", "15000-15008"), ("a", "+44 20 7946 0958"), ("020 7946 0958", "15000-15009")):
        bad = spark.createDataFrame([(name, bucket)], "name string, n_bucket string")
        with pytest.raises(stats.GuardError):
            stats.aggregate_pii_guard(bad)


def test_corpus_files_stay_small_whatever_the_table(spark, tmp_path, monkeypatch):
    """A file is one row, held whole: more documents are more files, not longer ones."""
    spark.range(1000).selectExpr("concat('text\\n', id) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, read = [], tables.read_corpus

    def reading(*args):
        files = read(*args)
        seen.extend(len(r.text.split("\n")) - 1 for r in files.collect())
        return files

    monkeypatch.setattr(tables, "read_corpus", reading)
    row = data_plans.a3_read_corpus(spark, str(tmp_path)).first()
    assert max(seen) <= data_plans.LINES_PER_FILE and sum(seen) == row.lines == 1000
    assert row.characters == sum(len(f"text {i}\n") for i in range(1000))


def test_the_redteam_matrix_moves_no_texts(spark):
    """Each case is measured in its own row: no join, no shuffle; equal texts share all their n-grams."""
    row = ("c", "f", "x" * 20 + " mail a@b.example and 12345 " + "word " * 9, ["mail"], [["word"]])
    cases = spark.createDataFrame([row, (None, *row[1:])], "id string, attack_family string, source string, forbidden_literals array<string>, utility_concepts array<array<string>>")
    found = text_audit.redteam_matrix(cases)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.baseline: r for r in found.collect()}
    assert found.count() == 2 and set(rows) == {"identity", "regex"}
    assert rows["identity"].ngram_reuse_rate == 1.0 and rows["identity"].pii_hits == 1 and rows["regex"].pii_hits == 0
    assert text_audit.reused_ngrams("ab" * 20, "ab" * 20, 32) == (9, 9) and text_audit.reused_ngrams("ab", "ab", 32) == (0, 0)
