"""Golden cases of the paper operators."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark import functions as fn
from quillspark import schemas
from quillspark.operators import citations, ledger, metadata, throttle, versions

DAY = dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone.utc)


def version(base, v, probe="exists", title="t", authors=("A",), published=DAY, updated=DAY, venue=None):
    return (base, v, probe, title, list(authors) if authors is not None else None, "s", published, updated, "e", venue)


def test_metadata_fold(spark):
    rows = [
        version("gap", 1, title="one", venue="J"), version("gap", 2, title="two", updated=None, venue=""), version("gap", 4, title="four"),
        version("err", 1), version("err", 2, "error"), version("err", 3), version("none", 2), version("nodate", 1, published=None, updated=None, authors=None),
        version("uni", 1, title="Ünïcode 漢字"), *[version("many", v, title=str(v)) for v in range(1, 60)], version("micro", 1, published=DAY.replace(microsecond=5)),
    ]
    got = {r["base_id"]: r for r in metadata.fold_metadata(spark.createDataFrame(rows, schemas.PAPER_VERSIONS)).collect()}
    assert set(got) == {"gap", "err", "nodate", "uni", "many", "micro"}
    assert (got["gap"]["paper_title"], got["gap"]["versions"], got["gap"]["publication_venue"]) == ("two", 2, "J")
    assert got["gap"]["revised_dates"] == ["2024-06-01T12:00:00+00:00"]
    assert got["err"]["versions"] == 1 and got["err"]["publication_venue"] is None
    assert (got["nodate"]["submission_date"], got["nodate"]["revised_dates"], got["nodate"]["authors"]) == ("", [], [])
    assert (got["many"]["versions"], got["many"]["paper_title"]) == (50, "50")
    assert got["micro"]["submission_date"] == "2024-06-01T12:00:00.000005+00:00"
    documents = {r["base_id"]: json.loads(r["document"]) for r in metadata.metadata_documents(metadata.fold_metadata(spark.createDataFrame(rows, schemas.PAPER_VERSIONS))).collect()}
    assert documents["uni"]["paper_title"] == "Ünïcode 漢字" and documents["err"]["publication_venue"] is None
    assert set(documents["gap"]) == {"paper_title", "authors", "submission_date", "revised_dates", "publication_venue"}


def test_existing_prefix_against_a_loop(spark):
    random.seed(4)
    probes = [(k, v, random.choice(["exists", "exists", "exists", "error", "missing"])) for k in range(60) for v in range(1, 54) if random.random() > 0.06]
    df = spark.createDataFrame(probes, "k int, v int, probe string")
    got = sorted(map(tuple, versions.existing_prefix(df, "k", "v", "probe", F.col("probe") == "exists").select("k", "v").collect()))
    want, known = [], {(k, v): p for k, v, p in probes}
    for k in range(60):
        for v in range(1, 51):
            p = known.get((k, v), "missing")
            if p == "missing":
                break
            if p == "exists":
                want.append((k, v))
    assert got == sorted(want)


def work(id_, ids=None, authors=("N",), title="t", date=None):
    return Row(paperId=id_, title=title, publicationDate=date, externalIds=ids, authors=[Row(name=a) for a in authors] if authors is not None else None)


def test_citations(spark):
    rows = [
        ("a", 200, [work("1", {"ArXiv": "2401.00001v2"}, title="old"), work("2", {"ArXiv": "", "arXiv": "2401.00002"}), work("3"), work("4", {"DOI": "x"}), work("5", {"arXiv": "2401.00001v3"}, None, "new")]),
        ("old", 200, [work("6", {"ArXiv": "solv-int/9901001"}), work("7", {"ArXiv": "solv-int/9901002v2"}, (None, "B"))]),
        ("null", 200, None), ("hole", 200, [None, work("8", {"ArXiv": "2401.00009"})]), ("bad", 404, [work("9", {"ArXiv": "2401.00001"})]),
    ]
    df = spark.createDataFrame(rows, schemas.CITATIONS)
    got = {(r["base_id"], r["ref_key"]): r for r in citations.extract_citations(df).collect()}
    assert set(got) == {("a", "2401-00001"), ("a", "2401-00002"), ("old", "solv-int/9901001"), ("old", "solv-int/9901002"), ("hole", "2401-00009")}
    first = got["a", "2401-00001"]
    assert (first["paper_title"], first["authors"], first["semantic_scholar_id"], first["position"]) == ("new", [], "5", 0)
    assert got["old", "solv-int/9901002"]["authors"] == [None, "B"]
    assert {r["ref_key"] for r in citations.extract_citations(df, compat_keys=True).where("base_id = 'old'").collect()} == {"sol"}
    counts = dict(map(tuple, citations.count_citations(citations.extract_citations(df)).collect()))
    assert counts == {"a": 2, "old": 2, "hole": 1}
    document = json.loads(citations.reference_documents(citations.extract_citations(df)).where("base_id = 'a'").first()["document"])
    assert list(document) == ["2401-00001", "2401-00002"] and document["2401-00001"]["submission_date"] is None
    statuses = dict(citations.route_status(spark.createDataFrame([(200,), (429,), (500,), (None,)], "http_status int")).collect())
    assert statuses == {200: "ok", 429: "retry", 500: "failed", None: "failed"}


def test_ledger_and_state(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "base_id string")
    done = spark.createDataFrame([("d",), ("d",)], "base_id string")
    found = spark.createDataFrame([("a",), ("b",)], "base_id string")
    refs = spark.createDataFrame([("a", 3), ("c", 1)], "base_id string, references int")
    sources = spark.createDataFrame([("a", 2, 10, 20)], "base_id string, versions int, original_size long, extracted_size long")
    results = ledger.assemble(ledger.todo(ids, done), found, refs, sources)
    got = {r["base_id"]: r for r in results.collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["status"], got["b"]["status"], got["c"]["status"]) == ("ok", "no sources", "no metadata")
    assert (got["c"]["success"], got["c"]["references"], got["c"]["error"]) == (False, 0, "no metadata")
    full = results.withColumns({"rss_bytes": F.lit(4).cast("long"), "finished_at": F.lit(None).cast("timestamp")})
    s = ledger.run_statistics(full).first()
    assert (s["attempted"], s["successful_papers"], s["total_references"], s["papers_with_references"], s["avg_refs"]) == (3, 2, 3, 1, 1.5)
    state = json.loads(ledger.state_document(ledger.run_statistics(full), full.where("success"), F.lit(1), F.lit("now")).first()[0])
    assert state["processed_papers"] == ["a", "b"] and state["overall success rate"] == pytest.approx(2 / 3) and len(state) == 18
    empty = ledger.run_statistics(spark.createDataFrame([], schemas.LEDGER)).first()
    assert empty["attempted"] == 0 and empty["overall_success_rate"] == 0 and empty["max_memory"] == 0 and empty["total_time"] == 0
    assert sorted(r[0] for r in ledger.slice_ids(ids, "base_id", 1, 2).collect()) == ["b", "c"]
    assert ledger.slice_ids(ids, "base_id", 1, 0).count() == 3
    with pytest.raises(ValueError):
        ledger.at_checkpoints(full, 0)


def test_throttle_against_the_recurrence(spark):
    random.seed(5)
    at = sorted(random.randrange(0, 40_000) for _ in range(500))
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", a) for i, a in enumerate(at)], "i long, s string, a long")
    got = {r["i"]: r["granted"] for r in throttle.throttle_schedule(df, "a", F.floor(F.col("a") / 5000), ["a", "i"], 90).collect()}
    last, want = None, {}
    for i, a in enumerate(at):
        last = a if last is None else max(a, last + 90)
        want[i] = last
    assert got == want
    own = {r["i"]: r["granted"] for r in throttle.throttle_schedule(df, "a", F.floor(F.col("a") / 5000), ["a", "i"], 90, "s").collect()}
    for s in "xy":
        last = None
        for i, a in enumerate(at):
            if ("x" if i % 3 else "y") == s:
                last = a if last is None else max(a, last + 90)
                assert own[i] == last


def test_running_totals(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = ledger.running_totals(df, F.floor(F.col("id") / 100), ["id"], {"total": F.col("v")}).orderBy("id").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 7
        assert (r["seq"], r["total"]) == (i + 1, total)


def test_functions(spark):
    r = spark.range(1).select(
        fn.base_id(F.lit(123456), "2406").alias("long"), fn.truthy(F.lit("")).alias("blank"), fn.ratio(F.lit(1), F.lit(0)).alias("zero"), fn.backoff_seconds(F.lit(4)).alias("wait"),
        fn.has_extension(F.lit("a/MAIN.TEX"), ".tex").alias("tex"), fn.has_extension(F.lit("a.texx"), ".tex").alias("texx"), fn.is_gzip(F.lit(b"\x1f\x8bx")).alias("gz"), fn.is_gzip(F.lit(b"")).alias("none"),
        fn.iso_time(F.lit(None).cast("timestamp")).alias("no_time"), fn.service_url("http://s/arXiv:{}", F.lit("1.2")).alias("url"),
    ).first()
    assert tuple(r) == ("2406.123456", None, 0.0, 16, True, False, True, False, None, "http://s/arXiv:1.2")


@given(st.lists(st.booleans(), max_size=20))
def test_backoff_never_waits_after_the_last_attempt(outcomes):
    from quillspark.sources.live import Pace, TransientError, fetch

    waits, left = [], list(outcomes)

    def client(key):
        if left and not left.pop(0):
            raise TransientError("busy")
        return "{}"

    row = fetch("k", client, Pace(0), 4, waits.append)
    assert waits == [2.0**i for i in range(1, min(row[2], 4) if row[1] == "ok" else 4)]


def test_repeated_versions_count_once(spark):
    rows = [("a", 1, "x"), ("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d"), ("a", 5, "e"), ("b", 2, "f"), ("b", 2, "f")]
    df = spark.createDataFrame(rows, "key string, version int, title string")
    got = versions.contiguous_prefix(df, "key", "version", F.lit(True))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d")]
    probed = df.withColumn("probe", F.lit("exists"))
    got = versions.existing_prefix(probed, "key", "version", "probe", F.lit(True))
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("a", 1, "b"), ("a", 2, "c"), ("a", 3, "d")]
