"""Archives, files, streams, live sources and the command line."""

import datetime as dt
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quillspark import cli, schemas
from quillspark.plans.export import document_files, write_files
from quillspark.sources import archives, tables
from quillspark.sources.live import LiveSource, Pace, TransientError
from quillspark.streaming import incremental


def tar(members, pad=2000):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=0) as t:
        for name, data in {**members, "pad.txt": b"x" * pad}.items():
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(info)
                continue
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def landing(tmp_path):
    import gzip

    files = {
        "good.tar.gz": tar({"a/main.tex": b"one", "REFS.BIB": b"two", "x.png": b"no", "../evil.tex": b"bad", "/abs.tex": b"bad", "link.tex": None}),
        "empty.tar.gz": tar({"readme": b"x"}),
        "small.tar.gz": b"\x1f\x8b" + b"0" * 1021,
        "edge.tar.gz": b"\x1f\x8b" + b"0" * 1022,
        "plain.tar.gz": gzip.compress(b"a" * 5000, 0),
        "text.tar.gz": b"not gzip" * 500,
    }
    whole = tar({"b.tex": b"kept", "c.tex": b"y" * 50_000})
    files["cut.tar.gz"] = whole[: len(whole) // 2]
    (tmp_path / "deep").mkdir()
    for name, data in files.items():
        (tmp_path / "deep" / name).write_bytes(data)
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def test_archives(spark, landing):
    found = archives.landed_archives(spark, str(landing))
    status = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["status"] for r in archives.gated(found).select("path", "status").collect()}
    assert status == {"good": "ok", "empty": "ok", "small": "too_small", "edge": "not_tar", "plain": "not_tar", "text": "not_gzip", "cut": "ok"}
    rows = archives.archive_members(found).collect()
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r["size"] for r in rows}
    assert {k: v for k, v in got.items() if k[0] == "good.tar.gz"} == {("good.tar.gz", "a/main.tex"): 3, ("good.tar.gz", "REFS.BIB"): 3}
    assert not [k for k in got if k[0] == "empty.tar.gz"]
    assert any(k[0] == "cut.tar.gz" and k[1].startswith("error") for k in got)
    assert tables.folder_size(spark, str(landing)).first()["files"] == 8


def test_archives_are_opened_once_and_members_leave_together(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.tar.gz").write_bytes(tar({f"{i}-{k}.tex": bytes([k]) * size for k, size in enumerate((3 << 20, 0, 5 << 20, 7))}))
    members = archives.archive_members(archives.landed_archives(spark, str(tmp_path)))
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1
    got = sorted((r["name"], r["size"], bytes(r["content"])) for r in members.collect())
    assert got == [(f"{i}-{k}.tex", size, bytes([k]) * size) for i in range(3) for k, size in enumerate((3 << 20, 0, 5 << 20, 7))]


def test_unpacked_versions(spark):
    versions = spark.createDataFrame([("p", v, s) for v, s in ((1, "exists"), (2, "error"), (3, "exists"), (4, "exists"), (6, "exists"))], "base_id string, version int, probe string")
    files = spark.createDataFrame([("p", 1, "f1", 10, "ok"), ("p", 3, "f3", 20, "not_tar"), ("p", 4, "f4", 30, "ok"), ("p", 6, "f6", 40, "ok")], "base_id string, version int, path string, length long, status string")
    members = spark.createDataFrame([("f1", 5), ("f1", 6)], "path string, size long")
    assert tuple(archives.unpacked_versions(versions, files, members).first()) == ("p", 2, 40, 11)


def test_export_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("2406.1", '{"a": "ü"}')], "base_id string, document string")
    for _ in range(2):
        assert write_files(document_files(docs, "metadata.json"), f"file://{tmp_path}/out").collect()[0]["bytes"] == 11
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["out/2406-1/metadata.json"]
    assert json.loads((tmp_path / "out/2406-1/metadata.json").read_text()) == {"a": "ü"}


def test_state(spark, tmp_path):
    assert tables.run_state(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "state.json").write_text('{"current_index": 3, "overall success rate": 0.5, "processed_papers": ["a"]}')
    assert tables.run_state(spark, str(tmp_path / "state.json")).first()["overall success rate"] == 0.5
    (tmp_path / "bad.json").write_text('{"current_index": ')
    with pytest.raises(Exception):
        tables.run_state(spark, str(tmp_path / "bad.json")).collect()


def test_stream_resumes_and_gives_each_key_once(spark, tmp_path):
    seen = []
    for part in (range(0, 60), range(40, 100)):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in part], "k long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = incremental.new_keys(spark, f"{tmp_path}/in", "k long, at timestamp", "k", 1)
        assert incremental.run_available(stream, lambda b: b.select("k"), f"{tmp_path}/out", f"{tmp_path}/cp") == 1
        seen.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert seen == [60, 100]
    assert incremental.run_available(incremental.new_keys(spark, f"{tmp_path}/in", "k long, at timestamp", "k", 1), lambda b: b.select("k"), f"{tmp_path}/out", f"{tmp_path}/cp") == 0
    within = incremental.new_keys(spark, f"{tmp_path}/in", "k long, at timestamp", "k", 1, ("at", "1 day"))
    incremental.run_available(within, lambda b: b.select("k"), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 100


def client(key):
    """For the live source."""
    if key == "none":
        return None
    if key == "bad":
        raise ValueError("broken")
    if key == "busy":
        raise TransientError("later", 0)
    return json.dumps({"key": key})


def test_live_source(spark, monkeypatch):
    import os

    here = os.path.dirname(__file__)
    spark.sparkContext.environment["PYTHONPATH"] += f":{here}"
    spark.dataSource.register(LiveSource)
    df = spark.read.format("paced_service").options(client="test_sources:client", keys="a,none,bad,busy,b", interval="0", attempts="2").load()
    got = {r["key"]: (r["status"], r["attempts"]) for r in df.collect()}
    assert got == {"a": ("ok", 1), "none": ("missing", 1), "bad": ("failed", 1), "busy": ("failed", 2), "b": ("ok", 1)}
    stopped = spark.read.format("paced_service").options(client="test_sources:client", keys="bad,bad,a", interval="0", stop_after="2").load()
    assert [r["attempts"] for r in stopped.collect()] == [1, 1, 0]


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = Pace(1.2, lambda: now[0], sleep)
    for _ in range(3):
        pace.wait()
    now[0] += 10
    pace.wait()
    assert slept == pytest.approx([1.2, 1.2])


def test_cli(spark, tmp_path, monkeypatch):
    at = dt.datetime(2024, 6, 1)
    versions = [("2406.04361", 1, "exists", "T", ["A"], "s", at, at, "e", None), ("2406.04363", 1, "exists", "U", ["A"], "s", at, at, "e", "J")]
    spark.createDataFrame(versions, schemas.PAPER_VERSIONS).write.parquet(f"{tmp_path}/in/versions")
    (tmp_path / "in/citations").mkdir()
    (tmp_path / "in/citations/r.json").write_text(json.dumps({"base_id": "2406.04361", "http_status": 200, "references": [{"paperId": "1", "title": "x", "externalIds": {"ArXiv": "1.2v1"}}]}) + "\n{broken\n")
    (tmp_path / "in/archives").mkdir()
    (tmp_path / "in/archives/2406.04361v1.tar.gz").write_bytes(tar({"m.tex": b"abc"}))
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    out = f"file://{tmp_path}/out"
    assert cli.main(["--input", f"{tmp_path}/in", "--output", out, "--last", "4363", "--export"]) == 0
    got = {r["base_id"]: r["status"] for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert got == {"2406.04361": "ok", "2406.04362": "no metadata", "2406.04363": "no sources"}
    files = sorted(str(p.relative_to(tmp_path / "out/papers")) for p in (tmp_path / "out/papers").rglob("*") if p.is_file())
    assert files == ["2406-04361/metadata.json", "2406-04361/references.json", "2406-04361/tex/2406-04361v1/m.tex", "2406-04363/metadata.json"]
    assert cli.main(["--input", f"{tmp_path}/in", "--output", out, "--last", "4363", "--resume"]) == 0
    assert spark.read.parquet(f"{out}/ledger").where(F.col("base_id") == "2406.04362").count() == 2
    assert spark.read.parquet(f"{out}/ledger").count() == 4


def test_an_oversized_member_is_an_error_and_not_lost(spark, tmp_path, monkeypatch):
    import os

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, size in (("a.tex", 2000), ("b.tex", 5000)):
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(os.urandom(size)))
    content = (tmp_path / "a.tar.gz").read_bytes()
    assert [(n, s) for n, s, _ in archives.members_of(content)] == [("a.tex", 2000), ("b.tex", 5000)]
    monkeypatch.setattr(archives, "MOST_MEMBER_BYTES", 4000)
    with pytest.raises(tarfile.TarError):
        list(archives.members_of(content))
