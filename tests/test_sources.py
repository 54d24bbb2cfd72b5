"""Files, snapshots, checksums, manifests and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sedge.operators.finder import GRANT_RECORD, DOCUMENT, normalize_grants
from sedge.operators.splitting import hash_split
from sedge.sources import provenance, tables
from sedge.streaming.refresh import deduplicated, first_wins_sink, landed_json, refresh


def test_read_raw_strips_names_and_keeps_repeats(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(" time ;a;b; a\n00:00:01;1,5;x;2\n")
    raw = tables.read_raw(spark, str(tmp_path / "raw.csv"))
    assert raw.columns == ["time", "a", "b", "a"] and tuple(raw.first()) == ("00:00:01", "1,5", "x", "2")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_raw(spark, str(tmp_path / "none.csv"))


def test_split_round_trip(spark, tmp_path):
    df = hash_split(spark.range(200), ["id"])
    tables.write_splits(df, str(tmp_path / "s"))
    assert tables.read_split(spark, str(tmp_path / "s"), "validation").count() == df.where("split = 'validation'").count()
    tables.write_splits(df.replace("validation", "val", "split"), str(tmp_path / "v"))
    assert tables.read_split(spark, str(tmp_path / "v"), "validation").count() > 0
    with pytest.raises(FileNotFoundError):
        tables.read_split(spark, str(tmp_path / "v"), "other")


def test_split_files_fall_back(spark, tmp_path):
    (tmp_path / "Val").mkdir()
    (tmp_path / "Val" / "X_val.csv").write_text("a,b\n1,2\n")
    (tmp_path / "Val" / "y_validation.csv").write_text("y\n3\n")
    x, y = tables.read_split_files(spark, str(tmp_path), "Validation")
    assert tuple(x.first()) == (1, 2) and y.first()[0] == 3
    with pytest.raises(FileNotFoundError):
        tables.read_split_files(spark, str(tmp_path), "Train")


def test_snapshot_fallback_and_single_file(spark, tmp_path):
    docs = spark.createDataFrame([("g:1", "grant", "Soil", "x", None, "u", 5, "Call topic", "live")], DOCUMENT)
    tables.write_snapshot(docs, str(tmp_path / "snap"), ["soil"])
    got = tables.search_snapshot(spark, [str(tmp_path / "gone.json"), str(tmp_path / "snap")], ["SOIL"]).first()
    assert (got["id"], got["source"]) == ("g:1", "cache")
    about = spark.read.json(str(tmp_path / "snap" / "about")).first()
    assert about["keywords"] == ["soil"] and about["generated"].endswith("Z")
    (tmp_path / "one.json").write_text(json.dumps({"generated": "x", "items": [{"id": "p:1", "kind": "policy", "title": "T", "budgetEUR": None}]}, indent=1))
    assert tables.read_snapshot(spark, [str(tmp_path / "one.json")]).first()["id"] == "p:1"
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, [str(tmp_path / "no.json")])


def test_literature_keeps_none_as_text(spark, tmp_path):
    papers = spark.createDataFrame([(0, "A, \"quoted\"\nline", "None", 2024), (1, "B", None, None)], "paper_id long, title string, countries_mentioned string, year int")
    codes = spark.createDataFrame([(0, "barriers", "abstract", "cost")], "paper_id long, dimension string, source string, code string")
    tables.write_tables({"papers.csv": papers, "codes_long.csv": codes}, str(tmp_path))
    back, codes_back = tables.read_literature(spark, str(tmp_path))
    got = {r["paper_id"]: r for r in back.collect()}
    assert got[0]["countries_mentioned"] == "None" and got[1]["countries_mentioned"] is None
    assert got[0]["title"] == "A, \"quoted\"\nline" and got[0]["year"] == 2024 and codes_back.count() == 1


def test_run_log_appends(spark, tmp_path):
    for stage in ("a", "b"):
        provenance.append_run_log(spark, str(tmp_path / "log"), stage, {"rows": 3, "word": "ä"})
    got = provenance.read_run_log(spark, str(tmp_path / "log")).collect()
    assert {r["stage"] for r in got} == {"a", "b"} and json.loads(got[0]["payload"]) == {"rows": 3, "word": "ä"}


@pytest.mark.parametrize("limit", [provenance.CONTENT_LIMIT, 4])
def test_fingerprints_whole_and_streamed(spark, tmp_path, limit):
    (tmp_path / "f x.txt").write_bytes(b"hello world")
    (tmp_path / "g.txt").write_bytes(b"abc")
    got = {r["key"].replace("%20", " "): r for r in provenance.fingerprints(spark, str(tmp_path), content_limit=limit).collect()}
    for name, content in (("f x.txt", b"hello world"), ("g.txt", b"abc")):
        assert got[name]["md5"] == hashlib.md5(content).hexdigest() and got[name]["sha256"] == hashlib.sha256(content).hexdigest()


def test_manifest(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"hello world")
    good = "5EB63BBBE01EEED093CB22BB8F5ACDC3"
    cases = {f"md5:{good}": True, "MD5:" + good.lower(): True, "md5:" + "0" * 32: False, None: True, "": True, "sha256:abc": True, "md5:": True, good: True}
    files = provenance.fingerprints(spark, str(tmp_path))
    manifest = spark.createDataFrame([("f.txt", 11, c) for c in cases] + [("gone", 1, None)], "key string, size long, checksum string")
    got = {(r["key"], r["checksum"]): (r["found"], r["ok"]) for r in provenance.verify_manifest(manifest, files).collect()}
    assert got == {**{("f.txt", c): (True, ok) for c, ok in cases.items()}, ("gone", None): (False, False)}


def test_release_manifest(spark, tmp_path):
    for name in ("data/processed/Train/x.csv", "data/results/x.csv", "notebooks/models/m.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    groups = {"files": ["Train/x.csv", "data/processed/Train/x.csv", "Train/no.csv"], "results": ["x.csv"], "models": [str(tmp_path / "notebooks/models/m.bin")]}
    paths = provenance.resolve_release(groups, str(tmp_path))
    assert len(paths) == 4
    got = provenance.release_manifest(spark, paths, provenance.list_files(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r["name"], r["missing"], r["collides"]) for r in got] == [("x.csv", False, True), ("no.csv", True, False), ("x.csv", False, True), ("m.bin", False, False)]


def test_records(spark):
    line = json.dumps({"id": 7, "doi": "d", "metadata": {"title": "T", "publication_date": "2026-06-18", "resource_type": {"title": "Dataset"}},
                       "files": [{"key": "a", "size": 1, "checksum": "md5:x"}], "links": {"self_html": "h"}})
    raw = spark.createDataFrame([(line,), ("{}",)], "v string").select(F.from_json("v", provenance.ARCHIVE_RECORD).alias("r")).select("r.*")
    full, empty = provenance.record_summaries(raw).collect()
    assert (full["record_id"], full["resource_type"], full["files"][0]["key"], full["html"]) == (7, "Dataset", "a", "h")
    assert empty["record_id"] is None and empty["files"] == []
    assert provenance.record_files(raw).count() == 2


@pytest.mark.parametrize(
    "text, number",
    [("10.5281/zenodo.1234567", "1234567"), ("https://doi.org/10.5281/zenodo.7654321", "7654321"), ("https://zenodo.org/records/12345", "12345"),
     ("12345", "12345"), (" 10.5281/zenodo.7 ", "7"), ("not-a-doi", None)],
)
def test_record_id(spark, text, number):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(provenance.record_id("x")).first()[0] == number


def test_refresh_keeps_the_first_across_batches(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    grant = lambda i, text: json.dumps({"metadata": {"identifier": [i], "description": [text]}})

    def run():
        stream = landed_json(spark, landing, GRANT_RECORD)
        docs = normalize_grants(stream)
        refresh(docs, out, state, ["id"], ["summary"]).awaitTermination()
        return {r["id"]: r["summary"] for r in spark.read.parquet(out).collect()}

    (tmp_path / "in" / "a.json").write_text(grant("1", "b first") + "\n" + grant("1", "c copy") + "\n" + grant("2", "x"))
    assert run() == {"g:1": "b first", "g:2": "x"}
    (tmp_path / "in" / "b.json").write_text(grant("1", "a later") + "\n" + grant("3", "y"))
    assert run() == {"g:1": "b first", "g:2": "x", "g:3": "y"}
    assert spark.read.parquet(out).count() == 3


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = first_wins_sink(str(tmp_path / "t"), ["id"], ["v"])
    batch = lambda *rows: spark.createDataFrame(rows, "id int, v int")
    write(batch((1, 1), (1, 0)), 0)
    for _ in range(2):
        write(batch((1, 5), (2, 5)), 1)
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 0), (2, 5)]


def test_watermark_dedupe_plans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = landed_json(spark, str(tmp_path / "in"), "id string")
    out = deduplicated(stream, ["id"], "_landed", "1 day")
    assert out.isStreaming and out.columns == ["id", "_landed"]


def test_tables_of_part_files_with_equal_names(spark, tmp_path):
    from sedge.plans import files as plans
    from sedge.sources import provenance

    for n, table in enumerate(("region", "orders", "pages")):
        folder = tmp_path / f"{table}.parquet"
        folder.mkdir()
        for part in range(2):
            (folder / f"part-{part}.parquet").write_text(f"{n} {part}")
    (tmp_path / "nation.parquet").write_text("one file")
    keys = [r["key"] for r in provenance.fingerprints(spark, str(tmp_path), "*.parquet").collect()]
    assert sorted(keys)[:3] == ["nation.parquet", "orders.parquet/part-0.parquet", "orders.parquet/part-1.parquet"] and len(set(keys)) == 7
    got = sorted(tuple(r) for r in plans.manifest_check(spark, str(tmp_path)).collect())
    assert got == [("gone.parquet", False, False), ("nation.parquet", True, True), ("orders.parquet", True, False), ("pages.parquet", True, True), ("region.parquet", True, True)]
