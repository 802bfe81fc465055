import json
import os
import time

from pyspark.sql import functions as F

from sparkseek.sources import files
from sparkseek.sources.files import below, catalog_diff, export, everywhere, export_manifest, folder_suggestions, import_sidecars, insert_or_ignore, root_of, scan, scan_roots, skipped
from sparkseek.schema import conform
from sparkseek.sources.pointers import Pointers
from sparkseek.streaming.ingest import CatalogStore, debounced, latest_events, reconcile, start


def put(path, body=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)


def test_scan_follows_the_folder_rules(spark, tmp_path):
    root = str(tmp_path / "lib")
    for p in ("a.png", "sub/B.JPG", "note.txt", "x.app/c.png", ".git/d.png", "cache/e.png", "out/f.png"):
        put(f"{root}/{p}")
    got = {r["path"][len(root) :]: r for r in scan(spark, [root], [f"{root}/out"], ("cache",)).collect()}
    assert set(got) == {"/a.png", "/sub/B.JPG"} and got["/a.png"]["folder"] == root and got["/a.png"]["size"] == 1


def test_folders_never_entered(spark):
    rows = spark.createDataFrame([("C:/Windows/x.png",), ("C:/a/Windows/x.png",), ("C:/a/Node_Modules/b/x.png",), ("C:/a/$r/x.png",), ("C:/x.png",)], "path string")
    assert [r[0] for r in rows.select(skipped(F.col("path"), "C:")).collect()] == [True, False, True, True, False]
    assert [r[0] for r in rows.select(skipped(F.col("path"), "C:/a")).collect()] == [True, False, True, True, True]


def test_checksums(spark):
    rows = spark.createDataFrame([("/m/a.bin", b"abc"), ("/m/b.bin", b"x")], "path string, content binary")
    sums = spark.createDataFrame([("a.bin", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("b.bin", "00")], "name string, sha256 string")
    assert {r["path"]: r["ok"] for r in files.verified(rows, sums).collect()} == {"/m/a.bin": True, "/m/b.bin": False}


def test_roots(spark):
    rows = spark.createDataFrame([("/a/x.png",), ("/a/b/x.png",), ("/ab/x.png",), ("/a/out/x.png",)], "path string")
    got = [r[0] for r in rows.select(root_of(F.col("path"), ["/a", "/a/b"], ["/a/out"])).collect()]
    assert got == ["/a", "/a/b", None, None]
    assert [r[0] for r in rows.select(below(F.col("path"), "/a")).collect()] == [True, True, False, True]
    assert [r[0] for r in rows.select(skipped(F.col("path"), "/a")).collect()] == [False, False, True, False]


def test_incomplete_roots_lose_nothing(spark):
    known = conform(spark.createDataFrame([(1, "/a/1.png", 5, 5), (2, "/b/2.png", 5, 5), (3, "/c/3.png", 5, 5), (4, "/a/4.png", 5, 5)], "id long, path string, mtime long, size long"))
    found = spark.createDataFrame([("/a/1.png", "/a", "1.png", 6, 5), ("/a/9.png", "/a", "9.png", 1, 1)], "path string, folder string, name string, mtime long, size long")
    got = {r["path"]: r["change"] for r in catalog_diff(found, known, ["/a", "/b"], complete=["/a"]).collect()}
    assert got == {"/a/1.png": "changed", "/b/2.png": "kept", "/c/3.png": "gone", "/a/4.png": "gone", "/a/9.png": "new"}
    merged, again = files.apply_diff(known, catalog_diff(found, known, ["/a", "/b"], complete=["/a"]))
    assert {r["id"]: r["mtime"] for r in merged.collect()} == {1: 6, 2: 5, 5: 1} and [r["id"] for r in again.collect()] == [1]
    assert insert_or_ignore(known, known.limit(1)).count() == 4


def test_sidecars_fill_empty_fields_only(spark):
    catalog = conform(spark.createDataFrame([(1, "/a/one.png", "one.png", ""), (2, "/a/two.png", "two.png", "mine"), (3, "/a/three.png", "three.png", "")], "id long, path string, name string, note string"))
    body = lambda name, v=1: json.dumps({"version": v, "imageName": name, "sourceUrl": f"https://x/{name}", "title": "T"}).encode()
    cars = [("/a/one.cap.json", 10, body("one.png")), ("/a/two.cap.json", 10, body("two.png")), ("/a/three.cap.json", 10, body("other.png"))]
    got = {r["id"]: (r["source_url"], r["note"]) for r in import_sidecars(catalog, spark.createDataFrame(cars, "path string, length long, content binary"), "cap").collect()}
    assert got == {1: ("https://x/one.png", "Captured page: T"), 2: ("https://x/two.png", "mine"), 3: ("", "")}


def test_export(spark, tmp_path):
    put(f"{tmp_path}/in/a.png", b"A")
    catalog = conform(spark.createDataFrame([(1, f"{tmp_path}/in/a.png", "a.png"), (2, f"{tmp_path}/in/lost.png", "lost.png")], "id long, path string, name string"))
    done = {r["id"]: r["ok"] for r in export(catalog, [2, 1, 1], f"{tmp_path}/out").collect()}
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert done == {1: True, 2: False} and manifest["version"] == 1 and [i["file"] for i in manifest["images"]] == ["1-a.png"]
    assert (tmp_path / "out/1-a.png").read_bytes() == b"A" and export_manifest(catalog, [1]).count() == 1


def test_folder_suggestions(spark):
    rows = spark.createDataFrame([("/a/1.png",), ("/a/b/2.png",), ("/c/x.txt",)], "path string")
    assert [(r["folder"], r["images"]) for r in folder_suggestions(rows, ["/a", "/A", "/a/b", "/c"]).collect()] == [("/a", 2), ("/a/b", 1)]


def test_stream_merges_new_files_once_and_reconcile_the_rest(spark, tmp_path):
    root, store = str(tmp_path / "lib"), CatalogStore(spark, str(tmp_path / "store"))
    put(f"{root}/a.png")
    put(f"{root}/b.png")
    assert store.read().count() == 0
    start(store, root, str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert store.read().count() == 2 and store.done(0, str(tmp_path / "cp")) and not store.done(1, str(tmp_path / "cp")) and not store.done(0, "another")
    put(f"{root}/c.png")
    start(store, root, str(tmp_path / "cp"), once=True).awaitTermination(60)
    names = {r["name"]: r["id"] for r in store.read().collect()}
    assert set(names) == {"a.png", "b.png", "c.png"} and len(set(names.values())) == 3
    os.remove(f"{root}/a.png")
    put(f"{root}/b.png", b"longer")
    assert reconcile(store, [root, str(tmp_path / "gone")]) == [root]
    rows = {r["name"]: r for r in store.read().collect()}
    assert set(rows) == {"b.png", "c.png"} and rows["b.png"]["size"] == 6 and rows["b.png"]["id"] == names["b.png"]
    assert [r["id"] for r in store.queue().collect()] == [names["b.png"]]


def test_pointers(spark, tmp_path):
    pointers = Pointers(spark, str(tmp_path / "p"))
    assert pointers.read() == {}
    dropped = [pointers.write({"v": i}) for i in range(6)]
    assert pointers.read() == {"v": 5} and len(pointers.numbers()) == 3
    assert [x["v"] for d in dropped for x in d] == [0, 1, 2]


def test_versions_that_nothing_names_are_removed(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    for i in range(5):
        store.write(conform(spark.range(i + 1)), spark.range(1), i, "s")
    assert store.read().count() == 5 and store.done(4, "s") and not store.done(5, "s")
    assert len([p for p in os.listdir(tmp_path / "store") if len(p) == 32]) == 3


def test_roots_that_cannot_be_listed(spark, tmp_path):
    put(str(tmp_path / "r/a.png"))
    found, complete = scan_roots(spark, [str(tmp_path / "r"), str(tmp_path / "none")])
    assert complete == [str(tmp_path / "r")] and [r["name"] for r in found.collect()] == ["a.png"]
    assert everywhere(spark, "/home/x") == ["/home/x"] and everywhere(spark, "/h", [str(tmp_path), "/nowhere"]) == [str(tmp_path)]


def test_events_settle(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text('{"path": "a", "event_ms": 1}\n{"path": "a", "event_ms": 5}\n{"path": "b", "event_ms": 2}\n')
    stream = spark.readStream.schema("path string, event_ms long").json(str(events))
    query = debounced(stream, 200).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(150):
            got = {(r["path"], r["last_ms"]) for r in spark.table("settled").collect()}
            if len(got) == 2:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert got == {("a", 5), ("b", 2)}
    batch = spark.createDataFrame([("a", 1), ("a", 4)], "path string, event_ms long")
    assert latest_events(batch).first()["last_ms"] == 4
