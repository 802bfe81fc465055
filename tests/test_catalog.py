import sqlite3
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from sparkseek.functions import text as T
from sparkseek.operators import bursts, evaluation, fusion, fuzzy, lexical, mutations, ordering, pixels, reading, stats, text_index, vectors, work
from sparkseek.operators.caches import Caches
from sparkseek.operators.components import connected_components
from sparkseek.operators.lines import LINES, boxes, merge_lines, reading_rows, with_highlights
from sparkseek.operators.search import get_item, paths_of, search
from sparkseek.plans.request import SearchRequest
from sparkseek.schema import FEEDBACK, conform


class Words:
    """A fake model: one axis for each known word."""

    version, ready = "v1", True
    axes = ["dog", "cat", "red", "blue"]

    def __init__(self):
        self.asked = []

    def embed_text(self, text):
        self.asked.append(text)
        return vectors.normalise([float(a in text.lower()) + 1e-9 for a in self.axes])

    def embed_image(self, image):
        return list(image)


@pytest.fixture(scope="module")
def catalog(spark):
    unit = vectors.normalise
    rows = [
        (1, "/a/Invoice.png", "Invoice.png", "Invoice 2023 total due", 100, 5000, 1, None, unit([1, 0, 0, 0.0]), False, [], ""),
        (2, "/a/b/scan.jpg", "scan.jpg", "inv0ice scanned badly", 200, 100, 1, None, unit([0.9, 0.1, 0, 0.0]), False, ["Work"], ""),
        (3, "/a/b/notes.png", "notes.png", "credila loan cred", 300, 20, 1, 7, None, False, [], "remember the invoices"),
        (4, "/a/new.gif", "new.gif", "", 400, 0, 0, 7, None, False, [], ""),
        (5, "/a/hidden.png", "hidden.png", "invoice hidden", 500, 1, 1, None, unit([1, 0, 0, 0.0]), True, [], ""),
        (6, "/work/dog.png", "dog.png", "a picture", 600, 9, 2, None, unit([0.1, 1, 0, 0.0]), False, ["work", "ü"], ""),
    ]
    names = "id long, path string, name string, text string, mtime long, size long, stage int, group_id long, embedding array<float>, hidden boolean, user_tags array<string>, note string"
    return conform(spark.createDataFrame(rows, names).withColumn("embedding_version", F.lit("v1"))).cache()


def ids(result):
    return [r["id"] for r in result.hits.orderBy(*result.order).collect()]


def test_exact_near_and_corrections(catalog):
    found = search(catalog, SearchRequest(q="invoice", mode="text"))
    assert ids(found) == [1, 3, 2] and {r["id"]: r["kind"] for r in found.hits.collect()} == {1: "text", 3: "partial", 2: "near"}
    assert found.text_count == 3 and found.did_you_mean is None
    typo = search(catalog, SearchRequest(q="Invioce ext:png", mode="text"))
    assert typo.did_you_mean == "invoice ext:png" and typo.corrected and ids(typo)[0] == 1
    assert ids(search(catalog, SearchRequest(q="onvoice", mode="text"))) == []
    assert ids(search(catalog, SearchRequest(q="cred", mode="text"))) == [3]


def test_filters_and_unread_rows(catalog):
    by = lambda q: sorted(ids(search(catalog, SearchRequest(q=q, expand_group=None))))
    assert by("ext:gif") == [4] and by("in:b") == [2, 3] and by("in:c") == [] and by("path:B/S") == [2]
    assert by("tag:work") == [2, 6] and by("tag:ü") == [6] and by("-invoice ext:png") == [6] and by("size:empty") == [4]


def test_groups_fold_and_pages_follow(catalog):
    found = search(catalog, SearchRequest())
    assert ids(found) == [6, 4, 2, 1]
    sizes = {r["id"]: r["group_size"] for r in found.hits.collect()}
    assert sizes[4] == 2 and sizes[6] == 1
    pages = [search(catalog, SearchRequest(limit=2, offset=o)).rows() for o in (0, 2, 4)]
    assert [[r["id"] for r in p] for p, _ in pages] == [[6, 4], [2, 1], []] and [m for _, m in pages] == [True, False, False]
    assert sorted(ids(search(catalog, SearchRequest(expand_group=7)))) == [3, 4]
    shuffled = ids(search(catalog, SearchRequest(shuffle=True)))
    assert shuffled == sorted(shuffled, key=lambda i: ((i * 1103515245 + 12345) & 2147483647, i))


def test_page_envelope(catalog):
    said = F.transform(F.split("text", " "), lambda t, i: F.struct(t.alias("t"), *(i.cast("float").alias(c) for c in "xywh")))
    found = search(catalog.withColumn("lines", said), SearchRequest(q="Invioce ext:png", mode="text", limit=1))
    got = found.envelope()
    assert (got["textCount"], got["hasMore"], got["nextOffset"], got["mode"], got["didYouMean"]) == (2, True, 1, "text", "invoice ext:png")
    (hit,) = got["hits"]
    assert hit["id"] == 1 and [b["t"] for b in hit["highlights"]] == ["Invoice"] and hit["snippet"] == "Invoice"
    assert "text" not in hit and "lines" not in hit and got["filters"][0]["key"] == "ext" and got["tookMs"] >= 0


def test_text_index(spark, catalog, tmp_path):
    index = text_index.TextIndex(spark, str(tmp_path), buckets=4)
    index.build(catalog)
    same = lambda groups: {(r["id"], round(r["r"], 9)) for r in text_index.hits(index, now, now, groups, []).collect()} == {(r["id"], round(r["r"], 9)) for r in lexical.text_hits(now, now, groups, []).collect()}
    now = catalog
    assert same([["invoice"]]) and same([["invoice", "inv0ice"], ["due"]]) and {r["id"] for r in index.candidates("credila").collect()} == {3}
    changed = catalog.filter("id = 3").withColumn("text", F.lit("no such word")).withColumns({"norm": F.lit("x"), "norm_length": F.lit(12)})
    now = catalog.filter("id not in (2, 3)").unionByName(changed)
    index.update(changed, catalog.filter("id = 2").select("id"))
    assert same([["invoice"]]) and same([["word"]]) and index.candidates("credila").isEmpty() and index.rows().count() == 5
    assert index.candidates("zzz").isEmpty() and text_index.hits(index, now, now, [], ["no"]).count() > 0


def test_visual_lane_and_fusion(catalog):
    model = Words()
    found = search(catalog, SearchRequest(q="dog", mode="visual"), model, dim=4)
    assert model.asked == ["dog", "a photo of a dog."] and ids(found) == [1, 2]
    both = search(catalog, SearchRequest(q="dog"), Words(), dim=4)
    assert set(ids(both)) == {1, 2, 6} and both.semantic
    quiet = Words()
    search(catalog, SearchRequest(q="dog", mode="text"), quiet, dim=4)
    search(catalog, SearchRequest(q=""), quiet, dim=4)
    assert quiet.asked == []
    alike = search(catalog, SearchRequest(similar_to=1), Words(), dim=4)
    assert ids(alike) == [2] and alike.hits.first()["kind"] == "similar"
    assert ids(search(catalog, SearchRequest(image=[float("nan")] * 4), Words(), dim=4)) == []
    assert ids(search(catalog, SearchRequest(similar_to=1), None)) == []
    with pytest.raises(ValueError, match="All or Visual"):
        search(catalog, SearchRequest(similar_to=1, mode="text"), Words())


def test_feedback_hides_for_one_query_only(spark, catalog):
    feedback = mutations.set_relevant(spark.createDataFrame([], FEEDBACK), " Invoice ", 1, False)
    assert 1 not in ids(search(catalog, SearchRequest(q="invoice", mode="text"), feedback=feedback))
    assert 1 in ids(search(catalog, SearchRequest(q="invoice ext:png", mode="text"), feedback=feedback))
    assert mutations.set_relevant(feedback, "invoice", 1, True).count() == 0


def test_items(catalog):
    item = get_item(catalog, 4).first()
    assert item["group_size"] == 2 and item["folder"] == "/a" and not item["indexed"] and item["thumb"] == "thumb/4?v=400"
    assert [(r["place"], r["path"]) for r in paths_of(catalog, [6, 99, 1]).collect()] == [(0, "/work/dog.png"), (1, None), (2, "/a/Invoice.png")]


def test_bm25_against_sqlite(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rng.choice(words, 2)), " ".join(rng.choice(words, int(rng.integers(0, 30)))), "", " ".join(rng.choice(words, 3))) for i in range(80)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(name, text, norm, note, user_tags, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer")
    catalog = conform(spark.createDataFrame(rows, "id long, name string, text string, norm string, note string"))
    for r in catalog.collect():
        db.execute("INSERT INTO f(rowid, name, text, norm, note, user_tags) VALUES (?,?,?,?,?,?)", (r["id"], r["name"], r["text"], r["norm"], r["note"], r["user_tags_json"]))
    sql = "SELECT rowid, bm25(f, 4.0, 1.0, 0.0, 1.0, 2.0) FROM f WHERE f MATCH '{name text note user_tags} : ((\"amma\" OR \"omeg\") AND (\"elta\"))'"
    want = dict(db.execute(sql).fetchall())
    got = {r["id"]: r["r"] for r in lexical.text_hits(catalog, catalog, [["amma", "omeg"], ["elta"]], []).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


def test_large_sizes_in_the_units_of_the_sql(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 164_398, 164_399, 900_001, 8_999_999)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["id"]: r["size"] for r in queries()["byte_sizes"](spark, str(tmp_path)).collect()}
    assert got == {1: "37 B", 164_398: "1000 GB", 164_399: "1000 GB", 900_001: "29970 GB", 8_999_999: "2996999 GB"}
    assert spark.range(1).select(T.byte_size(F.lit(29_970_066_600_037))).first()[0] == "30 TB"


def test_text_scalars(spark):
    assert one(spark, T.fold, "Inv0ice CLearn |1! Çé ğß") == "lnvolce deam lll ce ğß"
    assert one(spark, T.words, "An Écran, x2y ab—cd_efg") == ["écran", "x2y", "efg"]
    for text, term, want in (("a cred b", "cred", True), ("credila", "cred", False), ("ba-a-a", "a-a", False), ("a-a-a", "a-a", True), ("a-ab-a", "a-a", False), ("x a-a a-a-", "a-a", True), ("écred", "cred", False), ("q.e", "q.e", True), ("qxe", "q.e", False)):
        assert one(spark, lambda c, t=term: T.has_word(c, t), text) is want, (text, term)
    assert [one(spark, T.color_name, h) for h in ("#000000", "#ffffff", "#808080", "#ff0000", "#8b4513", "#ffa500", "#00ff00", "#0000ff", "#zz", "#ff69b4")] == ["black", "white", "gray", "red", "brown", "orange", "green", "blue", "black", "pink"]
    assert one(spark, lambda c: T.hamming(c, F.lit("0000000000000001")), "ffffffffffffffff") == 63 and one(spark, lambda c: T.hamming(c, F.lit("x")), "0") == 64


def test_actions(spark):
    text = "Mail a.b@c.org or A.B@c.org, see https://x.io/p). or shop.example.com!\nYour code: A-1234 99999\ncall +1 (555) 123-4567 on 2024-01-02\n#FFF #a1b2c3"
    got = [(a["kind"], a["value"]) for a in one(spark, T.detect_actions, text)]
    assert ("email", "a.b@c.org") in got and ("email", "A.B@c.org") not in got
    assert ("url", "https://x.io/p") in got and ("url", "shop.example.com") in got and ("code", "A-1234") in got and ("color", "#fff") in got
    assert ("phone", "+1 (555) 123-4567") in got and not any(v == "c.org" for _, v in got)
    assert one(spark, T.action_tags, "x@y.org") == ["h:email", "h:text"] and one(spark, T.action_tags, "") == []


def test_ranks_are_global(spark):
    df = spark.range(1000).withColumn("mtime", F.col("id") % 13).repartition(9)
    got = [(r["rank"], r["id"]) for r in ordering.with_rank(df, ordering.sort_columns("newest")).orderBy("rank").collect()]
    want = sorted(range(1000), key=lambda i: (-(i % 13), i))
    assert got == [(n + 1, i) for n, i in enumerate(want)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((50, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    q = rng.standard_normal(8).tolist()
    scale = np.maximum(np.abs(v).max(axis=1), 1e-12) / 127
    z = np.sign(v) * np.floor(np.abs(v) / scale[:, None] + 0.5)
    want = dict(enumerate(scale * (z @ q)))
    for batched in (False, True):
        got = {r["id"]: r["score"] for r in vectors.nearest(rows, q, -99, batched=batched).collect()}
        assert got == pytest.approx(want)
    assert len(vectors.nearest(rows, q, -99, k=5).collect()) == 5
    assert vectors.prompts(["dog"]) == ["dog", "a photo of a dog."] and vectors.prompts(["x1"]) == ["x1"]


def test_fusion_does_not_care_about_row_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank long").withColumns({"kind": F.lit("text"), "evidence": F.array(F.lit("text"))})
    b = spark.createDataFrame([(3, 1), (4, 2)], "id long, rank long").withColumns({"kind": F.lit("visual"), "evidence": F.array(F.lit("visual"))})
    for x, y in ((a, b), (a.orderBy(F.desc("rank")), b.orderBy(F.desc("rank")))):
        got = {r["id"]: r for r in fusion.reciprocal_rank_fusion(x, y).collect()}
        assert got[3]["score"] == pytest.approx(1 / 63 + 1 / 61) and got[3]["kind"] == "text" and got[3]["evidence"] == ["text", "visual"]
    merged = fusion.merge_by_best(a.select("id", F.col("rank").alias("score")), b.select("id", F.col("rank").alias("score")))
    assert {r["id"]: r["score"] for r in merged.collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_lines(spark):
    line = lambda t, x, y, w=10.0, h=2.0: {"t": t, "x": x, "y": y, "w": w, "h": h}
    found, snippet = boxes([line("abcabc", 0.0, 0.0, 6.0), line("xx", 0.0, 5.0)], ["bc", "x"])
    assert [(b["t"], b["x"]) for b in found] == [("bc", 1.0), ("bc", 4.0), ("x", 0.0), ("x", 5.0)] and snippet == "abcabc"
    assert len(boxes([line("a" * 200, 0.0, 0.0)], ["a", "aa"])[0]) == 200
    df = spark.createDataFrame([([line("one", 0.0, 0.0), line("three", 0.0, 8.0)], [line("two", 0.0, 4.0), line("dup", 1.0, 8.5)])], f"a {LINES}, b {LINES}")
    assert [x["t"] for x in df.select(merge_lines(F.col("a"), F.col("b")).alias("m")).first()["m"]] == ["one", "two", "three"]
    marked = with_highlights(df.withColumnRenamed("a", "lines"), ["hre"]).first()
    assert marked["snippet"] == "three" and marked["highlights"][0]["t"] == "hre"
    assert [[x["t"] for x in r] for r in reading_rows([line("b", 5.0, 0.5), line("a", 0.0, 0.0), line("c", 0.0, 9.0)])] == [["a", "b"], ["c"]]


def test_a_long_burst_in_random_order_is_one_group(spark, monkeypatch):
    ids = np.random.default_rng(5).permutation(1000).tolist()
    steps = list(zip(ids, ids[1:])) + [(2001, 2000)]
    pairs = spark.createDataFrame(steps + [p[::-1] for p in steps], "a long, b long")
    monkeypatch.setattr(bursts, "burst_pairs", lambda catalog: pairs)
    got = {r["id"]: r["group_id"] for r in bursts.burst_components(None).collect()}
    assert got == dict.fromkeys(range(1000), 0) | {2000: 2000, 2001: 2000}


def test_estimates_do_not_grow_with_the_rounds_of_components(spark):
    ids = np.random.default_rng(7).permutation(300).tolist()
    got = connected_components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**1000
    assert got.select("root").distinct().count() == 1 and got.count() == 300


def test_bursts(spark):
    said = "a\nb\nc\nd\ne"
    rows = [(1, "f", 0, 0, said, None), (2, "f", 500_000, -1, said + "\nx", None), (3, "f", 1_100_000, -1, "other", None), (4, "f", 1_100_000, -8, "", None), (5, "g", 0, 0, said, None), (6, "f", 9_000_000, 0, said, None)]
    df = conform(spark.createDataFrame(rows, "id long, folder string, mtime long, dhash long, text string, group_id long").withColumn("stage", F.lit(1)))
    assert {(r["a"], r["b"]) for r in bursts.burst_pairs(df).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3), (2, 3), (3, 2), (2, 4), (4, 2)}
    groups = {r["id"]: r["group_id"] for r in bursts.group_bursts(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1}
    ordered = {r["id"]: r["group_id"] for r in bursts.group_bursts(df, "ingest").collect()}
    assert ordered == {3: 3, 4: 3, 2: 3, 1: 3}
    best = {r["id"]: r["neighbour"] for r in bursts.best_neighbours(df).collect()}
    assert best[1] == 2 and best[3] == 2
    with pytest.raises(ValueError):
        bursts.group_bursts(df, "odd")


def test_statistics(spark, catalog):
    assert stats.totals(catalog).first().asDict() == {"items": 5, "bytes": 5129, "with_text": 4}
    assert stats.status(catalog, "v1").first().asDict() == {"total": 5, "read": 4, "embedded": 3, "errors": 0, "sharp": 0}
    assert stats.backlog(catalog) == 1 and stats.group_size(catalog, 7) == 2
    months = stats.months(catalog, datetime(1970, 3, 1)).collect()
    assert len(months) == 12 and months[-3]["month"] == "1970-01" and months[-3]["items"] == 5 and months[-1]["items"] == 0
    failed = catalog.withColumn("stage", F.when(F.col("id") == 1, -1).otherwise(1))
    assert [r["message"] for r in stats.failures(failed).collect()] == ["Could not be read"]
    assert stats.state(False, False, 3) == "indexing" and stats.status_line(5, 5, False) == "5 searchable"


def test_mutations(spark, catalog):
    assert mutations.clean_labels([" A ", "a", "", "b"]) == ["A", "b"]
    for bad in ({"note": "x" * 32_001}, {"tags": ["x" * 129]}, {"source_url": "ftp://x"}, {"source_url": "https://u:p@x.org"}, {"tags": [str(i) for i in range(65)]}):
        with pytest.raises(ValueError):
            mutations.validate(**bad)
    new = mutations.update_metadata(catalog, 1, note="n", tags=["T", "t"])
    assert new.filter("id = 1").first()["user_tags"] == ["T"] and new.filter("id = 1").first()["user_tags_json"] == '["T"]'
    with pytest.raises(KeyError):
        mutations.update_metadata(catalog, 5, note="hidden")
    assert mutations.pin(catalog, 2, True).filter("pinned").count() == 1 and mutations.hide(catalog, [1, 2]).filter("hidden").count() == 3
    queue = spark.createDataFrame([(1,), (2,)], "id long")
    rest, left = mutations.delete(catalog, spark.createDataFrame([(1,)], "id long"), (queue, "id"))
    assert rest.count() == 5 and left.count() == 1
    read = spark.createDataFrame([(4, True, None, "rn", [], 5, ["#fff"], ["h:text"]), (6, False, "broken", None, None, None, None, None)], f"id long, ok boolean, message string, text string, lines {LINES}, dhash long, colors array<string>, tags array<string>")
    rows = {r["id"]: r for r in mutations.stored(catalog, read).collect()}
    assert (rows[4]["stage"], rows[4]["norm"], rows[4]["embedding"]) == (1, "m", None) and (rows[6]["stage"], rows[6]["error"], rows[6]["text"]) == (2, "broken", "a picture")
    assert one(spark, mutations.clean_label_column, [" A", "a ", "", "B"], "array<string>") == ["A", "B"]


def test_reading_storing_and_second_readings(spark):
    def reader(path, content):
        if content == b"bad":
            raise ValueError("no image")
        return {"lines": [{"t": t, "x": 0.0, "y": i / 10, "w": 1.0, "h": 0.1} for i, t in enumerate(content.decode().split("|"))], "dhash": 7, "tags": ["h:text", "c:red"]}

    catalog = conform(spark.createDataFrame([(i, f"/a/{i}", "/a", 1000 * i) for i in range(1, 6)], "id long, path string, folder string, mtime long").withColumn("stage", F.when(F.col("id") == 5, 1).otherwise(0)))
    files = spark.createDataFrame([(1, "/a/1", b"one|two|three|four"), (2, "/a/2", b"one|two|three|four"), (3, "/a/3", b"bad"), (5, "/a/5", b"bad")], "id long, path string, content binary")
    read = reading.read_batch(files, reader)
    rows = {r["id"]: r for r in reading.store(catalog, read).collect()}
    assert rows[1]["text"] == "one\ntwo\nthree\nfour" and rows[1]["stage"] == rows[2]["stage"] == 1
    assert (rows[3]["stage"], rows[3]["error"]) == (-1, "ValueError: no image") and rows[5]["stage"] == 1
    assert rows[1]["group_id"] == rows[2]["group_id"] == 1
    assert rows[4]["group_id"] is None and rows[4]["stage"] == 0
    kept = reading.store(catalog, read)
    again = reading.read_batch(spark.createDataFrame([(1, "/a/1", b"ONE|"), (2, "/a/2", b"bad")], "id long, path string, content binary"), lambda p, c: {"lines": [{"t": "ONE", "x": 0.0, "y": 0.0, "w": 1.0, "h": 0.1}], "tags": ["h:email", "c:blue"]} if c != b"bad" else 1 / 0)
    sharp = {r["id"]: r for r in reading.sharpened(kept, again).collect()}
    assert sharp[1]["text"] == "ONE\ntwo\nthree\nfour" and sharp[1]["ocr"] == 1 and sharp[1]["tags"] == ["c:red", "h:email"]
    assert sharp[2]["text"] == rows[2]["text"] and sharp[2]["ocr"] == -1 and sharp[4]["ocr"] == 0


def test_caches_follow_versions(spark):
    now, made = [0.0], []
    caches = Caches(idle_s=10, clock=lambda: now[0])
    get = lambda v: caches.get("vocabulary", v, lambda: made.append(v) or spark.range(3))
    assert get("a") is get("a") and get("b") is not None and made == ["a", "b"]
    now[0] = 11.0
    get("b")
    caches.forget("vocabulary")
    get("b")
    assert made == ["a", "b", "b", "b"]


def test_backlog_control():
    c = work.Control()
    assert c.may_work(False, True, 99, None) and not c.may_work(True, True, 99, None) and c.finish().may_work(True, False, 99, None)
    assert not c.pause().may_work(False, True, 1, None) and c.pause().resume() == c and c.finish().after(0) == c and c.finish().after(3).forced


def test_lines_of_strips_come_once():
    strips = pixels.tiles(1000, 3000)
    assert strips[0] == (0, 1400) and strips[1][0] == 1280
    line = lambda t, y: {"t": t, "x": 0, "y": y, "w": 10, "h": 20}
    got = pixels.owned_lines(strips[:2], [[line("first", 10), line("both", 1300), line("x", 50)], [line("both", 20), line("later", 100)]])
    assert [(x["t"], x["y"]) for x in got] == [("first", 10), ("both", 1300), ("later", 1380)]
    assert pixels.reading_scale(8000, 100) == 0.5 and pixels.reading_scale(10, 10) == 1.0


def test_an_image_by_path_comes_before_bytes(catalog):
    class Seen(Words):
        def embed_image(self, image):
            self.asked.append(image)
            return [1.0, 0, 0, 0]

    model = Seen()
    assert ids(search(catalog, SearchRequest(image=b"x", image_path="/p"), model, dim=4))[0] == 1 and model.asked == ["/p"]


def test_why_rows_wait():
    assert stats.waiting_reason(True, False, False, False, 9) == "paused" and stats.waiting_reason(True, True, False, False, 9) is None
    assert stats.waiting_reason(False, False, True, True, 9) == "on battery" and stats.waiting_reason(False, False, False, False, 41) == "busy"
    assert stats.waiting_reason(False, False, False, False, 40) is None and stats.waiting_reason(True, False, True, False, 0) is None
    assert stats.recent_warnings([str(i) for i in range(20)], "new") == [*map(str, range(1, 20)), "new"]


def test_work_queues(spark, catalog):
    queue = spark.createDataFrame([(6,)], "id long")
    assert [r["id"] for r in work.to_read(catalog, queue, 2).collect()] == [6, 4]
    assert [r["id"] for r in work.to_embed(catalog, queue, "v2").collect()] == [3, 2, 1]
    assert [r["id"] for r in work.to_sharpen(catalog).collect()] == [6]
    assert work.may_work(False, False, False, 41, 3_600_000) and not work.may_work(False, True, True, 0, None) and not work.may_work(False, False, False, 41, None)
    assert work.next_lane("read", {"read": True, "sharpen": True}) == "sharpen" and work.read_workers(8) == 2


def test_evaluation(spark):
    results = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 12), ("n", 1, 5)], "query string, rank long, id long")
    got = {r["query"]: r for r in evaluation.evaluate(results, spark.createDataFrame([("a", 11), ("a", 99)], "query string, id long"), spark.createDataFrame([("a", 2), ("n", 2), ("m", 2)], "query string, k int")).collect()}
    assert (got["a"]["precision"], got["a"]["recall"], got["a"]["reciprocal_rank"]) == (0.5, 0.5, 0.5) and got["n"]["no_match"] is False and got["m"]["no_match"] is True
    assert evaluation.same_results(results, results) and not evaluation.same_results(results, results.limit(2))


def test_vocabulary_and_spellings(catalog):
    vocab = fuzzy.vocabulary(catalog).cache()
    assert {r["word"] for r in fuzzy.misreads(vocab, "invoice").collect()} == {"inv0ice"}
    assert fuzzy.correct(vocab, "invioce") == "invoice" and fuzzy.correct(vocab, "voice") is None and fuzzy.correct(vocab, "abc") is None
    assert "hidden" not in {r["word"] for r in vocab.collect()}


def test_pixels():
    rng = np.random.default_rng(0)
    rgb = np.zeros((60, 90, 3), dtype=np.uint8)
    rgb[:, 45:] = (255, 0, 0)
    assert pixels.dominant_colors(rgb) == [("#000000", 0.5), ("#ff0000", 0.5)]
    assert pixels.difference_hash(rgb) == 0 and pixels.difference_hash(rgb[:, ::-1]) != 0
    assert pixels.encoder_input(rgb).shape == (3, 224, 224) and pixels.fits(100, 100) and not pixels.fits(20_000, 20_000)
    prob = np.zeros((20, 30))
    prob[4:9, 5:20] = 0.9
    prob[15, 2] = 0.9
    assert len(pixels.text_boxes(prob)) == 1
    steps = np.array([[0.1, 0.9, 0], [0.1, 0.9, 0], [0.9, 0.1, 0], [0, 0.8, 0.2], [0.1, 0.2, 0.7]])
    assert pixels.ctc_greedy(steps, ["a", "b"])[0] == "aab" and pixels.ctc_greedy(steps[2:3], ["a"]) is None
    v = rng.standard_normal(5).astype(np.float32)
    assert (pixels.floats_from_bytes(pixels.bytes_from_floats(v)) == v).all()
    assert pixels.tiles(1000, 5000)[0] == (0, 1400) and pixels.tiles(1000, 2000) == [(0, 2000)]
