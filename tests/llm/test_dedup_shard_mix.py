import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkseek.llm import mixing, sharding, simhash
from sparkseek.operators import components

DOCS = "doc_id long, text string, lang string, source string, extra int"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    label = {i: i for i in prints}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j > i and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "a b c", "É é ÉÉ x\ty\x0bz", "w " * 5000, "the cat sat on the mat " * 7])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text else None) == brute_fingerprint(text)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(160):
        if i % 4 and i > 8:
            near = texts[i - i % 4].split()
            near[rng.integers(len(near))] = "changed"
            texts[i] = " ".join(near)
        else:
            texts[i] = " ".join(rng.choice(words, rng.integers(1, 300)))
    texts |= {500: None, 501: "", 502: texts[0], 503: texts[0].upper()}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    for radius in (2, 3):
        got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, radius=radius).collect()}
        assert got == brute_components({i: brute_fingerprint(t) for i, t in texts.items()}, radius)
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == set(brute_components({i: brute_fingerprint(t) for i, t in texts.items()}, 2).values())


def test_links_with_split_tiles_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64((1 << int(x)) | (1 << int(y))) for b in base for x, y in rng.integers(0, 64, (12, 2))]
    fps = np.unique(np.concatenate([base, np.array(flips, dtype=np.uint64)]))
    prints = spark.createDataFrame([(i, int(f.astype(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count(fps[i] ^ fps[j]) <= 2}
    brute = brute_components({i: int(f) for i, f in enumerate(fps)}, 2)
    assert near
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(prints, tile_rows=3)).collect()}
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(roots.get(int(f.astype(np.int64)), ("alone", i)), set()).add(i)
    expected = {}
    for i, root in brute.items():
        expected.setdefault(root, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_a_fingerprint_with_most_rows(spark):
    rows = [(i, "same text here", "en", "s", 0) for i in range(3000)] + [(5000 + i, f"w{i} x{i} y{i} z{i}", "en", "s", 0) for i in range(40)] + [(9000, None, "en", "s", 0)]
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == 3041 and {got[i] for i in range(3000)} == {0} and got[5007] == 5007 and got[9000] == 9000


def test_forest_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    whole = simhash.forest(fps, fps, 2)
    monkeypatch.setattr(simhash, "CELLS", len(fps) * 3)
    parts = simhash.forest(fps, fps, 2)
    assert len(whole[0]) and set(zip(*whole)) == set(zip(*parts))


def test_near_duplicates_without_rows_or_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, "x y z", "en", "s", 1), (None, "x y z", "en", "s", 2), (7, "other text here", "en", "s", 3), (7, "other text here", "en", "s", 3)], DOCS)
    kept = simhash.keep_one(docs)
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 7]
    assert kept.columns == docs.columns


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]


def test_shards(spark):
    rows = [(i % 700, f"text {i % 50}" if i % 9 else None, "en", "s", i) for i in range(1500)] + [(None, "", "en", "s", 1)] * 5
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clashes"))
    got = sharding.shard_rows(docs).toPandas()
    assert len(got) == len(rows) and got.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 0 < len(moved) < len(got) / 8
    assert set(got[got["text"].isna()]["size"]) == {1} and got[got["text"].isna()]["text_crc32"].isna().all()
    assert sharding.shard_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_slots_of_a_great_many_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("shard")).unionByName(spark.range(600).select(F.col("id").cast("int").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 2).cast("int").alias("shard")))
    got = sharding.with_slots(rows, "shard", ["doc_id", "text"], 2, rows_per_block=50).toPandas()
    assert len(got) == 3600 and all(sorted(own["slot"]) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_shards_against_the_draws_by_hand(spark):
    def draw(key, path, weight):
        h = xxhash.xxh64_intdigest(path, xxhash.xxh64_intdigest(key, 42))
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    def shard(key, leaves):
        inside, path = leaves, ""
        for level in (lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)):
            names = {level(x): sum(y.weight for y in inside if level(y) == level(x)) for x in inside}
            best = min(names, key=lambda n: (draw(key, f"{path}/{n}", names[n]), n))
            inside, path = [x for x in inside if level(x) == best], f"{path}/{best}"
        return inside[0].shard

    docs = spark.createDataFrame([(i, f"t{i % 7}é", "en", "s", i) for i in range(300)], DOCS)
    for r in sharding.shard_rows(docs.withColumns({"_slot_n": F.lit("x"), "_grown_shard": F.lit("y")})).collect():
        assert (r["shard"], r["grown_shard"]) == tuple(shard(str(r["doc_id"]), sharding.tree_for(n)) for n in (16, 17))
        assert (r["size"], r["text_crc32"]) == (len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode()))
        assert (r["_slot_n"], r["_grown_shard"]) == ("x", "y")


def test_weights_move_rows_only_within_their_subtree(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.tree_for(16)
    heavier = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in tree)
    both = sharding.place(sharding.place(keys, "doc_id", tree), "doc_id", heavier, "new_").toPandas()
    moved = both[both["shard"] != both["new_shard"]]
    assert len(moved) and (moved["new_region"] == "region1").all()
    share = (both["new_shard"] == 5).mean()
    assert abs(share - 3 / 18) < 0.03
    unweighted = both["shard"].value_counts(normalize=True)
    assert (abs(unweighted - 1 / 16) < 0.02).all()


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), ["en", "de", None][int(rng.integers(3))], "big" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.3), (None, 0.2), ("absent", 9.0)], "lang string, target double").filter("lang is null or lang <> 'absent'")}
    got = mixing.mix(docs, targets=targets).toPandas()
    weight = got["n_tokens"] * got["factor"]
    by_lang = weight.groupby(got["lang"].fillna("null")).sum() / weight.sum()
    assert abs(by_lang["en"] - 0.5) < 1e-4 and abs(by_lang["null"] - 0.2) < 1e-4
    tokens = got.groupby("source")["n_tokens"].sum() ** 0.7
    by_source = weight.groupby(got["source"]).sum() / weight.sum()
    assert (abs(by_source - tokens / tokens.sum()) < 1e-4).all()
    sampled = got[got["sampled"]]
    assert abs(len(sampled) - got["keep_probability"].sum()) < 5 * np.sqrt(len(got))
    assert got["keep_probability"].max() == pytest.approx(1.0)
    again = mixing.sample(docs.repartition(7), targets=targets)
    assert again.columns == docs.columns and {r["doc_id"] for r in again.collect()} == set(sampled["doc_id"])


@pytest.mark.parametrize("small, rounds", [(50_000, 12), (0, 2)])
def test_raking_against_numpy(spark, small, rounds):
    rng = np.random.default_rng(7)
    table = rng.integers(1, 1000, (4, 3, 2)).astype(float) * (rng.random((4, 3, 2)) > 0.1)
    goals = [rng.dirichlet(np.ones(n) * 5) for n in table.shape]
    share = table / table.sum()
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            got = share.sum(axis=tuple(a for a in range(3) if a != axis))
            share = share * np.expand_dims(goal / got, tuple(a for a in range(3) if a != axis))
    cells = spark.createDataFrame([(f"{i}", f"{j}", f"{k}", float(table[i, j, k])) for i, j, k in np.ndindex(table.shape)], "a string, b string, c string, tokens double")
    targets = {m: spark.createDataFrame([(f"{i}", float(g)) for i, g in enumerate(goal)], f"{m} string, target double") for m, goal in zip("abc", goals)}
    got = {(r["a"], r["b"], r["c"]): r["share"] for r in mixing.rake(cells, targets, rounds, small=small).collect()}
    assert got == pytest.approx({(f"{i}", f"{j}", f"{k}"): share[i, j, k] for i, j, k in np.ndindex(table.shape)}, rel=1e-9)


def test_a_rare_source_is_kept_whole_and_shrinks_no_other(spark):
    rows = [(i, "w " * 50, "en", f"s{i % 4}", 0) for i in range(2000)]
    rare = spark.createDataFrame([*rows, (9999, "w " * 10, "en", None, 0)], DOCS)
    got = mixing.mix(rare).toPandas()
    assert got[got["source"].isna()]["keep_probability"].item() == 1.0
    expected = (got["n_tokens"] * got["keep_probability"]).sum() / got["n_tokens"].sum()
    assert expected > 0.95 and got["sampled"].mean() > 0.9


def test_full_cells_leave_the_targets_to_the_others(spark):
    rows = [(i, "w " * 10, ["en", "de"][i % 2], "big" if i % 10 else f"s{i % 20}", 0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), temperature={"source": 0.0, "lang": 1.0, "topic": 1.0}, keep=0.5, miss=0.0).toPandas()
    weight = got["n_tokens"] * got["keep_probability"]
    assert weight.sum() / got["n_tokens"].sum() == pytest.approx(0.5, abs=1e-4)
    assert (got[got["source"] != "big"]["keep_probability"] > 1 - 1e-4).all()
    assert (weight.groupby(got["lang"]).sum() / weight.sum())["en"] == pytest.approx(0.5, abs=1e-3)


def test_mixing_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", None, "s", 1), (1, "", None, "s", 1)], DOCS).withColumn("topic", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == 3 and all(r["keep_probability"] == 1.0 and r["topic"] == "empty" for r in got)
    assert mixing.sample(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit("own") for c in ("_source", "_topic", "kept", "draw", "sampled")})
    assert mixing.sample(clash).collect() == clash.collect() and mixing.mix(clash).count() == 3


def test_topics_learnt_from_words(spark):
    """Words that stand often in few documents name topics; words that stand everywhere don't."""
    rng = np.random.default_rng(6)
    common = ["about", "there", "which", "other"]
    themes = [["galaxy", "orbit"], ["butter", "oven"], ["tort", "plaintiff"]]
    rows = [(i, " ".join(rng.permutation(list(rng.choice(common, 20)) + list(rng.choice(themes[i % 3], 6)) + [f"unique{i}"])), "en", "s", i) for i in range(300)] + [(900, None, "en", "s", 0), (901, "Which about", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert set(mixing.learn_topics(docs, topics=6)) == {w for t in themes for w in t if len(w) > 3}
    got = {r["doc_id"]: r["topic"] for r in mixing.mix(docs, topic=mixing.WORDS).collect()}
    assert all(got[i] in themes[i % 3] for i in range(300)) and got[900] == "empty" and got[901] == "other"


def test_token_count(spark):
    texts = [None, "", "  ", "a", " a  b\nc\t"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.token_count(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in got] == [0, 0, 0, 1, 3]
