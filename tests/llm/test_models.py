import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import ann, chat, decontam, langid, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"


def made_up(lang, n, rng):
    parts = {"aa": ["the", "ing", "and", "er", "tion"], "bb": ["ung", "sch", "ein", "ge", "ü"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


# language


def trained(texts_by_lang):
    counted = [np.unique(np.concatenate([langid.packed([langid.symbols(t)])[0] for t in texts]), return_counts=True) for texts in texts_by_lang.values()]
    return langid.Model(list(texts_by_lang), [g for g, _ in counted], [c for _, c in counted])


def test_kneser_ney_is_a_distribution():
    model = trained({"x": ["abracadabra abra", "cadabra bar"]}).models[0]
    letters = [ord(c) for c in "abrcd "]
    for context in ("   ", "abr", "xyz", " ca", "zab"):
        packed = 0
        for c in context:
            packed = packed << 16 | ord(c)
        keys = np.array([(packed << 16 | c) & (1 << 64) - 1 for c in [*letters, ord("?")]], dtype=np.uint64)
        assert np.exp(model.log_p(keys)).sum() == pytest.approx(1.0, abs=1e-4)


def brute_kneser_ney(texts, alphabet):
    """A function from a 4-gram to the chance of its last character, from the definition."""
    read = lambda t: "   " + "".join(map(chr, langid.symbols(t)))
    grams = Counter(s[i : i + 4] for s in map(read, texts) for i in range(len(s) - 3))
    orders = {4: grams}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def chance(g):
        if not g:
            return 1 / alphabet
        counts = orders[len(g)]
        n1, n2 = (sum(v == n for v in counts.values()) for n in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        after = [v for h, v in counts.items() if h[:-1] == g[:-1]]
        return chance(g[1:]) if not after else max(counts[g] - d, 0) / sum(after) + d * len(after) / sum(after) * chance(g[1:])

    return lambda text: -np.mean([np.log(chance(s[i : i + 4])) for s in [read(text)] for i in range(len(s) - 3)])


def test_kneser_ney_against_its_definition():
    rng = random.Random(4)
    texts = {lang: [made_up(lang, 12, rng) for _ in range(6)] for lang in ("aa", "bb")}
    model = trained(texts)
    alphabet = len({c for t in texts.values() for s in t for c in map(int, langid.symbols(s))}) + 1
    asked = [made_up("aa", 5, rng), made_up("bb", 5, rng), "the schunge", "Zzz qqq", "x"]
    got, lengths = model.entropies(asked)
    for i, lang in enumerate(texts):
        brute = brute_kneser_ney(texts[lang], alphabet)
        assert got[:, i] == pytest.approx([brute(t) for t in asked], rel=1e-5)
    assert lengths.tolist() == [len(langid.symbols(t)) for t in asked]


def test_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(5)
    model, texts = trained({"aa": [made_up("aa", 30, rng)], "bb": [made_up("bb", 30, rng)]}), [made_up("aa", 80, rng), "x", None, made_up("bb", 9, rng)]
    whole = model.entropies(texts)
    counts = lambda: {g: n for batch in langid._count(iter([pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array(texts[:2] + texts[3:])], names=["lang", "text"])])) for g, n in zip(zip(batch[0].to_pylist(), batch[1].to_pylist()), batch[2].to_pylist())}
    grams = counts()
    monkeypatch.setattr(langid, "STEP", 7)
    parts = model.entropies(texts)
    assert np.allclose(whole[0], parts[0], equal_nan=True, rtol=1e-9) and whole[1].tolist() == parts[1].tolist() and counts() == grams


def test_languages_in_groups_give_the_same(spark):
    rng = random.Random(8)
    rows = [(i, made_up("aa" if i % 2 else "bb", rng.randint(3, 30), rng), ["bb", "aa", "cc"][i % 2 if i % 7 else 2], "s", "x") for i in range(120)] + [(900, None, "aa", "s", "x"), (901, "12", None, "s", "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_text": F.lit("own"), "h": F.lit(1), "n": F.lit(2)})
    whole = langid.identify(docs, langid.train(docs)).orderBy("doc_id").collect()
    model = langid.train(docs, model_bytes=1)
    assert len(model.groups(1)) == 3 and len(model.groups(1 << 30)) == 1
    assert langid.identify(docs, model, model_bytes=1).orderBy("doc_id").collect() == whole


def test_symbols():
    read = lambda t: "".join(map(chr, langid.symbols(t)))
    assert read("  Ab, c1\n") == "ab c " and read("É") == "é " and read("12 !") == "" and read(None) == ""


def test_languages_are_told_apart(spark):
    rng = random.Random(0)
    rows = [(i, made_up("aa" if i % 2 else "bb", rng.randint(3, 60), rng), "aa" if i % 2 else "bb", "s", "x") for i in range(300)]
    rows += [(900, None, "aa", "s", "x"), (901, "12 34 !!", None, "s", "x"), (902, "", "bb", "s", "x"), (None, made_up("aa", 20, rng), "aa", "s", "x"), (903, "the and tion", None, "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, langid.train(docs))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert all(rows[i]["lang_pred"] == rows[i]["lang"] and 0 <= rows[i]["score"] <= 1 for i in range(300))
    assert not any(rows[i]["rejected"] for i in range(300))
    for i in (900, 901, 902):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"]
    assert rows[903]["lang_pred"] == "aa" and set(docs.columns) <= set(got.columns)


def test_a_small_language_beside_more_than_a_million_grams(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(map(chr, rng.integers(0x4E00, 0x8E00, 20_000))), "zh") for i in range(80)]
    rows += [(1000 + i, f"{w}q once", "xx") for i, w in enumerate(["abc", "defg", "hijk", "lmno", "prst", "uvwy"])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert model.langs == ["xx", "zh"] and len(model.models[1].grams[langid.ORDER].hashes) > 1_000_000


def test_limits_are_finite_and_one_odd_row_opens_none(spark):
    words = ["water", "house", "green", "river", "small", "stone"]
    text = lambda i: " ".join(words[(i * k + k) % 6] for k in range(3, 23))
    odd = "zqxjk vwqzx kqjzv xzqwk jvqxz qkzjx wvzqk xjqkz"
    learnt = [i for i in range(2000, 2010) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text(i), "en") for i in range(2500)] + [(learnt[0], odd, "en"), (learnt[1], "same words here", "one"), (learnt[2], "same words here", "two")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "one", "two"] and np.isfinite(model.limit).all()
    assert model.predict([text(7), odd[::-1]])[3].tolist() == [False, True]


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, "s", "x")], DOCS)
    assert langid.train(docs) is None and langid.identify(docs, None).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), None).count() == 0


# decontamination


def brute_marks(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words = split(text)
    hit, names = set(), set()
    for name, item in items:
        w = split(item)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[i : i + n]:
                    hit.update(range(at, at + n))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("group_bytes", [2 << 20, 400])
def test_decontamination_against_brute_force(spark, group_bytes):
    rng = random.Random(1)
    word = lambda: rng.choice(["The", "of", "in", "é", "x1", "fox", "JUMPS", "dog"])
    sentence = lambda n: " ".join(word() + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 3, 12, 13, 14, 30]) if i < 9 else 30)) for i in range(20)]
    items = [(i, t if len(t.split()) > 2 else t + " zq") for i, t in items] + [(50, None), (51, "..."), (None, "only here five words"), (19, "same id other text")]
    texts = [sentence(rng.randint(0, 60)) for _ in range(60)]
    texts += [sentence(9) + " " + items[12][1].upper() + " " + sentence(40), items[15][1] + "\n" + items[16][1], items[14][1][40:], None, "", "x only HERE five words", items[13][1] + " " + items[13][1]]
    docs = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.mark(docs, bench, group_bytes=group_bytes).collect()}
    for i, t in enumerate(texts):
        hit = sum(s["end"] - s["begin"] for s in got[i]["hit_spans"])
        assert (got[i]["n_words"], hit, got[i]["hit_items"]) == brute_marks(t, items), t
    assert decontam.mark(docs, bench.limit(0)).filter("size(hit_spans) > 0").count() == 0
    assert decontam.mark(docs.limit(0), bench).count() == 0


def test_contaminated_documents_go(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, item, "en", "s", "x"), (2, " ".join(f"v{i}" for i in range(50)), "en", "s", "x"), (3, item + " z" * 400, "en", "s", "x"), (4, None, "en", "s", "x")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, item), (10, item)], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in decontam.op5_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got[1]["contaminated"] and not got[3]["contaminated"] and got[3]["n_hit"] == 20
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,7").hexdigest() and got[1]["n_items"] == 2


def test_stages_leave_clashing_columns_alone(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item, 7, "a"), (2, "other words", 8, "b")], "doc_id long, text string, n_words int, hit_spans string").withColumn("_found_n_words", F.lit("c"))
    bench = spark.createDataFrame([(i, f"{item} v{i}") for i in range(30)], "item_id long, text string")
    for group_bytes in (1 << 20, 500):
        (row,) = decontam.drop_contaminated(docs, bench, group_bytes=group_bytes).collect()
        assert tuple(row) == (2, "other words", 8, "b", "c")


def test_spans_of_several_passes_join(spark):
    rows = [([(5, 9), (1, 3), (3, 4), (9, 12), (20, 21)],), ([],)]
    got = spark.createDataFrame(rows, "s array<struct<begin: long, end: long>>").select(decontam._union_of_spans(F.col("s")).alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] for r in got] == [[(1, 4), (5, 12), (20, 21)], []]


# chat


def test_snapshots_collapse(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", None), ("assistant", "<|im_end|> d")]
    rows = [(c, t, *said[t], 0) for c, n in ((1, 2), (2, 3), (3, 4), (4, 4)) for t in range(n)]
    rows += [(5, t * 7 + 2, *said[t], 0) for t in range(3)] + [(6, 0, "user", "a", 0), (6, 1, "assistant", "other", 0)]
    rows += [(7, 0, None, "", 0), (8, 0, None, None, 0), (None, 0, "user", "a", 0), (9, 1, "user", "twice", 0), (9, 1, "user", "twice", 0)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")).collect()}
    assert set(got) == {3, 6, 7, 8, 9}
    assert got[3]["n_copies"] == 2 and got[3]["n_turns"] == 4 and got[9]["n_turns"] == 2
    assert got[3]["chat"].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb") and got[3]["chat"].count("<|im_end|>") == 4
    assert got[7]["chat"] == "<|im_start|>unknown\n<|im_end|>\n"


def test_long_conversations_cross_segments(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 9000), (2, 8999), (3, 5)) for t in range(n)] + [(4, t, "user", f"t{t}" if t != 4500 else "x") for t in range(8000)]
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == {(1, 9000), (4, 8000)}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    plain, bad = [f"w{i}" for i in range(300)], ["scumx", "idiotx", "trashx"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))] + [rng.choice(bad) for _ in range(3)] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", "x"))
        labels += [(i, 1, int(toxic) if rng.random() > 0.03 else int(not toxic))] if i % 3 else []
    rows += [(1000, None, "en", "s", "x"), (1001, "", "en", "s", "x")]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(2000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert got[1000] == got[1001] < 0.5
    clash = docs.withColumns({"_text": F.lit("idiotx"), "words": F.lit(1)})
    assert {r["doc_id"]: r["score"] for r in toxicity.score(clash, toxicity.train(clash, known)).collect()} == got
    empty = toxicity.train(docs, known.limit(0))
    assert toxicity.score(docs, empty).filter("score < 0.01").count() == len(rows) and toxicity.score(docs.limit(0), empty).count() == 0


def test_whole_texts_are_observed():
    text = "a" * 150_000 + " ! B" * 50_000
    seen = toxicity.observe(text)
    assert (seen.letters, seen.capitals, seen.exclamations) == (200_000, 50_000, 50_000) and set(seen.words) == {"a" * 150_000, "b"}
    assert toxicity.observe(None) == toxicity.observe("") == toxicity.Observed([], 0, 0, 0)


def test_toxicity_without_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.op7_toxicity(spark, str(tmp_path)).count() == 0 and langid.op9_language_id(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, "aa", "s", "x"), (2, "short text", "bb", "s", "x"), (3, "", "aa", "s", "x")], DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[2] == "bb" and got[3] == "und"
    bench = spark.createDataFrame([(1, " ".join(f"word{i % 977}" for i in range(976, 990)))], "item_id long, text string")
    (row,) = decontam.mark(docs.filter("doc_id = 1"), bench).collect()
    assert row["n_words"] == 200_000 and sum(s["end"] - s["begin"] for s in row["hit_spans"]) == 14 * (200_000 // 977) + 13  # the text begins with the second window
    assert toxicity.score(docs, toxicity.Classifier([], np.empty(0), 0.0)).filter("score = 0.5").count() == 3


# vectors


def brute_nearest(ids, v, k):
    out = {}
    for i, q in zip(ids, v):
        if i % 20 == 0:
            found = sorted(((float((q * x).sum()), j) for j, x in zip(ids, v) if j != i), key=lambda s: (-s[0], s[1]))[:k]
            out[i] = [j for _, j in found]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    v = np.concatenate([centres[rng.integers(0, 12, 2500)] + 0.4 * rng.standard_normal((2500, 24)), np.tile(rng.standard_normal(24), (700, 1))]).astype(np.float32)
    ids = np.arange(len(v))
    rows = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(rows, ann.F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    exact = brute_nearest(ids, v.astype(np.float64), 20)
    assert set(got) == set(exact) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({r["vec_id"] for r in got[i].values()} & set(exact[i])) / 20 for i in exact])
    assert recall >= 0.9
    for i, g in got.items():
        order = [(-g[k]["score"], g[k]["vec_id"]) for k in range(1, 21)]
        assert order == sorted(order)
        assert g[1]["score"] == pytest.approx(float(v[i].astype(np.float64) @ v[g[1]["vec_id"]].astype(np.float64)), abs=1e-12)


def test_vectors_that_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (8, [float("inf"), 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(docs, ann.F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    lengths = docs.unionByName(spark.createDataFrame([(40, [2.0]), (60, [1.0, 1.0, 1.0])], docs.schema))
    more = [tuple(r) for r in ann.search(lengths, ann.F.col("id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(more) == sorted([*got, (40, 1, 7, 2.0)])
    assert ann.search(docs.limit(0), ann.F.col("id") % 20 == 0).count() == 0


def test_queries_whose_lists_are_short_read_everything(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((900, 8)).astype(np.float32)
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    most = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1).max()))
    router = ann.Router(ann.balanced_centroids(ann._even(v.astype(np.float64), most), 150), most)  # lists of about six; one is read
    got = {}
    for r in ann.search(rows, ann.F.col("id") % 20 == 0, router=router).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    exact = brute_nearest(np.arange(len(v)), v.astype(np.float64), 20)
    assert {i: [g[k] for k in range(1, 21)] for i, g in got.items()} == exact


def test_ties_at_the_last_rank_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i < 15)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.search(rows, ann.F.col("id") == 20).collect()]
    assert sorted(got) == [(i + 1, j) for i, j in enumerate([*range(20)])]
