"""The pipeline's stages against brute force on a small corpus."""

import random

import corpus_pipeline
from skerry.llm import secrets
from tests.llm.test_operators import SCHEMA, brute_components, brute_overlap, prose


def test_stages(spark, tmp_path):
    r = random.Random(2)
    item = prose(r, 30)
    base = prose(r, 100)
    rows = [(i, prose(r, 80), "en", "s", 0) for i in range(30)]
    rows += [(40, base, "en", "s", 0), (41, base, "en", "s", 0), (42, base + " end", "en", "s", 0), (43, None, "en", "s", 0), (44, "12 3", "en", "s", 0), (45, prose(r, 50) + " " + item, "en", "s", 0)]
    rows += [(46, 'token = "661f4d643109ac1c4160a4d55d1f1f508f3175a1" ' + prose(r, 40), "en", "s", 0), (40, base, "en", "s", 0)]
    rows += [(47, prose(r, 600) + " " + " ".join(item.split()[5:20]) + " " + prose(r, 600), None, "s", 0), (48, prose(r, 600) + " " + " ".join(item.split()[5:17]) + " " + prose(r, 600), None, "s", 0)]
    d = f"{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    langs = [x["doc_id"] for x in seen["language_id"]]
    assert sorted(langs) == sorted(x[0] for x in rows if x[0] not in (43, 44))
    comp = brute_components([(x["doc_id"], x["text"]) for x in seen["language_id"]])
    kept = sorted(x["doc_id"] for x in seen["ngram_jaccard_join"])
    assert kept == sorted(i for i, (_, c) in comp.items() if i == c)
    bad = {i for i, v in brute_overlap([(x["doc_id"], x["text"]) for x in seen["ngram_jaccard_join"]], [(1, item)]).items() if v[4]}
    # 15 consecutive words of an item in a long text are enough, 12 are not
    assert bad == {45} and sorted(x["doc_id"] for x in seen["decontamination"]) == [i for i in kept if i not in (45, 47)] and 48 in kept
    assert {x["lang"] for x in seen["language_id"]} == {"en"}
    masked = {x["doc_id"]: x["text"] for x in seen["secret_scan"]}
    assert masked[46].startswith(f'token = "{secrets.MASK}" ') and all(masked[x["doc_id"]] == x["text"] for x in seen["decontamination"] if x["doc_id"] != 46)
    assert {x["doc_id"] for x in seen["packing"]} == set(masked)
    ran = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, ran.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((x["doc_id"], x["start"], x["length"], x["ids_crc32"]) for x in seen["packing"])


def brute_near(texts):
    """For each text the least place that links of similarity 0.8 over five-word shingles reach."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    return root


def test_near_duplicates_from_eight_tenths(spark):
    r = random.Random(6)
    texts = [prose(r, 60) for _ in range(5)]
    for k, t in enumerate(list(texts)):
        w = t.split()
        texts += [t + " " + prose(r, 4 + 3 * k), " ".join(w[2 + 2 * k :]), " ".join([*w[:30], "edit", *w[31:]]), " ".join([*w[:9], "e", *w[10:40], "f", *w[41:]])]
    texts += ["a b c d", "a b c d", "a b c e"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    want = [i for i, x in enumerate(brute_near(texts)) if i == x]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want and len(want) < len(texts) - 12


def test_near_duplicates_keep_all_that_is_no_copy(spark):
    r = random.Random(8)
    base, twin, *clean = (prose(r, 60) for _ in range(7))
    keep = [(3, base), (7, clean[0]), (7, clean[1]), (None, clean[2]), (9, clean[3]), (None, twin), (None, None), (None, None), (4, "")]
    go = [(7, base), (8, base + " end"), (None, base), (9, clean[3]), (None, twin), (None, twin + " end"), (None, " ".join(twin.split()[1:]))]
    docs = spark.createDataFrame([(i, t, None if t == clean[2] else "en", "s", None) for i, t in keep + go], SCHEMA)
    got = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    of_twin = [x for x in got if x[1] and set(x[1].split()) & set(twin.split()) and len(set(x[1].split()) & set(twin.split())) > 40]
    assert len(of_twin) == 1
    same = lambda rows: sorted((x for x in rows if x not in of_twin and x[1] != twin), key=str)
    assert same(got) == same(keep)


def test_stages_on_nothing_and_on_odd_rows(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, and columns that bear the operators' own names."""
    r = random.Random(3)
    d = f"{tmp_path}"
    spark.createDataFrame([(1, prose(r, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    odd = spark.createDataFrame([(None, prose(r, 30), None, None, None), (None, prose(r, 30), None, None, None), (5, prose(r, 30), "en", "s", 1), (5, prose(r, 30), "en", "s", 1), (6, None, None, None, None)], SCHEMA)
    odd = odd.withColumns({c: odd["text"] for c in ("fp", "root", "score", "lang_pred", "n_words", "component_id")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), d).count() == 0, name
        got = stage(spark, odd, d)
        if name != "packing":
            assert got.columns == corpus_pipeline.COLUMNS
        assert got.count() == (4 if name == "language_id" else 5), name
