"""Cases that operators once left out: each does the whole job."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from thermocline.llm import decontaminate, language, licenses, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "a") for k, t in rows], SCHEMA).repartition(3)


def prose(rng, n, size=400):
    return [f"w{k}" for k in rng.integers(0, size, n)]


def test_pipeline_keeps_one_row_of_each_group(spark):
    base = "one two three four five six seven eight nine ten " * 6
    rows = [(7, base), (7, "quite another text of its own with words"), (3, base.upper()), (None, base), (None, None), (9, ""), (4, "\t\n"), (3, base)]
    docs = frame(spark, rows)
    left = corpus_pipeline.dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    kept = left.collect()
    assert sorted((r["doc_id"], (r["text"] or "").lower()) for r in kept) == [(3, base), (4, "\t\n"), (7, rows[1][1])]
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), "").count() == 0
    clash = corpus_pipeline.dedup_stage(spark, docs.withColumn("row", docs["doc_id"]).withColumn("ROW_", docs["text"]), "")
    assert clash.count() == 3 and clash.columns[-2:] == ["row", "ROW_"]


def test_long_and_foreign_items_are_found(spark):
    rng = np.random.default_rng(9)
    weights = 1.0 / np.arange(1, 20_001)
    words = np.array([f"w{k}" for k in range(20_000)])
    draw = lambda n: " ".join(rng.choice(words, n, p=weights / weights.sum()))
    items = [(k, draw(n)) for k, n in enumerate([300] * 12 + [500] * 12 + [65, 90, 30])]
    items += [(100, "ΤΟ ΝΗΣΙ ΤΟΥ ΟΔΥΣΣΕΑ ΕΙΝΑΙ Ο ΤΟΠΟΣ ΤΩΝ ΑΝΕΜΩΝ ΚΑΙ ΤΗΣ ΘΑΛΑΣΣΑΣ"), (101, "İSTANBUL BÜYÜK BİR ŞEHİRDİR VE İKİ KITAYI BİRLEŞTİRİR DENİZ İLE")]
    docs = [(k, f"{draw(int(rng.integers(0, 200)))} {text} {draw(150)}") for k, text in items] + [(500 + k, draw(600)) for k in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, docs), benchmark).collect()}
    assert found == {(k, k) for k, _ in items}
    twice = decontaminate.contaminated(frame(spark, docs[:2] * 2), benchmark).collect()
    assert sorted(r["doc_id"] for r in twice) == [0, 0, 1, 1]


def test_pipeline_drops_leaks_without_an_id(spark, tmp_path):
    rng = np.random.default_rng(2)
    item = " ".join(prose(rng, 30)) + ". " + " ".join(prose(rng, 9)) + "."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    other = [" ".join(prose(rng, 200)) for _ in range(4)]
    docs = frame(spark, [(None, other[0] + " " + item), (5, other[1] + " " + item), (None, other[2]), (7, other[3]), (None, None)])
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(r["text"] or "" for r in left.collect()) == sorted(["", other[2], other[3]])


def test_junk_of_two_fifths_goes_and_ordinary_texts_stay(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(120)) for _ in range(300)]
    odd = [t.replace(" ", "$$$ ", int(rng.integers(20, 119))) for t in plain[:200]]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, enumerate(plain + odd))).select("doc_id", "kept").collect()}
    assert sum(kept[k] for k in range(300)) >= 298 and not any(kept[300 + k] for k in range(200))


def test_all_of_a_long_word_is_scored():
    glued = "x" * 60
    windows, owner, words = toxicity._windows(pa.array([glued + "vilebad", "a b", None, glued], pa.large_string()))
    read = ["".join(words[k] for k in windows[n] if k < len(words)) for n in range(len(windows))]
    assert read == [glued + "vilebad", "ab", "", glued] and max(map(len, words)) <= toxicity.PIECE
    han = "".join(chr(0x4E00 + k) for k in range(9000))
    windows, owner, words = toxicity._windows(pa.array([han], pa.large_string()))
    assert {c for k in windows.ravel() if k < len(words) for c in words[k]} == set(han)


def test_copies_do_not_fill_the_training_samples(spark, monkeypatch):
    # One text in 200 copies, sorting before all others of its language, and one rare language.
    candidates = frame(spark, [(k, f"abc text number {k}") for k in range(60)]).select("text", F.xxhash64("text").alias("h")).orderBy("h").collect()
    first, others = candidates[0]["text"], [r["text"] for r in candidates[1:]]
    rows = [(k, first, "xx", 0) for k in range(200)] + [(200 + k, t, "xx", k % 2) for k, t in enumerate(others)] + [(900, others[-1] + "\u00fc", "yy", 1)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, target, seed: seen.append(list(zip(texts, target.tolist()))))
    toxicity.train_scorer(docs, labels, sample=10)
    assert len(seen[0]) == len(set(seen[0])) == 20 and sum(t for _, t in seen[0]) == 10
    monkeypatch.setattr(language.ByteTagger, "train", lambda self, ids, targets: seen.append(np.bincount(targets).tolist()))
    assert language.train_tagger(docs, sample=20).labels == ["xx", "yy"]
    assert seen[1][0] >= 10 and seen[1][1] >= 1


def test_numbers_are_no_letters(spark):
    docs = frame(spark, [(k, f"abc text number {k}") for k in range(30)])
    tagger = language.train_tagger(docs, sample=20)
    asked = frame(spark, [(0, "½ ¾"), (1, "①②③"), (2, "12 _ 3"), (3, "½a"), (4, "中"), (5, "ʰ")])
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(asked, tagger).collect()}
    assert found == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en", 5: "en"}


def test_samples_are_the_least_hashes(spark, monkeypatch):
    docs = frame(spark, [(k, f"text number {k} of many") for k in range(400)])
    seen = []
    monkeypatch.setattr(language.ByteTagger, "train", lambda self, ids, targets: seen.append({bytes(r[r < 256].astype("u1").tolist()) for r in ids}))
    language.train_tagger(docs, sample=7)
    least = [r["text"].encode() for r in docs.orderBy(F.xxhash64("text")).limit(7).collect()]
    assert len(seen[0]) == 7 and all(any(t.startswith(s) or s in t for t in least) for s in seen[0])


def test_notices_are_found_over_line_breaks(spark):
    rng = np.random.default_rng(4)
    notices = list(licenses.TEMPLATES)
    wrapped = [" ".join(prose(rng, 40 + k)) + "\n * " + "\n * ".join(" ".join(t.split()[i : i + 3]) for i in range(0, 20, 3)) + " " + " ".join(prose(rng, 90)) for k, t in enumerate(notices)]
    apart = [w for t in notices for w in licenses._words(t)]
    scattered = [" ".join(sum(([w, *prose(rng, 9)] for w in licenses._words(t)), [])) for t in notices]
    mixed = [" ".join(rng.choice(apart + prose(rng, 20), 150)) for _ in range(60)] + [" ".join(rng.choice(apart, n)) for n in (1, 3, 17, 33, 34, 35, 67, 68, 69, 102, 103, 700)]
    texts = wrapped + scattered + mixed + ["", None, "\n\n"]
    rows = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, list(enumerate(texts)))).collect()}
    for k, label in enumerate(licenses.TEMPLATES.values()):
        assert label in rows[k]["labels"].split(",") and rows[k]["score"] == 1.0
        assert rows[k + len(notices)]["score"] == 0.0
    for k, text in enumerate(texts):  # the join equals all pairs of blocks and templates
        words, best = re.findall(r"[a-z0-9]+", (text or "").lower()), {}
        for template, label in licenses.TEMPLATES.items():
            tokens, run = set(licenses._tokens(template)), 2 * len(licenses._words(template))
            share = max((len(tokens & set(words[i : i + run])) / len(tokens) for i in range(len(words))), default=0.0)
            if share >= licenses.CONTAINMENT:
                best[label] = max(share, best.get(label, 0.0))
        base = set(filter(None, rows[k]["base_labels"].split(",")))
        assert set(filter(None, rows[k]["labels"].split(","))) == set(best) | base
        assert rows[k]["score"] == (1.0 if base else max(best.values(), default=0.0))
