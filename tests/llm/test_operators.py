"""Corpus operators against brute force, exact round trips and edge cases on small fixtures."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thermocline.llm import (
    decontaminate, language, licenses, mixing, pseudonyms, quality, rans, sharding, simhash, token_files, tokenize, toxicity,
)
from thermocline.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _part int"
TEXTS = [
    "the quick brown fox jumps over the lazy dog " * 9 + "and rests", None, "", "one", "two words", "a  b\n\n c\td ", "e" * 70_000,
    "word " * 30_000, "Grüße aus Köln! 3,5 % ... 42 €", " lead and trail ", "x <|endoftext|> y", "it's we'll don't",
]


def frame(spark, texts, lang="en", source=("a", "b", None)):
    rows = [(k, t, lang, source[k % len(source)], None, 5, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS + ["the quick brown fox jumps over the lazy dog " * 9 + "and rests"] * 3)


def test_every_operator_takes_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert quality.quality_rules(none).count() == 0
    assert mixing.mixed(none).count() == 0
    assert sharding.document_shards(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert token_files.token_table(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert pseudonyms.pseudonymise(none, "k").count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert language.predict_language(none, language.train_tagger(none)).count() == 0
    assert toxicity.score_toxicity(none, toxicity.train_scorer(none, labels)).count() == 0


def test_shards_are_contiguous_even_and_gapless(spark, docs):
    rows = sharding.document_shards(docs, 4).orderBy("doc_id").collect()
    assert [r["size"] for r in rows] == [len((t or "").encode()) + 1 for t in TEXTS + [TEXTS[0]] * 3]
    assert [r["text_crc32"] for r in rows][:3] == [zlib.crc32((t or "").encode()) for t in TEXTS[:3]]
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards)
    for s in set(shards):
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(shards.count(s)))
    even = spark.range(10_000).select((F.col("id") % 3).alias("doc_id"), F.lit(7).alias("size"))  # three keys hold all rows
    counts = [r["count"] for r in sharding.balanced_shards(even, 16).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1


def test_mix_meets_targets_and_agrees_with_itself(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 200, 600)]
    docs = frame(spark, texts, source=("a", "a", "a", "a", "b", None))
    first = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").toPandas()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "copies").toPandas()
    assert dict(zip(first.doc_id, first.copies)) == dict(zip(again.doc_id, again.copies))
    assert first.copies.max() <= 3
    taken = (first["size"] * first.copies).groupby(first.source.fillna("~")).sum()
    target = first.groupby(first.source.fillna("~")).target.first()
    assert ((taken - target).abs() <= 100).all()
    assert abs(target.sum() - first["size"].sum()) < 1e-6 or (target <= 3 * first.groupby(first.source.fillna("~")).source_size.first()).all()
    assert mixing.mixed(docs).columns == docs.columns


def test_weighted_keys_prefer_quality(spark):
    keys = spark.range(20_000).select("id", (F.lit(0.2) + 0.8 * (F.col("id") % 2)).alias("w")).withColumn("k", mixing.sampling_key(F.col("w"), F.col("id")))
    head = keys.orderBy("k").limit(2_000).groupBy("w").count().collect()
    share = {round(r["w"], 1): r["count"] for r in head}
    assert 4.0 < share[1.0] / share[0.2] < 6.2


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 32768, 70_001, 32768 * 65 + 5])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    freq = rans.scaled_frequencies(np.bincount(ids, minlength=1 << 16))
    coder = rans.Coder(freq)
    blocks = coder.encode(ids)
    assert n == 0 or freq.sum() == 1 << rans.SCALE_BITS
    assert np.array_equal(coder.decode(blocks), ids)
    assert len(blocks) < 2 or np.array_equal(coder.decode(blocks[1:2]), ids[rans.BLOCK : 2 * rans.BLOCK])  # a checkpoint
    if n > 1000:
        bits = 8 * sum(len(b[1]) for b in blocks) / n
        p = np.bincount(ids) / n
        p = p[p > 0]
        assert bits < -(p * np.log2(p)).sum() * 1.02 + 64 * 128 * len(blocks) / n + 0.2
        bad = [(blocks[0][0], blocks[0][1][:-1] + bytes([blocks[0][1][-1] ^ 1]), blocks[0][2])]
        with pytest.raises(ValueError):
            coder.decode(bad)


def test_rare_ids_keep_a_frequency():
    freq = rans.scaled_frequencies(np.concatenate([[10**12], np.ones(50_000)]))
    assert freq.sum() == 1 << rans.SCALE_BITS and freq.min() == 1


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenize.vocabulary_path())
    texts = [t or "" for t in TEXTS + [TEXTS[0]] * 3]
    want = [e.ids + [0] for e in whole.encode_batch(texts, add_special_tokens=False)]
    path_rows = token_files.token_table(docs).orderBy("key").collect()
    assert [r["n_tokens"] for r in path_rows] == [len(w) for w in want]
    assert [r["start"] for r in path_rows] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()
    assert [r["ids_crc32"] for r in path_rows] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def test_encoder_equals_the_library_whatever_it_forgets(monkeypatch):
    rng = np.random.default_rng(3)
    units = ["word", "Word,", "end.", "two\nlines", "\u00e9t\u00e9,", "\u6f22\u5b57", "it's", "a1b2", "--", "'s", "x" * 300, "tab\there", "\u01c5\u0531.", "e\u0301,", "don't!", "\u00a0", "<|", "end.\n'm", "\u0967\u0968;", ".", "\n", "\r", "CAPS!!", "\U0001f600?"]
    texts = [" ".join(rng.choice(units, rng.integers(1, 12))) for _ in range(400)] + [None, "", " ", "\n", "a", ".", "\n.", "\u0130x, y", "one\ntwo,\nthree"]
    for known, held in ((1_000_000, 1 << 26), (10, 1 << 26), (1_000_000, 64), (0, 0)):
        monkeypatch.setattr(tokenize, "MOST_KNOWN", known)
        monkeypatch.setattr(tokenize, "MOST_BYTES", held, raising=False)
        encoder = tokenize.Encoder(tokenize.vocabulary_path())
        want = [e.ids for e in encoder.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for at in range(0, len(texts), 7):
            ids, counts = encoder.encode(pa.array(texts[at : at + 7], pa.string()))
            assert counts.tolist() == [len(w) for w in want[at : at + 7]]
            assert ids.tolist() == [i for w in want[at : at + 7] for i in w]


def test_encoder_knows_many_stretches_and_asks_for_none_twice():
    encoder, asked = tokenize.Encoder(tokenize.vocabulary_path()), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            asked.append(piece)
            return self.model.tokenize(piece)

    encoder.model = Counted(encoder.model)
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, row)) for row in rng.integers(97, 123, (200_000, 6))]
    first, _ = encoder.encode(pa.array(["start " + " ".join(words)]))
    asked.clear()
    again, _ = encoder.encode(pa.array(["start " + " ".join(words)]))
    assert again.tolist() == first.tolist() and not asked


def test_texts_are_sliced_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bbbb", "ccccc", "d" * 30, "", "e"])], names=["text"])
    assert [s.num_rows for s in token_files._slices(batch)] == [4, 1, 2]
    assert [s.num_rows for s in token_files._slices(batch.slice(0, 4))] == [3, 1] and not list(token_files._slices(batch.slice(0, 0)))
    assert [r for s in token_files._slices(batch) for r in s.column("text").to_pylist()] == batch.column("text").to_pylist()


def brute_statistics(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(found, found[1:], found[2:]))
    covered = {k + d for k in range(len(found) - 2) if seen[tuple(found[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    texts = TEXTS + ["a b c x a b c", "a a a a", "l\nl\n \n \nm\nl", "p q r p q r p q", "### $ a|b"]
    rows = quality.text_statistics(frame(spark, texts)).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[n] for n in names) for r in rows] == [brute_statistics(t) for t in texts]
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = np.random.default_rng(5)
    plain = [" ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(120)) for _ in range(400)]
    odd = [t.replace(" ", "$$$ ") for t in plain[:30]]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(frame(spark, plain + odd)).select("doc_id", "kept").collect()}
    assert sum(kept[k] for k in range(400)) >= 398 and not any(kept[400 + k] for k in range(30))


def test_robust_shape_equals_numpy_on_its_subset(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 4)) * [1, 2, 3, 4]
    x[:60] += 30
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "_group string, _x1 double, _x2 double, _x3 double, _x4 double")
    shape = quality.group_shapes(rows).first()
    assert np.allclose([shape[f"_m{i}"] for i in range(4)], 0, atol=0.8)  # the shifted rows have no say


def brute_fingerprint(text):
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    s = [b" ".join(found)] if len(found) < 3 else [b" ".join(found[k : k + 3]) for k in range(len(found) - 2)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force(spark, docs):
    texts = TEXTS[:6] + TEXTS[8:] + [TEXTS[0]] * 3
    rows = simhash.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["fingerprint"] for r in rows] == [f"{brute_fingerprint(t):016x}" for t in texts]


def test_no_link_is_lost_in_small_and_crowded_postings(spark, monkeypatch):
    assert simhash._covering(simhash.POSTINGS)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).tolist()
    prints = set(base)
    for b in base[:5]:
        for _ in range(60):
            prints.add(b ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))))
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for most in (64, 2, 10_000):
        monkeypatch.setattr(simhash, "MOST_LISTED", most)
        got = {r["node"]: r["root"] for r in components(simhash.links(table)).collect()}
        assert {p: got.get(p, p) for p in prints} == {p: find(p) for p in prints}


def test_components_of_a_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}


def test_license_places_and_templates(spark):
    texts = [
        "Released under the MIT License.\nMIT license mit LICENSE", "cc by cc by", "lic\nThis work is licensed under the GNU General Public License, version 3.",
        None, "", "the mit of license", "Redistribution and use in source or binary forms, with or without any modification are permitted",
    ]
    rows = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"], rows[0]["score"]) == (3, 3, 7, "mit", 1.0)
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"]) == (2, 0, 2)
    assert rows[2]["labels"] == "gpl,gpl-3.0"
    assert rows[3]["n_words"] == rows[4]["n_words"] == 0 and rows[5]["n_base"] == 0 and rows[5]["labels"] == ""
    for k, text in enumerate(texts):  # the join equals all pairs of lines and templates
        want = set()
        for line in (text or "").split("\n"):
            have = set(re.findall(r"[a-z0-9]+", line.lower()))
            for template, label in licenses.TEMPLATES.items():
                tokens = set(licenses._tokens(template))
                if len(have & tokens) >= licenses.CONTAINMENT * len(tokens):
                    want.add(label)
        base = set(filter(None, rows[k]["base_labels"].split(",")))
        assert set(filter(None, rows[k]["labels"].split(","))) == want | base


def luhn(digits):
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def test_pseudonyms_keep_format_link_and_invert(spark):
    texts = [
        "card 4111111111111111, again 4111111111111111; 4111-1111-1111-1111", "call +1 (212) 555-0199 or 192.168.0.1", "born 1990-02-28, ssn 219-09-9999",
        "invalid 4111111111111112 and 999.1.1.1 and 2020-02-31", None, "", "mail jane.doe7@example.org now",
    ]
    docs = frame(spark, texts)
    hidden = pseudonyms.pseudonymise(docs, "k")
    rows = {r["doc_id"]: r for r in hidden.collect()}
    cards = re.findall(r"[\d-]{16,19}", rows[0]["text"])
    assert cards[0] == cards[1] and cards[2].replace("-", "") == cards[0] != "4111111111111111" and luhn(cards[0]) and rows[0]["n_replaced"] == 3
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or (\d{1,3}\.){3}\d{1,3}", rows[1]["text"])
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, ssn \d{3}-\d\d-\d{4}", rows[2]["text"])
    assert rows[3]["text"] == texts[3] and rows[3]["n_replaced"] == 0
    assert rows[4]["text"] is None and rows[5]["text"] == ""
    assert "jane" not in rows[6]["text"] and rows[6]["text"].endswith("@example.org now")
    back = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(hidden, "k", inverse=True).collect()}
    assert [back[k] for k in range(6)] == texts[:6]


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(250 * 292).select((F.col("id") / 292).cast("long").alias("l"), (F.col("id") % 292).alias("r"))
    moved = pairs.select(pseudonyms.feistel(F.col("l"), F.lit(250), F.col("r"), F.lit(292), "k", "t").alias("s"))
    assert moved.distinct().count() == 250 * 292


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["w%d" % k for k in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, make(int(n)) + ". " + make(9) + ".") for k, n in enumerate(rng.integers(12, 60, 70))]
    texts = [make(400) for _ in range(40)] + [make(int(rng.integers(0, 300))) + " " + items[k][1] + " " + make(150) for k in range(0, 70, 3)] + [None, ""]
    texts.append(make(50) + " " + items[5][1].split(". ")[0] + " " + make(50))  # the question without its answer
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    want = {(d, k) for d, t in enumerate(texts) for k, item in items if plain(item) in plain(t)}
    assert got == want and len(want) == 24


def test_language_is_learned_and_odd_texts_are_unknown(spark):
    rng = np.random.default_rng(2)
    parts = {"xx": ["the", "and", "ing", "tion"], "yy": ["sch", "ein", "ung", "ü"]}
    texts, langs = [], []
    for lang, syllables in parts.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choice(syllables, 3)) for _ in range(40)))
            langs.append(lang)
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    tagger = language.train_tagger(docs)
    odd = docs.union(spark.createDataFrame([(900, None, None), (901, "", None), (902, "12 !", None)], docs.schema))
    rows = {r["doc_id"]: r for r in language.predict_language(odd, tagger).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (900, 901, 902))
    assert np.mean([rows[k]["lang_pred"] == lang for k, lang in enumerate(langs)]) > 0.95


def test_network_gradients_equal_differences():
    scorer = toxicity.WindowScorer({"ab": 1, "cd": 2})
    features = scorer.features(["ab", "cd", "ef"])
    ids = np.array([[0, 1, 2, 3], [2, 2, 0, 1]])
    want = np.array([1.0, 0.0], np.float32)

    def loss():
        tables = [scorer.inputs(w, *features) for w in range(2)]
        z = scorer.forward(ids, tables).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * want + np.log1p(np.exp(z)) * (1 - want)))

    grads = scorer.gradients(ids, want, features, [scorer.inputs(w, *features) for w in range(2)], np.ones(2, np.float32))
    for p, g in zip(scorer.params(), grads):
        flat = p.reshape(-1)
        for k in np.argsort(-np.abs(np.asarray(g).reshape(-1)))[:3]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - np.asarray(g).reshape(-1)[k]) < 2e-3


def test_toxicity_is_learned_from_document_labels(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("aeioustrnlm"), 5)) for _ in range(400)]
    texts, target = [], []
    for k in range(1400):
        w = rng.choice(vocabulary, int(rng.integers(30, 300))).tolist()
        if k % 5 == 0:
            w[int(rng.integers(0, len(w)))] = "vilebad"
        texts.append(" ".join(w))
        target.append(float(k % 5 == 0))
    scorer = toxicity.fit(texts[:1200], np.array(target[:1200], np.float32))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts[1200:] + [None, ""])], "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, scorer).collect()}
    right = np.mean([(rows[k] >= 0.5) == bool(target[1200 + k]) for k in range(200)])
    assert right > 0.9 and 0 <= rows[200] < 0.5 and 0 <= rows[201] < 0.5


def test_windows_cover_every_word():
    windows, owner, words = toxicity._windows(pa.array(["a b", None, " ".join(map(str, range(333)))]))
    assert {words[k] for k in windows[owner == 2].ravel() if k < len(words)} >= set(map(str, range(333)))
