"""Chosen paths, angular hard negatives and conversation repair against brute force and in edge cases."""

import hashlib
import itertools
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import connect, differences
from thermocline.llm import chosen_path, conversation_repair, hard_negatives

SF = "/root/testdata/sf0.001"
CLASHES = ["node", "row", "at", "c1", "root", "size", "tie", "block", "part", "anchor", "said", "times", "mark", "audit", "_kind", "signature"]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_chosen_path_components", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def with_clashes(df):
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES if c not in df.columns])


# Chosen paths


def brute_components(texts, similarity=0.85, width=5):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def texts_with_groups(rng):
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for g in range(8):
        base = list(rng.choice(words, 60 + 40 * g))
        for c in range(25):  # around the threshold: each changed word takes five shingles
            copy = list(base)
            for spot in rng.choice(len(copy), c % 4 * (1 + g // 3), replace=False):
                copy[spot] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    notice = " ".join(rng.choice(words, 30))
    texts += [notice + " " + " ".join(rng.choice(words, int(rng.integers(10, 200)))) for _ in range(150)]
    texts += ["", None, " \t\n", "one", "ONE ", "one two three four", "One\u000btwo three  four", "one two three four five", "Ä b", "ä b"]
    return texts + texts[:20] + ["long " + "word " * 30_000] * 2


def test_chosen_paths_equal_brute_force(spark, monkeypatch):
    texts = texts_with_groups(np.random.default_rng(4))
    docs = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    roots, sizes = brute_components(texts)
    # First as in production; then nodes branch on; then they are cut into pieces at once, with few or many classes outside the largest component.
    for few, small, tiny, levels in ((64, 4096, 32, 8), (2, 40, 8, 8), (2, 10, 4, 1), (300, 10, 4, 1)):
        for name, value in (("FEW", few), ("SMALL", small), ("TINY", tiny), ("MOST_LEVELS", levels)):
            monkeypatch.setattr(chosen_path, name, value)
        rows = chosen_path.similar_components(docs).orderBy("doc_id").collect()
        assert [r["n_shingles"] for r in rows] == sizes
        assert [r["component_id"] for r in rows] == roots
        assert [r["kept"] for r in rows] == [k == r for k, r in enumerate(roots)]


def test_chosen_paths_edges(spark):
    schema = "doc_id long, text string"
    assert chosen_path.similar_components(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in chosen_path.similar_components(spark.createDataFrame([(1, None), (None, "")], schema)).orderBy("doc_id").collect()] == [
        (None, 0, None, True), (1, 0, 1, True)]
    same = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "alone here")], schema)
    rows = sorted(chosen_path.similar_components(same).collect(), key=str)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [
        ("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_next_level_moves_the_tokens_of_large_nodes_only(spark, monkeypatch):
    """The join that fetches tokens is given little more than the classes that branch on, however many others there are."""
    for name, value in (("FEW", 2), ("SMALL", 20), ("TINY", 8), ("MOST_LEVELS", 2)):
        monkeypatch.setattr(chosen_path, name, value)
    kind, joined = type(spark.range(0)), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        if isinstance(on, str) and on == "node" and "tokens" in other.columns:
            joined.append((self.select("node").distinct().count(), other.select("node").count()))
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]
    notice = " ".join(rng.choice(words, 150))
    texts = [notice + " " + " ".join(rng.choice(words, 20)) for _ in range(40)] + [" ".join(rng.choice(words, 30)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = chosen_path.similar_components(docs).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == brute_components(texts)[0]
    assert joined and all(wanted <= moved <= wanted + 30 for wanted, moved in joined)


def test_trees_reach_the_recall():
    rng, trees = np.random.default_rng(1), chosen_path._trees(0.85, 0.9999)
    assert 5 <= trees <= 12
    import pyarrow as pa

    pairs = 400
    mine = rng.integers(0, 1 << 32, (pairs, chosen_path.COORDINATES), dtype=np.uint32)
    other = np.where(rng.random(mine.shape) < 0.85, mine, rng.integers(0, 1 << 32, mine.shape, dtype=np.uint32))
    missed = 0
    for tokens in zip(mine, other):
        met = False
        for tree in range(trees):
            at = {np.int64(7919 * tree + 1)}
            for _ in range(chosen_path.RECALL_LEVEL):
                below = []
                for row in tokens:
                    batch = pa.RecordBatch.from_pydict({
                        "at": pa.array(sorted(at), pa.int64()), "node": pa.array([0] * len(at), pa.int64()), "n": pa.array([1] * len(at), pa.int32()),
                        "low": pa.array([0] * len(at), pa.int64()), "high": pa.array([0] * len(at), pa.int64()), "tokens": pa.array([row.tobytes()] * len(at)),
                    })
                    below.append({k for b in chosen_path._children(0.85)(iter([batch])) for k in b.column("at").to_pylist()})
                at = below[0] & below[1]
                if not at:
                    break
            if at:
                met = True
                break
        missed += not met
    assert missed <= 1


# Hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    valid = []
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        valid.append((k, (label + 1) % 10 if k % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    found = []
    for k, label, v in valid:
        if k % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in valid if j != k)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(s, j) for s, j, m in scored if m != label and 50 * -score <= 100 * -s <= 95 * -score]
            found += [(k, p, r, j, -score, -s) for r, (s, j) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def vectors(rng, n, width=16):
    centres = rng.normal(size=(7, width))
    held = centres[rng.integers(0, 7, n)] + rng.normal(size=(n, width)) * rng.choice([0.05, 0.5, 2.0], (n, 1))
    held[::11] = held[3]
    held[::37] = 0.0
    return [(k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4)) if k % 3 else 1) for k, v in enumerate(held)]


@pytest.mark.parametrize("block,part,count", [(4096, 4096, 12), (64, 3, 5), (100, 100, 0)])
def test_hard_negatives_equal_brute_force(spark, block, part, count):
    rows = vectors(np.random.default_rng(block), 700)
    rows += [(5000, None, 1), (5050, [1.0] * 16, None), (5100, [float("nan")] * 16, 1), (5150, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    rows += [(6000, [0.5] * 9, 2), (6001, [], 2), (6050, [1e6] * 16, 2), (6051, [float("inf")] * 16, 2), (-50, [0.3] * 16, 3)]
    table = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    found = hard_negatives.hard_negatives(hard_negatives.prepared(table), F.col("vec_id") % 50 == 0, block=block, part=part, count=count)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows)


def test_hard_negatives_of_repeated_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = hard_negatives.prepared(spark.createDataFrame([], schema))
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (3, [0.8, 0.0], 3)]
    found = hard_negatives.hard_negatives(hard_negatives.prepared(spark.createDataFrame(rows, schema)), F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in found.collect())
    assert [(r[1], r[2], r[3]) for r in got] == sorted([(1, 1, 2), (1, 2, 3)] * 4)


def test_bounds_hold_and_leave_rows_out():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    data = np.floor(256 * (centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 32)))).astype(np.int64)
    data[0] = 0
    units = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_pydict({
        "vec_id": pa.array(range(600), pa.int64()), "label": pa.array([0] * 600, pa.int64()), "vector": pa.array(data.tolist()), "tie": pa.array(range(600), pa.int64()),
    })
    placed = pa.Table.from_batches(list(hard_negatives._placed(units)(iter([batch]))))
    side = hard_negatives._Side(placed, 32, 12)
    least, most = hard_negatives._bounds(side, slice(0, 600), side)
    scores = data @ data.T
    assert (least <= scores).all() and (scores <= most).all()
    assert (most < np.sort(scores, axis=1)[:, -6:-5]).mean() > 0.5


# Conversations


def brute_audit(rows):
    """Cheapest edits by search over all edit strings, cheapest first, then ASCII-least. ``rows``: initial, must go, truncated."""
    import heapq

    moves = conversation_repair.MOVES
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        for (s, initial), to in moves.items():
            if s == state and initial in "ua":
                heapq.heappush(queue, (cost + 3, audit + "I", at, to))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state))
            if not gone:
                if (state, initial) in moves:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", at + 1, moves[state, initial]))
                for (s, other), to in moves.items():
                    if s == state and other in "ua":
                        heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", at + 1, to))


def brute_repairs(rows):
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        word = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = ("user" if fate == 4 else word(role)), ("" if fate == 1 else word(text))
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        kept[conv] += [(turn is not None, turn or 0, role, hashlib.md5(f"{role}\0{text}".encode()).hexdigest(), text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    found = {}
    for conv, damaged in kept.items():
        damaged.sort()
        seen, letters, faults = set(), [], [0, 0, 0]
        for _, _, role, _, text in damaged:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            letters.append((role[:1], fault in (0, 1), fault == 2))
        initials = [r[2][:1] for r in damaged]
        turns = {r[1] for r in damaged if r[0]}
        cost, audit = brute_audit(letters)
        out, state, queue = [], 0, iter(damaged)
        for edit in audit:
            row = next(queue) if edit != "I" else None
            if edit == "D":
                continue
            initial = row[2][:1] if edit == "K" else "a" if state == 2 else "u"
            role = row[2] if edit == "K" else conversation_repair.NAMES[initial]
            out.append(f"{role}:{row[4] if row else ''}")
            state = conversation_repair.MOVES[state, initial]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )
    return found


def test_repairs_equal_search(spark):
    rng = np.random.default_rng(6)
    roles = ["user", "assistant", "system", "tool", "umpire", "", None]
    texts = ["Fine.", "cut off", "", " \t", None, "Yes!", "no?  \n", "Fine.", "Grüße…", "a\u00a0"]
    rows = [
        (int(c), None if rng.random() < 0.05 else int(rng.integers(0, 9)), roles[rng.choice(7, p=[.35, .3, .15, .05, .05, .05, .05])], texts[rng.integers(0, 10)])
        for c in range(250) for _ in range(int(rng.integers(1, 9)))
    ]
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(9)] + rows[:40]
    rows += [(900, None, "user", None)] * 3 + [(901, t, "system", "Same text.") for t in range(300)] + [(902, -(2**63), "user", "x"), (902, 2**63 - 1, "user", "y")]
    table = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    want = brute_repairs(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair_damaged(table).collect()}
    assert set(got) == set(want)
    for conv, mine in want.items():
        assert got[conv] == (min(mine[0], 2**63 - 1), *mine[1:]), conv


def test_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair_damaged(spark.createDataFrame([], schema)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = conversation_repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_automaton_is_minimal_and_bounded():
    automaton, letters = conversation_repair.Automaton(), "xsuaoSUAO"
    seen, queue = {0}, [0]
    while queue:
        node = queue.pop()
        for letter in letters:
            after = automaton.before(letter, node)
            if after not in seen:
                seen.add(after)
                queue.append(after)
    assert len(seen) < 3000
    keys = {(automaton.base[k], automaton.costs[k], automaton.ranks[k], automaton.edits[k]) for k in seen}
    assert len(keys) == len(seen)
