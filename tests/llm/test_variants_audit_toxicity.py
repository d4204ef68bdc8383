"""Spelling variants, the filter audit and toxicity against brute force, on odd rows and on whole tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from runscribe.llm import filter_audit, spelling, toxicity


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


@pytest.fixture(scope="module")
def variant_rows():
    rng = random.Random(3)
    crowd = ["segment" + "".join(rng.choice("abcé") for _ in range(rng.choice((3, 4, 4, 5)))) for _ in range(300)]
    crowd += ["".join(rng.choice("abÉx") for _ in range(rng.choice((3, 4)))) + "ending" for _ in range(200)]
    chain = ["letter"] * 900 + ["lettor"] * 150 + ["lattor"] * 26 + ["lattorr"] * 5
    rows = [(i, " ".join(rng.choice(crowd) for _ in range(60)) + ", ".join(rng.sample(chain, 9))) for i in range(120)]
    return rows + [(7, None), (None, "Segment " * 30), (9, ""), (1000, "frequently " * 9000 + "x" * 5000), *[(2000 + i, "frequently Éclairs×") for i in range(3000)], (9, "LETTER1letter " * 40)]


def test_variants_equal_brute_force(spark, variant_rows):
    docs = spark.createDataFrame(variant_rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "root": F.lit(3)})
    got = [tuple(r) for r in spelling.variant_groups(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_variants(variant_rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of two forms


def test_crowded_segments_lose_no_pair(spark):
    rng = random.Random(8)
    words = sorted({"common" + "".join(rng.choice("ab") for _ in range(rng.randrange(4, 8))) for _ in range(400)} | {"".join(rng.choice("ab") for _ in range(rng.randrange(4, 8))) + "common" for _ in range(400)} | {"a", "b", "ab", "é"})
    pairs = [tuple(sorted(r)) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == want


def test_variants_of_odd_and_no_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert {tuple(r) for r in spelling.variant_groups(odd_docs).collect()} == brute_variants(rows)
    assert spelling.variant_groups(no_docs).collect() == []


def brute_audit(docs, labels):
    marks = defaultdict(set)
    for doc_id, quality, toxic in labels:
        marks[doc_id] |= {("good", quality == 1), ("toxic", toxic == 1)}
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id,
        }
        m = marks[doc_id] if doc_id is not None else set()
        rows.append((source or "", {k for k, v in fails.items() if v}, ("good", True) in m, ("toxic", True) in m))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_brute_force(spark, odd_docs, no_docs):
    labels = [(0, 1, 0), (0, 0, 1), (1, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (8, 1, 1), (12, 0, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [(20, "A# B", None, "", 0, 0, 0, 0.0), (21, "w" + " w" * 300, None, "a", 0, 0, 0, 0.0), (22, " ".join(map(str, range(250))), None, "z", 0, 0, 0, 0.0)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema)).withColumns({"part": F.lit("x"), "label": F.lit(9), "quality": F.lit(1), "first": F.lit(1)})
    got = [tuple(r) for r in filter_audit.audit(docs, marks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert filter_audit.audit(no_docs, marks).collect() == []
    assert len(filter_audit.audit(docs, marks.limit(0)).collect()) == len(got)


def test_audit_of_many_parts_hands_sums_on(spark, monkeypatch):
    rows = [(i, "text " * (i % 7), f"p{i % 90}") for i in range(400)]
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, i % 2, i % 3) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in filter_audit.audit(docs, marks).collect()} == brute_audit(rows, [tuple(r) for r in marks.collect()])


def test_first_failure_table():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for failed in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            at = [s for s, f in enumerate(order) if failed >> "ABCDE".index(f) & 1]
            assert table[failed, o] == (at[0] if at else 5)


def brute_kind(words):
    """The kind of a clause by looking back from each match."""
    hits, targeted = [], any(w in toxicity.TARGETS for w in words)
    symbol = lambda w: toxicity.SYMBOL.get(w, toxicity.OTHER)
    for i, w in enumerate(words):
        if symbol(w) in (toxicity.INSULT, toxicity.THREAT):
            room, negated = toxicity.NEGATION_SCOPE, 0
            for v in reversed(words[:i]):
                if symbol(v) == toxicity.NEGATOR and room > 0:
                    negated = 1
                if symbol(v) in (toxicity.NEGATOR, toxicity.BREAK):
                    break
                room -= symbol(v) not in (toxicity.INSULT, toxicity.THREAT)
            reported = int(any(symbol(v) == toxicity.REPORTER for v in words[:i]))
            hits.append((int(symbol(w) == toxicity.THREAT), negated, reported))
    if not hits:
        return None
    return toxicity.KINDS.index((*min(hits, key=lambda h: (h[1], h[2], h[0])), int(targeted)))


def test_grammar_equals_looking_back():
    rng = random.Random(2)
    some = ["you", "they", "not", "never", "said", "called", ",", "idiot", "moron", "kill", "house", "green", "walks", "the"]
    for _ in range(5000):
        words = [rng.choice(some) for _ in range(rng.randrange(12))]
        assert toxicity.clause_kind(words) == brute_kind(words), words


def test_matches_cut_clauses():
    rng = random.Random(4)
    some = ["you", "not", "said", "idiot", "IDIOT", "idiots", "idiotx", "kill", "house", ".", "!", "\n", ",", "stupid$$$", "é", "don’t", "no1"]
    for _ in range(2000):
        text = " ".join(rng.choice(some) for _ in range(rng.randrange(25)))
        want = set()
        for clause in re.split(r"[.!?;:\n]", text.lower().replace("’", "'")):
            words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|,", clause)
            kind = brute_kind(words)
            want |= {kind * len(toxicity.ENTRIES) + toxicity.ENTRY_AT[w] for w in words if kind is not None and w in toxicity.ENTRY_AT}
        assert toxicity.matches(text) == sorted(want), text
    assert toxicity.matches(None) == toxicity.matches("") == []
    assert len(toxicity.matches("you are an idiot " * 50_000)) == 1  # one clause of a very long text


def test_weights_follow_labels():
    idiot, fool = toxicity.ENTRY_AT["idiot"], toxicity.ENTRY_AT["fool"]
    w = toxicity.learned([(idiot, 200, 190), (fool, 200, 10)], (1000, 50))
    p = lambda e: 1 / (1 + 2.718281828 ** -(w.kinds[0] + w.entries[e]))
    assert p(idiot) > 0.9 and p(fool) < 0.1 and abs(w.without - 0.05) < 0.01
    start = toxicity.learned([], (0, 0))
    assert start.kinds[toxicity.KINDS.index((0, 0, 0, 1))] > start.kinds[toxicity.KINDS.index((0, 1, 0, 1))]


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, None), (1, 1), (None, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    more = spark.createDataFrame([(50, "You are a stupid idiot!", None, None, 0, 0, 0, 0.0)], odd_docs.schema)
    rows = toxicity.score(odd_docs.union(more).withColumn("found", F.lit(1)), labels).collect()
    assert len(rows) == odd_docs.count() + 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[50]["predicted"] == 1 and by[3]["predicted"] == by[4]["predicted"] == 0
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert toxicity.score(no_docs, labels).collect() == []


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in caught) >= 0.9 * len(caught)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    held = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, held).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)  # held-out labels change nothing


def test_labels_add_words(spark):
    """Made-up insults are learned from labels; words of copies of a toxic text, of clean texts and of held-out rows are not."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(n))
    common = [word(2) for _ in range(400)]
    insults, late = ["vequta", "loweiß", "chllañ", "qu'oziko"], "zamurato"
    copied = [word(5) for _ in range(60)]
    docs, labels = [], []
    for i in range(4000):
        words, toxic = [rng.choice(common) for _ in range(60)], i % 10 == 0
        if toxic:
            words[rng.randrange(2, 60)] = rng.choice(insults).capitalize() + "!"
        if i % 400 == 5:
            words, toxic = list(copied), True  # ten copies of one toxic text, each with a word changed
            words[i // 400 * 5] = rng.choice(common)
        if toxic and zlib.crc32(str(i).encode()) % 4 == 2:
            words[1] = late
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000 + i, f"mora bela {w} tiru.") for i, w in enumerate([*insults, *copied, late])]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.added_words(tables[0], toxicity.marked(tables[1])) == tuple(sorted(insults))
    got = {r["doc_id"]: r for r in toxicity.score(*tables).collect()}
    copies = {i for i in range(4000) if i % 400 == 5}
    assert all(got[i]["predicted"] == toxic for i, toxic in labels if i not in copies)
    assert [got[5000 + i]["predicted"] for i in range(len(insults))] == [1] * len(insults)
    assert not any(got[5000 + i]["predicted"] for i in range(len(insults), len(insults) + len(copied) + 1))
    assert len(got) == len(docs)


@pytest.mark.parametrize("held", [1, 300_000])
def test_evidence_equals_counts(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD_ROWS", held)
    docs = [(1, "Bad, good day"), (1, None), (3, "bad good night"), (4, "A bad good bad worse"), (8, "bad day day"), (9, ""), (12, "night bad"), (None, "bad")]
    marks = [(1, 1), (3, 1), (4, 1), (8, 0), (9, 1), (12, 0), (99, 1)]
    assert not any(zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in marks)
    rows = toxicity.evidence(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic long")).collect()
    got = {r["word"]: (r["sites"], r["clean"]) for r in rows}
    first = toxicity.neighbours("a bad good bad worse")["bad"]
    behind = {toxicity.neighbours(t)["bad"][1] for t in ("bad good day", "bad good night")} | {first[1]}
    before = {0, first[0]}
    assert got == {"bad": (min(len(before), len(behind)), 2), "good": (min(1, 3), 0), "day": (1, 1), "night": (1, 1), "a": (1, 0), "worse": (1, 0)}


def test_held_out_toxicity_of_all_languages(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.05 * len(clean)


def test_weights_of_many_entries_by_elimination():
    """The eliminated system's weights are a minimum: the loss's slope vanishes."""
    import numpy as np

    rng, entries, k = np.random.default_rng(1), 50, len(toxicity.KINDS)
    examples = [(int(a), int(n), int(rng.integers(0, n + 1))) for a, n in zip(rng.choice(k * entries, 200, replace=False), rng.integers(1, 90, 200), strict=True)]
    w, start = toxicity.learned(examples, (10, 1), entries), toxicity.Weights(entries=np.zeros(entries))
    slope = np.r_[w.kinds - start.kinds, w.entries - start.entries]
    for a, n, toxic in examples:
        off = n / (1 + np.exp(-(w.kinds[a // entries] + w.entries[a % entries]))) - toxic
        slope[a // entries] += off
        slope[k + a % entries] += off
    assert np.abs(slope).max() < 1e-6
