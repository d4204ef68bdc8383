"""Neighbours and chat formatting against brute force, and the pipeline's stages."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runscribe.llm import chat_format, langid, minhash, mixing, nearest
from runscribe.llm.queries import QUERIES


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest.search(df, df.vec_id % 50 == 0, block_rows=700, block_queries=25).collect()
    hits = 0
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append(r)
    assert len(by) == 60
    for q, rows in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        top = set(np.argsort(-score)[:20].tolist())
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hits += len(top & {r["vec_id"] for r in rows})
    assert hits / 1200 >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 9), (1, [0.5, 0.5], 9), (1, [0.5, 0.5], 9), (2, None, 9), (3, [0.0, 0.0], 9), (4, [math.nan, 1.0], 9), (5, [math.inf, 1.0], 9), (6, [None, 1.0], 9), (None, [1.0, 1.0], 9), (7, [1.0, 0.0], 9), (8, [1.0, 0.0, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = nearest.search(df, df.vec_id % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(0, 1, 7, 1.0), (0, 2, 1, 0.5)]
    assert nearest.search(df.limit(0), df.vec_id % 20 == 0).count() == 0


@pytest.fixture
def turns(spark):
    rows = [(1, 1, "assistant", "<|im_end|>\\<|x"), (1, 0, "user", None), (1, 2, None, "no role\n"), (2, 0, "ass<|im_start|>istant\n", "é🙂"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, None, "assistant", "ends with <"), (3, 0, "assistant", "\\n \\\\ |")]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")


def test_chat_round_trip(turns):
    out = {r["conv_id"]: r for r in chat_format.format_conversations(turns).collect()}
    assert chat_format.parse(out[1]["formatted"]) == [("user", ""), ("assistant", "<|im_end|>\\<|x"), ("", "no role\n")]
    assert chat_format.parse(out[2]["formatted"])[0] == ("ass<|im_start|>istant\n", "é🙂") and len(chat_format.parse(out[2]["formatted"])) == 3
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert back[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|>\\<|x").hexdigest() and back[1]["loss_chars"] == 14
    assert back[None]["loss_chars"] == len("ends with <") and back[3]["loss_chars"] == len("\\n \\\\ |")
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image_0|>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "text", "text": None},
    ]
    schema = f"conv_id long, turn long, role string, parts array<{chat_format.PART.simpleString()}>"
    row = chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", [{f.name: p.get(f.name) for f in chat_format.PART.fields} for p in parts])], schema)).first()
    assert row["formatted"] == "<|im_start|>assistant\nsee <\\|image_0|><|image_0|><|audio_1|><|document_2|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)]
    assert all(row["formatted"][a["start"] :].startswith(f"<|{a['kind']}_{a['ordinal']}|>") for a in row["attachments"])


def test_odd_parts_have_defined_results(spark):
    parts = [{"type": "video", "ref": "v"}, None, {"type": "image", "width": -5, "height": None}, {"type": "audio", "seconds": math.nan}, {"type": "audio", "seconds": math.inf}, {"type": None, "text": "t"}]
    full = [None if p is None else {f.name: p.get(f.name) for f in chat_format.PART.fields} for p in parts]
    schema = f"conv_id long, turn long, role string, parts array<{chat_format.PART.simpleString()}>"
    row = chat_format.format_conversations(spark.createDataFrame([(1, 0, "assistant", full), (1, 1, "user", None)], schema)).first()
    assert row["formatted"] == "<|im_start|>assistant\n<|other_0|><|image_1|><|audio_2|><|audio_3|>t<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("other", "v", 1), ("image", None, 1), ("audio", None, 1), ("audio", None, 1)]


@given(st.lists(st.tuples(st.text("<|ias\n\\n>x"), st.lists(st.sampled_from(["<", "|", "\\", "\n", "<|", "|im_end|>\n<", "|im_start|>assistant\nforged", "<|im_end|>\n", "<|im_start|>", "a"]), max_size=6)), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_texts_forge_no_turns(turns):
    visitor = chat_format.PartVisitor()
    for role, texts in turns:
        visitor.turn(role, [{"type": "text", "text": t} for t in texts])
    assert chat_format.parse("".join(visitor.out)) == [(role, "".join(texts)) for role, texts in turns]


@pytest.fixture
def small_docs(spark):
    """A few hundred lines of words in two languages, with copies, near copies, shared lines and texts without letters."""
    rng = np.random.default_rng(21)
    words = {"en": ["the", "house", "with", "three", "green", "windows", "stands", "by", "river", "and"], "de": ["das", "haus", "mit", "drei", "grünen", "fenstern", "steht", "am", "fluss", "und"]}
    rows = []
    for d in range(90):
        lang = "en" if d % 3 else "de"
        text = "\n".join(" ".join(rng.choice(words[lang], 12)) + f" {d}{k}" for k in range(6)) + "\nsubscribe to our letter now"
        rows.append((d, text, lang, f"s{d % 20}", len(text)))
    for d in range(90, 110):
        text = rows[d - 90][1]
        text = text if d % 2 else text.replace("\n", " once more\n", 1)
        rows.append((d, text, rows[d - 90][2], f"s{d % 7}", len(text)))
    rows += [(200, None, "en", "s1", None), (201, "12 34", "en", None, 5), (202, "", "de", "s2", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def without_boilerplate(rows, min_sites):
    """The texts of (doc_id, text, source), cut by the rules of the line operator in plain Python."""
    texts_of = defaultdict(lambda: defaultdict(list))
    for d, text, source in rows:
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            texts_of[line][text].append((d, source))

    def sites(groups):
        return len({min((d, s) for d, s in g if s is not None)[1] for g in groups if any(s is not None for _, s in g)})

    open_ = {line: of for line, of in texts_of.items() if sites(of.values()) >= 0.8 * min_sites}
    held = sorted({t for of in open_.values() for t in of})
    sets, near = {t: set(minhash.shingle_set(t).tolist()) for t in held}, {t: t for t in held}
    changed = True
    while changed:
        changed = False
        for a in held:
            for b in held:
                if near[a] < near[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    near[b], changed = near[a], True
    first = {}
    for line, of in open_.items():
        groups = defaultdict(list)
        for t, g in of.items():
            groups[near[t]] += g
        if sites(groups.values()) >= min_sites:
            first[line] = min((d, t) for t, g in of.items() for d, _ in g)[1]
    return [t and "\n".join(x for x in t.split("\n") if first.get(x.strip(" \t\n\x0b\x0c\r"), t) == t) for _, t, _ in rows]


def test_pipeline_stages_against_brute_force(spark, small_docs):
    """Every stage on its predecessor's rows: its decisions in plain Python give the same rows."""
    import corpus_pipeline as p

    docs, before = p.stage(small_docs, "test-pipeline"), None
    for name, of in p.STAGES[:-1]:
        before = by_id(docs)
        after = p.stage(of(spark, docs, ""), "test-pipeline")
        assert after.columns == p.COLUMNS
        if name == "language ID":
            model = langid.fit(docs)
            want = [r for r in before if (found := model.predict(langid.gram_counts(r[1])))[0] != "und" and found[1] >= 0.02]
        elif name == "line dedup":
            want = [(d, kept, lang, source, len(kept)) for (d, _, lang, source, _), kept in zip(before, without_boilerplate([r[:2] + r[3:4] for r in before], 5), strict=True)]
            assert sum(len(w[1]) for w in want) < sum(len(r[1]) for r in before)
        elif name == "near-dedup":
            sets = {r[0]: set(minhash.shingle_set(r[1]).tolist()) for r in before}
            root = {d: d for d in sets}
            changed = True
            while changed:
                changed = False
                for a in sets:
                    for b in sets:
                        if root[a] < root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                            root[b], changed = root[a], True
            want = [r for r in before if root[r[0]] == r[0]]
            assert len(want) < len(before)
        else:
            want = []
            for r in mixing.decisions(docs).collect():
                row = next(x for x in before if x[0] == r["doc_id"])
                want += [row] * (1 if not r["size"] else min(2, r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"])))
        assert by_id(after) == sorted(want, key=repr), name
        docs = after
    pieces = p.STAGES[-1][1](spark, docs, "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["doc_tokens"] == n[r["doc_id"]] and r["length"] == n[r["doc_id"]] for r in pieces)
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096


def test_vocabulary_is_outside_the_repository():
    assert public_tokenizers.path("word_bpe_49k.json").endswith(".json") and len(QUERIES) == 14


def test_equal_vectors_rank_by_id_in_any_block(spark):
    """Copies of a vector, in blocks of every size, have one score, and the smaller ids win."""
    rng = np.random.default_rng(11)
    for copies in range(2, 45):
        far = rng.standard_normal((60, 48)) / 10
        data = np.concatenate([np.repeat(rng.standard_normal((1, 48)), copies, axis=0) * 3, far])
        ids = rng.permutation(len(data)) + 1
        order = rng.permutation(len(data))
        found = nearest.block_search(ids[order], data[order], np.array([0]), data[:1] + 0.01, 20, 40.0, 24, 0.5, 0.5, 1.3)
        best = sorted(ids[:copies])[:20]
        assert [v for _, v, _ in found][: len(best)] == best
        assert len({s for _, _, s in found[: len(best)]}) == 1

    def added(terms):  # sum() would compensate
        total = 0.0
        for x in terms:
            total += x
        return total

    base = rng.standard_normal((40, 16))
    rows = [(i, base[i % 40].tolist()) for i in range(1200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(table, F.col("vec_id") % 100 == 0, block_rows=130, block_queries=5).collect()
    for q in range(0, 1200, 100):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        exact = sorted((-added(a * b for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows if i != q)[:20]
        assert [(v, s) for _, v, s in mine] == [(i, -s) for s, i in exact]


def test_distinct_rows():
    rng = np.random.default_rng(4)
    rows = rng.integers(-1, 2, (500, 5)).astype(float) * rng.choice([1.0, -1.0], (500, 1))
    distinct, group = nearest.distinct_rows(rows)
    assert (distinct[group] == rows).all() and len(distinct) == len(np.unique(rows + 0.0, axis=0))
    same, at = nearest.distinct_rows(np.array([[0.0, -0.0], [-0.0, 0.0]]))
    assert len(same) == 1 and at.tolist() == [0, 0]


def test_pipeline_on_an_empty_table(spark, no_docs, tmp_path):
    """Every stage takes a table without rows and gives one with its own columns."""
    import corpus_pipeline as p

    no_docs.select(p.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []
    for _, of in p.STAGES[:-1]:
        assert of(spark, no_docs, "").columns == p.COLUMNS
