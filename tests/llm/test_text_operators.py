"""Operators on documents against brute force, over a table of odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runscribe.llm import imatch, langid, line_dedup, minhash, mixing, packing, substring_dedup, token_counts
from runscribe.llm.fm_index import FMIndex, long_matches, suffix_array
from runscribe.llm.minhash import shingle_set
from runscribe.llm.token_arrays import ChunkTokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_mixing_matches_hash_order(odd_docs):
    out = mixing.decisions(odd_docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in out)
    weights = dict(zip(sorted((s for s in by), key=lambda s: (s is None, s)), [3, 1, 2, 3, 1], strict=False))
    caps = {s: 2 * sum(r["size"] for r in rows) for s, rows in by.items()}
    targets, left, open_ = {}, 1.5 * total, dict(weights)
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > caps[s]]
        if not over:
            break
        for s in over:
            targets[s] = caps[s]
            left -= caps[s]
            del open_[s]
    targets |= {s: w * level for s, w in open_.items()}
    for s, rows in by.items():
        size = sum(r["size"] for r in rows)
        assert all(abs(r["target"] - targets[s]) < 1e-6 and r["source_size"] == size for r in rows)
        whole = min(2, int(targets[s] // size)) if size else 0
        rest, at = targets[s] - whole * size, 0
        for h in sorted({r["h"] for r in rows}):
            group = [r for r in rows if r["h"] == h]
            at += sum(r["size"] for r in group)
            before = at - sum(r["size"] for r in group)
            part = int((rest - before) // len(group)) if before <= rest < at else 0
            assert all(r["taken"] == r["size"] * min(2, whole + (at <= rest)) + part for r in group)
        assert abs(sum(r["taken"] for r in rows) - targets[s]) < 1 + max(Counter(r["h"] for r in rows).values())


def test_mixing_of_nothing_and_reruns(no_docs, odd_docs):
    assert mixing.mix(no_docs).count() == 0
    assert sorted(map(tuple, mixing.mix(odd_docs).collect()), key=repr) == sorted(map(tuple, mixing.mix(odd_docs.repartition(3)).collect()), key=repr)
    clashing = odd_docs.toDF("doc_id", "text", "lang", "source", "times", "size", "h", "time")
    assert mixing.mixed_documents(clashing).columns == clashing.columns


def test_mixed_documents_follow_the_decisions(odd_docs):
    """Each row as often as its words are taken, the boundary document once more from half of it on; a row without words once."""
    want = Counter()
    for r in mixing.decisions(odd_docs).collect():
        whole, part = divmod(r["taken"], r["size"]) if r["size"] else (1, 0)
        want[r["doc_id"], r["source"], r["size"]] += min(2, whole + (2 * part >= r["size"])) if r["size"] else 1
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in mixing.mixed_documents(odd_docs).collect())
    assert got == +want


def removed(rows, window):
    out = []
    starts = defaultdict(set)
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for s in range(len(w) - window + 1):
            starts[tuple(w[s : s + window])].add(d)
    for d, w in cut:
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and any(x is not None and x < d for x in starts[tuple(w[s : s + window])]):
                gone |= set(range(s, s + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [5, 50])
def test_substring_dedup(odd_docs, no_docs, window):
    got = substring_dedup.remove_repeats(odd_docs, window).drop("kept_text")
    assert sorted(map(tuple, got.collect()), key=repr) == removed(texts(odd_docs), window)
    assert substring_dedup.remove_repeats(no_docs, window).count() == 0


def test_substring_dedup_of_passages_repeated_within_documents(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(12):
        words = [f"v{k}x{x}" for x in rng.integers(0, 400, 140)]
        passage, own = words[:60], words[60:100]
        rows += [(10 * k + 1, " ".join(passage)), (10 * k + 2, " ".join(own + passage + own + passage + own))]
        rows += [(10 * k + 3, " ".join(words[100:] + passage + own)), (10 * k + 3, " ".join(own + words[100:120] + passage + words[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.remove_repeats(docs).drop("kept_text")
    assert sorted(map(tuple, got.collect()), key=repr) == removed(rows, 50)


def test_fm_index_finds_all_windows():
    rng = np.random.default_rng(1)
    docs = [[b"w%d" % x for x in rng.integers(0, 6, n)] for n in (0, 40, 300, 7)]
    query = [b"w%d" % x for x in rng.integers(0, 7, 500)] + docs[2][20:90]
    index = FMIndex(docs)
    for t in (3, 10):
        had = {tuple(d[i : i + t]) for d in docs for i in range(len(d) - t + 1)}
        truth = {i for i in range(len(query) - t + 1) if tuple(query[i : i + t]) in had}
        found = {i for _, b, e in long_matches(index, [index.encode(query)], t, stretch=37) for i in range(b, e - t + 1)}
        assert found == truth
    text = np.r_[rng.integers(1, 3, 200), 0]
    assert suffix_array(text).tolist() == sorted(range(201), key=lambda i: text[i:].tolist())


def test_token_counts(odd_docs, no_docs, library):
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs, VOCABULARY).collect()), key=repr)
    truth = []
    for d, t in texts(odd_docs):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        truth.append((d, len((t or "").encode()), n, n > 2048))
    assert got == sorted(truth, key=repr)
    assert token_counts.count_tokens(no_docs, VOCABULARY).count() == 0


def test_token_ids_of_odd_texts(library):
    rng = np.random.default_rng(2)
    letters = list("ab AB's'tll \t\n\x0b\x85\x1c éÉßİΣ́日12½!.<|>endoftext​﻿🙂") + ["<|endoftext|>", "<|startoftext|>", "aaa"]
    made = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(800)] + ["a" * 3000, "ab" * 900 + "!?" * 200]
    got = ChunkTokens(VOCABULARY, cached=50).encode(made)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in library.encode_batch(made, add_special_tokens=False)]


def components_by_brute_force(rows):
    sets = [(d, set(shingle_set(t).tolist())) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted(((d, len(s), root(d) if d is not None else None, d is None or root(d) == d) for d, s in sets), key=repr)


def test_near_duplicates(odd_docs, no_docs):
    assert sorted(map(tuple, minhash.near_duplicates(odd_docs).collect()), key=repr) == components_by_brute_force(texts(odd_docs))
    assert minhash.near_duplicates(no_docs).count() == 0
    assert set(minhash.kept_documents(odd_docs).columns) == set(odd_docs.columns)


def test_near_duplicates_of_edited_copies_and_repeated_ids(spark, monkeypatch):
    """A group whose copies are linked through some only, in blocks; ids that repeat with other texts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for d in range(90):
        words = list(base)
        for i in rng.integers(0, 160, rng.integers(0, 7)):
            words[i] = f"e{d}_{i}"
        rows.append((d, " ".join(words)))
    rows += [(500, rows[3][1]), (500, "quite another text of seven words"), (501, "quite another text of seven words"), (502, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr) == components_by_brute_force(rows)


def test_estimates_are_near():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    x, y = minhash.packed(minhash.minima(minhash.mix(a))), minhash.packed(minhash.minima(minhash.mix(b)))
    differ = x ^ y
    agree = int(np.bitwise_count(~(differ | (differ >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
    assert abs((agree / 256 - 0.25) / 0.75 - 800 / 1200) < 0.17


def test_packing(odd_docs, no_docs, library):
    out = packing.pack(odd_docs, VOCABULARY, window=64, rows_per_task=5).collect()
    want = Counter()
    for d, t in texts(odd_docs):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 64):
            part = np.array(ids[s : s + 64], "<u4").tobytes()
            want[d, s, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_docs, VOCABULARY).count() == 0


def test_fillings_are_fullest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 6)}
        lengths = sorted(counts)
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(lengths[-1])
        sums = {0}
        for k in items:
            sums |= {s + k for s in sums}
        best = max(s + lengths[-1] for s in sums if s + lengths[-1] <= 40)
        used = packing.fullest_filling(counts, lengths, 40, 1 << 30)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())
    plan = packing.plan_windows({5: 7, 3: 11, 40: 2}, 40)
    assert Counter({k: sum(t * u.get(k, 0) for t, u in plan) for k in (5, 3, 40)}) == Counter({5: 7, 3: 11, 40: 2})


def test_line_dedup(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs, min_sites=3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out.collect() if r["doc_id"] is not None}
    assert got[13][1] == 0 and got[14] == (2, 1, "other") and got[15] == (1, 1, "") and got[3] == (0, 0, None) and got[4] == (1, 0, "")
    assert out.drop("n_lines", "n_removed").columns == odd_docs.columns and out.count() == odd_docs.count()
    clashing = odd_docs.toDF("doc_id", "text", "n_lines", "source", "gone", "_gone", "text_key", "n_removed")
    again = line_dedup.dedup_lines(clashing, min_sites=3)
    assert again.columns == ["doc_id", "text", "source", "gone", "_gone", "text_key", "n_lines", "n_removed"]
    assert sorted(map(repr, again.select("doc_id", "text", "n_lines", "n_removed").collect())) == sorted(map(repr, out.select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_copies_of_a_document_are_one_site(spark):
    """A copied document's own lines stay however many sites hold it; a line of different documents goes, alike in equal texts."""
    copied = "\n".join(f"own line {i}" for i in range(8))
    rows = [(d, copied + ("\nads" if d % 2 else ""), f"s{d}") for d in range(12)] + [(20 + d, f"text {d}\n subscribe \nend {d}", f"s{d}") for d in range(6)]
    rows += [(30, "text 0\n subscribe \nend 0", "s9"), (31, "text 1\n subscribe \nend 1", None), (None, "more\nsubscribe", None), (None, "rare\nlone", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    gone = {"text 1\n subscribe \nend 1", "text 2\n subscribe \nend 2", "text 3\n subscribe \nend 3", "text 4\n subscribe \nend 4", "text 5\n subscribe \nend 5", "more\nsubscribe"}
    cut = {t: "\n".join(x for x in t.split("\n") if x.strip() != "subscribe") for t in gone}
    assert got == {(d, cut.get(t, t), int(t in gone)) for d, t, _ in rows}
    assert {r["n_removed"] for r in line_dedup.dedup_lines(docs, min_sites=7).collect()} == {0}


def test_line_spread_near_the_threshold(spark):
    rows = [(d, f"line{k}\nown{d}", f"s{d % 100}") for k, sites in ((0, 49), (1, 50), (2, 51), (3, 60)) for d in range(k * 100, k * 100 + sites)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.widespread_lines(docs, line_dedup.lines_of(docs), 50).count() == 3


def test_all_boilerplate_of_a_site_goes(spark):
    """Each line on many sites goes, whatever other lines stand beside it and however their hashes sort."""
    menu = next(f"Home | About | {i}" for i in range(1 << 20) if hashlib.md5(f"Home | About | {i}".encode()).hexdigest().startswith("0000"))
    header = [f"Header entry {i}" for i in range(12)]
    rows = [(d, f"own a {d}\nSubscribe to our newsletter\nown b {d}\n{menu}", f"site{d % 20}") for d in range(200)]
    own = [" ".join(f"word{d}x{i}" for i in range(40)) for d in range(30)]
    rows += [(300 + d, "\n".join([*header, *own[d].split(" ", 6)]), f"site{d % 20}") for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got.pop(0) == (rows[0][1], 0) and got.pop(300) == (rows[200][1], 0)  # the first text with a line keeps it
    assert all(got[d] == (f"own a {d}\nown b {d}", 2) for d in range(1, 200))
    assert all(got[300 + d] == ("\n".join(own[d].split(" ", 6)), 12) for d in range(1, 30))


def test_near_copies_on_many_sites_keep_their_lines(spark):
    """Near copies whose edits differ are one site, also where the edit is in the line with the smallest hash."""
    lines = [" ".join(f"w{i}n{j}" for j in range(12)) for i in range(20)]
    rows = [(d, "\n".join([f"changed {d}" if i == d else x for i, x in enumerate(lines)] + ["all rights reserved"]), f"site{d}") for d in range(15)]
    rows += [(50 + d, f"page {d} of its own\nall rights reserved", f"site{d}") for d in range(6)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[d] == (t if d == 0 else t.replace("\nall rights reserved", "")) for d, t, _ in rows)


def test_fingerprints(odd_docs, no_docs):
    rows = sorted((r for r in texts(odd_docs) if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    nulls = [r for r in texts(odd_docs) if r[0] is None]
    out = imatch.fingerprints(odd_docs, least=0.0, most=1.0, buckets=5).collect()
    want = Counter()
    for (d, t), (_, n) in zip(rows + nulls, rows[1:] + rows[:1] + rows[:1] * len(nulls), strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 4
        want[d, len(t), hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    marks = defaultdict(set)
    for r in out:
        marks[dict(rows + nulls)[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(m) == 1 for m in marks.values())
    assert imatch.fingerprints(no_docs).count() == 0


def test_fingerprints_of_null_ids_and_one_document(spark):
    df = spark.createDataFrame([(None, "b b b b"), (None, "a a a a")], "doc_id long, text string")
    assert sorted(r["n_chars"] for r in imatch.fingerprints(df, buckets=3).collect()) == [7, 7]
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0


def plain_fingerprint(text, lexicon):
    """The rules once more, term by term."""
    terms = sorted({int(xxhash.xxh3_64_intdigest(w)) for w in re.findall(r"[^\W\d_]+", (text or "").lower())})
    known = [t for t in terms if t in lexicon]
    if not known:
        return xxhash.xxh3_64_hexdigest(np.array(terms, np.uint64).tobytes())
    parts = []
    for s in range(imatch.SUBSETS):
        seed = int(imatch.mix(np.array([s + 1], np.uint64))[0])
        drawn = [t for t in known if int(imatch.mix(np.array([t ^ seed], np.uint64))[0]) < 1 << (64 - (1 + s % imatch.RATES))]
        parts.append(xxhash.xxh3_64_hexdigest(np.array(drawn, np.uint64).tobytes())[:6] if 1 <= len(drawn) <= imatch.MOST_TERMS else "------")
    return "".join(parts) + xxhash.xxh3_64_hexdigest(np.array(known, np.uint64).tobytes())


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([m[i : i + 6] for i in range(0, len(m) - 16, 6)] for m in (a, b))
    used = [(p, q) for p, q in zip(x, y, strict=False) if p != "------" or q != "------"]
    return sum(p == q for p, q in used) / len(used) if x and y and used else 0.0


def test_fingerprints_against_the_rules_term_by_term(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(90)] + ["ΑΣ", "Straße", "x_y", "it's"]
    rows = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([40, 3, 80, 0, 200, 1, 60, 60, 25, 120])] + [(10, None), (11, "12 34 _"), (None, "wab wac ΑΣ"), (None, "")]
    out = {(r["doc_id"], r["n_chars"]): r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), least=0.15, most=0.7, buckets=3).collect()}
    df = Counter(w for _, t in rows for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())))
    lexicon = {int(xxhash.xxh3_64_intdigest(w)) for w, n in df.items() if max(2, 0.15 * len(rows)) <= n <= max(2, 0.7 * len(rows))}
    assert 5 < len(lexicon) < len(df)
    for k, (d, t) in enumerate(rows):
        t, n = t or "", (rows[(k + 1) % 12][1] if d is not None else rows[0][1]) or ""
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        mark, edited_mark = plain_fingerprint(t, lexicon), plain_fingerprint(edited, lexicon)
        r = out[d, len(t)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (mark, edited_mark)
        assert abs(r["near_edited"] - plain_likeness(mark, edited_mark)) < 1e-12 and abs(r["near_next"] - plain_likeness(mark, plain_fingerprint(n, lexicon))) < 1e-12


def test_edited_texts_are_nearer_than_the_next(spark):
    out = imatch.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    row = out.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double")).alias("share"), F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next")).first()
    assert row["share"] > 0.95 and row["edited"] > 10 * row["next"]


def test_fingerprints_of_texts_with_thousands_of_terms():
    name = "".maketrans("0123456789", "abcdefghij")
    words = [str(x).translate(name) for x in range(60_000)]
    lex = np.sort(np.concatenate([imatch.terms_of(w) for w in words]))
    for n in (30, 300, 3000, 20_000, 60_000):
        text, near, other = " ".join(words[:n]), " ".join(words[n // 50 : n]), " ".join(words[n : 2 * n] or words[:2])
        mark = imatch.fingerprint(text, lex)
        parts = [mark[i : i + imatch.DIGITS] for i in range(0, imatch.SUBSETS * imatch.DIGITS, imatch.DIGITS)]
        assert len(mark) == imatch.SUBSETS * imatch.DIGITS + 16 and 8 <= sum(p != imatch.UNUSED for p in parts) <= 32, n
        assert 0.5 < imatch.likeness(mark, imatch.fingerprint(near, lex)) <= 1 and imatch.likeness(mark, imatch.fingerprint(other, lex)) < 0.2


def test_language_id_learns_and_keeps_to_its_rules(spark, odd_docs, no_docs):
    out = langid.identify(odd_docs).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        text = dict(texts(odd_docs))[r["doc_id"]]
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert langid.identify(no_docs).count() == 0
    assert langid.accepted(odd_docs).columns == odd_docs.columns
    clashing = odd_docs.toDF("doc_id", "text", "lang", "source", "lang_pred", "score", "grams", "h")
    assert langid.accepted(clashing).columns == clashing.columns
    assert langid.predict(clashing, langid.fit(clashing)).columns == ["doc_id", "text", "lang", "source", "grams", "h", "lang_pred", "score"]


def plain_prediction(text, model):
    """The two levels once more, machine by machine."""
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    x = np.sqrt(langid.gram_counts(text) / langid.gram_counts(text).sum())
    value = [float(x @ model.weights[:-1, k] + model.weights[-1, k]) for k in range(model.weights.shape[1])]
    n = len(model.families) if len(model.families) > 1 else 0
    family = max(range(n), key=lambda k: value[k]) if n else 0
    least = [value[family]] if n else []
    wins, strength = Counter(), Counter()
    members = model.languages[model.families[family]]
    for k, (a, b) in enumerate(model.pairs, n):
        if a in members:
            wins[a if value[k] >= 0 else b] += 1
            strength[a] += value[k]
            strength[b] -= value[k]
    best = max(members, key=lambda m: (wins[m], strength[m], m))
    least += [value[k] if a == best else -value[k] for k, (a, b) in enumerate(model.pairs, n) if best in (a, b)]
    return best, 1 / (1 + np.exp(-4 * min(least, default=float("inf"))))


def test_language_id_against_machine_by_machine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    for r in langid.predict(docs, model).collect():
        best, score = plain_prediction(r["text"], model)
        assert r["lang_pred"] == best and abs(r["score"] - score) < 1e-4


def test_every_label_is_learned(spark):
    """201 labels, each with words of its own, are all predicted."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(201):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)]
        rows += [(1000 * k + i, " ".join(rng.choice(own, 30)), f"l{k:03d}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=4, rest_rows=200)
    found = [(r["lang"], model.predict(langid.gram_counts(r["text"]))[0]) for r in docs.sample(0.3, 1).collect()]
    assert len(model.families) == 201 and sum(a == b for a, b in found) / len(found) > 0.97


def test_language_id_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    blind = langid.predict(docs.select("doc_id", "text").withColumn("lang", F.lit("fr")), langid.fit(docs)).select("doc_id", F.col("lang_pred").alias("blind"))
    assert langid.identify(docs).join(blind, "doc_id").where("lang_pred <> blind").count() == 0
