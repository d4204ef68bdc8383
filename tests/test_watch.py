"""The watch over several micro-batches against a plain loop, and its plan."""

import json
import os
import random
from datetime import datetime, timedelta

from runscribe.operators.scoring import DIMENSIONS
from runscribe.sources import card_folder
from runscribe.streaming import watch

SCHEMA = "skill string, run_id long, ts timestamp_ntz, composite_cents double"


def test_watch_goes_on_over_batches(spark, tmp_path):
    rng, last, want, seen = random.Random(2), {}, [], {}
    at = {k: str(tmp_path / k) for k in ("runs", "state", "out")}
    for part in range(3):
        rows = [(rng.choice(["hot", "hot", "hot", "a", None]), 1000 * part + i, datetime(2026, 1, 1 + part) + timedelta(minutes=rng.randrange(20)), float(rng.randrange(40))) for i in range(60)]
        rows += [("hot", 1000 * part + 99, None, 7.0), (f"new{part}", 1000 * part + 98, None, None), ("a", 1000 * part + 97, datetime(2026, 1, 1 + part), float("nan"))]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(at["runs"])
        watch.watch_once(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).parquet(at["runs"]), at["state"], at["out"])
        for skill, run_id, _, cents in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            gain = None if cents is None or last.get(skill) is None else cents - last[skill]
            known = skill in last
            last[skill] = cents
            seen.setdefault(skill, []).append(cents)
            want.append((run_id, "first" if not known else "flat" if gain is None else "improved" if gain > 5 else "regressed" if gain < -5 else "flat"))
    state = {r["skill"]: (r["last"], r["recent"]) for r in spark.read.parquet(f"{at['state']}/last/2").collect()}
    assert {k: repr(v[0]) for k, v in state.items()} == {k: repr(v) for k, v in last.items()}
    assert {k: repr(v[1]) for k, v in state.items()} == {k: repr(v[-10:]) for k, v in seen.items()}
    got = spark.read.parquet(at["out"])
    assert sorted((r["run_id"], r["change"]) for r in got.collect()) == sorted(want)


def test_watch_holds_no_skill_in_one_frame(spark):
    """A skill's runs are sorted by Spark, which spills, and never gathered in a Python task."""
    plan = watch.changes(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "skill string, last double"))._jdf.queryExecution().toString()
    assert "Window" in plan and "InPandas" not in plan


def card(skill, ts, composite, score, **more):
    return json.dumps({"skill": skill, "timestamp": ts, "composite_score": composite, "dimensions": {d: {"score": score} for d in DIMENSIONS}, **more})


def put(spark, folder, rows):
    spark.createDataFrame(rows, "file string, value string").write.format(card_folder.NAME).mode("append").save(folder)


def test_folder_followed_over_restarts(spark, tmp_path):
    """Each pass is a query of its own that goes on from the checkpoint: rewrites, removals, broken and mended files."""
    card_folder.register(spark)
    folder, state, out = (f"{tmp_path}/{n}" for n in ("cards", "state", "out"))
    first = [(f"a{i:02}.json", card("a", f"t{i:02}", 9.0, 9)) for i in range(14)]
    put(spark, folder, [*first, ("b.json", card("b", "t", 5.5, 5)), ("c.json", "{broken"), ("z.json", card("z", "t", 1, True)), ("note.txt", "no card")])
    watch.watch_folder(spark, folder, state, out)
    rewritten = [("b.json", card("b", "t", 6.0, 6)), ("a13.json", None), ("a12.json", card("a", "t12", 9.0, 9).replace(", ", ",   ")), ("c.json", card("c", "t", 3, 3)), ("z.json", "[1]"), ("n.json", '{"x": 1}')]
    put(spark, folder, rewritten)
    watch.watch_folder(spark, folder, state, out)
    watch.watch_folder(spark, folder, state, out)  # nothing changed
    put(spark, folder, [("b.json", card("c", "u", 5.0, 6)), ("n.json", None)])
    watch.watch_folder(spark, folder, state, out)
    rows = spark.read.parquet(out).collect()
    told = {(r["pass_no"], r["file"], r["kind"]): r["header"] for r in rows if r["kind"] != "window"}
    same = "[watch] {}: improved 0, regressed 0, unchanged 7 since last run — composite {} (first run)".format
    want = {(1, f, "first"): same("a", "9.00") for f, _ in first}
    want |= {(1, "b.json", "first"): same("b", "5.50"), (1, "z.json", "first"): same("z", "1.00"), (1, "c.json", "broken"): None}
    want |= {(2, "b.json", "changed"): "[watch] b: improved 7, regressed 0, unchanged 0 since last run — composite 5.50 ↑ 6.00 (+0.50)", (2, "a13.json", "removed"): "[watch] removed: a13.json"}
    want |= {(2, "c.json", "first"): same("c", "3.00"), (2, "z.json", "broken"): None, (2, "z.json", "removed"): "[watch] removed: z.json", (2, "n.json", "first"): same("n", "0.00")}
    want |= {(3, "b.json", "moved"): None, (3, "b.json", "changed"): "[watch] c: improved 0, regressed 0, unchanged 7 since last run — composite 6.00 ↓ 5.00 (-1.00)", (3, "n.json", "removed"): "[watch] removed: n.json"}
    assert told == want
    windows = {(r["pass_no"], r["skill"]): (r["window_runs"], r["window_top"], r["collapsed"]) for r in rows if r["kind"] == "window"}
    assert windows[1, "a"] == (10, 10, True) and windows[2, "a"] == (9, 9, True) and windows[1, "b"] == (1, 0, False)
    assert windows[3, "b"] == (0, 0, False) and windows[3, "c"] == (2, 0, False) and (3, "a") not in windows
    assert len(os.listdir(f"{state}/passes")) <= 2  # lists that are handled go
    assert spark.read.format(card_folder.NAME).load(folder).count() == 16  # .txt isn't a card


def test_a_gain_of_five_hundredths_is_flat(spark):
    """6.23 - 6.18 is more than 0.05 in doubles."""
    pairs = [(b / 100, (b + g) / 100) for b in range(0, 990, 3) for g in (-6, -5, 0, 5, 6) if 0 <= b + g <= 999]
    rows = spark.createDataFrame([(i, "changed", "s", b, c, 0, 0) for i, (b, c) in enumerate(pairs)], "i long, kind string, skill string, before double, composite double, improved int, regressed int")
    got = rows.selectExpr("*", "'f' AS file", "7 AS unchanged").select("i", watch.header_of().alias("h")).orderBy("i").collect()
    want = [f"composite {b:.2f} {'↑' if round((c - b) * 100) > 5 else '↓' if round((c - b) * 100) < -5 else '→'} {c:.2f} ({c - b:+.2f})" for b, c in pairs]
    assert [r["h"].split(" — ")[1] for r in got] == want


def test_shares_of_a_pass():
    before = {f"f{i}": [1, 10] for i in range(5)}
    now = {"f0": [1, 10], "f1": [2, 10], "f2": [1, 11], "g": [5_000_000, card_folder.SHARE_BYTES], "h": [1, 1]}
    made = card_folder.shares(3, before, now)
    assert [n for s in made for n, _ in s.files] == ["f1", "f2", "g", "h"] and [n for s in made for n in s.gone] == ["f3", "f4"]
    assert [len(s.files) for s in made] == [2, 1, 1, 0] and {s.number for s in made} == {3}
    many = {f"f{i}": [1, 1] for i in range(card_folder.SHARE_FILES * 2 + 1)}
    assert [len(s.files) for s in card_folder.shares(1, {}, many)] == [card_folder.SHARE_FILES] * 2 + [1]
    assert card_folder.shares(1, now, now) == [] and card_folder.listing("/nowhere/at/all") == {}
