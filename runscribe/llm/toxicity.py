"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as symbols: insults, threats, targets (you, they), negators, words of reported speech, breaks and
others.  Four transducers run over it, each reading what the one before wrote: negation marks insults and threats
within its scope, reported speech marks those behind "said" or "called", targets are remembered for the clause, and an
acceptor keeps the kinds of match.  They are composed once into one table, state by symbol.  Only clauses with an
insult or a threat are read; a word alone isn't scored, its clause is.

The lexicon is fixed words and those that labels add, read as insults.  A word is added if more of the toxic documents hold
it than chance explains, and most documents with it are toxic.  Toxic documents count by the word's neighbours in them, so
that copies and near copies of one toxic document are one, and don't make its other words look toxic.

Weights are those of the grammar's arcs: of a kind of clause and of a lexicon entry.  They start from fixed values and are
moved by the labels: each kind of clause and entry of a labelled document is an example.  A document's score is that of
its worst clause; without a matched clause it is the share of toxic documents among such.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stage

# The lexicon, lower case, by symbol.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles fool fools loser losers clown clowns scum scumbag trash garbage filth filthy "
    "pathetic worthless disgusting vile vermin parasite parasites subhuman pig pigs rat rats bastard bastards bitch bitches asshole assholes whore slut jerk retard retarded freak freaks "
    "coward cowards liar liars ugly useless degenerate degenerates cretin cretins crap shit shitty fucking "
    "dummkopf trottel idioten arschloch abschaum widerlich wertlos erbärmlich idiota idiotas imbécil estúpido estúpida escoria basura asqueroso patético "
    "imbécile crétin connard ordure minable dégoûtant abruti pathétique"
).split()
THREATS = "kill killed murder strangle stab shoot hang lynch exterminate destroy hurt beat töten umbringen ermorden tuer tuerai massacrer matar matarte asesinar".split()
TARGETS = "you your yours yourself u ur they them their those he him his she her hers these people du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATORS = "not no never neither nor cannot without isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine nie ne pas jamais nunca jamás sin".split()
REPORTERS = "said says say called calls wrote writes claimed claims reported reports alleged quoted quote told according tweeted sagte sagt nannte schrieb dit écrit appelé dijo dice llamó escribió".split()
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER, BREAK = range(7)
ENTRIES = [*INSULTS, *THREATS]
ENTRY_AT = {w: i for i, w in enumerate(ENTRIES)}
SYMBOL = {w: s for s, words in ((REPORTER, REPORTERS), (NEGATOR, NEGATORS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words} | {",": BREAK}
#: Words behind a negator that it negates, itself not counted.
NEGATION_SCOPE = 3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|,")
_CLAUSE_END = re.compile(r"[.!?;:\n]")

#: The weights that the labels start from; a clause's kind is (threat, negated, reported, targeted).
START = {"insult": 1.0, "threat": 0.0, "negated": -1.5, "reported": -1.0, "targeted": 1.0}
KINDS = [(t, n, r, g) for t in (0, 1) for n in (0, 1) for r in (0, 1) for g in (0, 1)]


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and the symbol that is written."""

    start: Hashable
    step: Callable[[Hashable, Hashable], tuple[Hashable, Hashable]]

    def then(self, other: Transducer) -> Transducer:
        """The transducer that reads what this one reads and writes what ``other`` writes on reading this one's output."""

        def step(state, symbol):
            first, written = self.step(state[0], symbol)
            second, out = other.step(state[1], written)
            return (first, second), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: range) -> tuple[list[list[int]], list[Hashable]]:
        """The reachable states: next state by state and symbol, and what was written on entering each, by a state's number.

        A state here is a state of the machine with the symbol last written, so that the last output can be read off it.
        """
        numbers, order, rows = {(self.start, None): 0}, [(self.start, None)], []
        for state, _ in order:  # grows while it is walked
            row = []
            for symbol in symbols:
                reached = self.step(state, symbol)
                if reached not in numbers:
                    numbers[reached] = len(order)
                    order.append(reached)
                row.append(numbers[reached])
            rows.append(row)
        return rows, [written for _, written in order]


def _negation(left: int, symbol: int) -> tuple[int, tuple[int, int]]:
    """Writes (symbol, negated).  A negator opens a scope of some words, a break closes it; a matched word doesn't use it up."""
    if symbol == NEGATOR:
        return NEGATION_SCOPE, (symbol, 0)
    if symbol == BREAK:
        return 0, (symbol, 0)
    return max(0, left - (symbol not in (INSULT, THREAT))), (symbol, int(left > 0))


def _reported(open_: int, read: tuple[int, int]) -> tuple[int, tuple[int, int, int]]:
    """Writes (symbol, negated, reported).  A word of reporting opens reported speech to the end of the clause."""
    return int(open_ or read[0] == REPORTER), (*read, open_)


def _target(seen: int, read: tuple[int, int, int]) -> tuple[int, tuple[int, int, int, int]]:
    """Writes (symbol, negated, reported, targeted).  A target counts for the clause, before the match or behind it."""
    seen = int(seen or read[0] == TARGET)
    return seen, (*read, seen)


def _accept(best: tuple[int, int, int] | None, read: tuple[int, int, int, int]) -> tuple[tuple[int, int, int] | None, tuple[int, int, int, int] | None]:
    """Writes the clause's kind so far: that of its gravest match (plain before reported before negated, insults before threats)."""
    symbol, negated, reported, targeted = read
    if symbol in (INSULT, THREAT):
        match = (int(symbol == THREAT), negated, reported)
        best = min(best or match, match, key=lambda m: (m[1], m[2], m[0]))
    return best, None if best is None else (*best, targeted)


GRAMMAR = Transducer(0, _negation).then(Transducer(0, _reported)).then(Transducer(0, _target)).then(Transducer(None, _accept))
NEXT, KIND_OF = GRAMMAR.table(range(7))
_KIND_AT = [None if k is None else KINDS.index(k) for k in KIND_OF]


class Lexicon:
    """The fixed entries, and behind them words that labels added, which are insults."""

    def __init__(self, added: tuple[str, ...]):
        self.entries = [*ENTRIES, *added]
        self.at = {w: i for i, w in enumerate(self.entries)}
        self.symbol = SYMBOL | dict.fromkeys(added, INSULT)
        self.finder = ahocorasick.Automaton()
        for word in self.entries:
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()


@cache
def lexicon(added: tuple[str, ...] = ()) -> Lexicon:
    return Lexicon(added)


def clause_kind(words: list[str], symbols: dict[str, int] = SYMBOL) -> int | None:
    """The number of a clause's kind; None if nothing in it matches."""
    state = 0
    for word in words:
        state = NEXT[state][symbols.get(word, OTHER)]
    return _KIND_AT[state]


def folded(text: str) -> str:
    return text.lower().replace("’", "'")


def matches(text: str | None, lex: Lexicon | None = None) -> list[int]:
    """Sorted distinct numbers, kind * entries + entry, of the entries in matched clauses of a whole text.

    Clauses end at . ! ? ; : and line feeds.  Each clause with an entry in it is read once.
    """
    if not text:
        return []
    text, lex = folded(text), lex or lexicon()
    found, end = set(), -1
    for last, length in lex.finder.iter(text):
        first = last - length + 1
        if last < end or (first and text[first - 1].isalpha()) or text[last + 1 : last + 2].isalpha():
            continue
        begin = max(text.rfind(mark, max(0, end), first) for mark in ".!?;:\n") + 1
        begin = max(begin, end, 0)
        stop = _CLAUSE_END.search(text, last)
        end = stop.start() if stop else len(text)
        words = _WORD.findall(text, begin, end)
        if (kind := clause_kind(words, lex.symbol)) is not None:
            found.update(kind * len(lex.entries) + lex.at[w] for w in words if w in lex.at)
    return sorted(found)


@dataclass
class Weights:
    """Log-odds of a kind of clause and of an entry, and the probability without a matched clause."""

    kinds: np.ndarray = field(default_factory=lambda: np.array([START["threat" if t else "insult"] + n * START["negated"] + r * START["reported"] + g * START["targeted"] for t, n, r, g in KINDS]))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(len(ENTRIES)))
    without: float = 0.05


def learned(examples: list[tuple[int, int, int]], clean: tuple[int, int], entries: int = len(ENTRIES), pull: float = 1.0, rounds: int = 100) -> Weights:
    """Weights from (number, documents, toxic documents) and (documents, toxic documents) without a match.

    Ridge-regularised logistic regression towards the starting weights, by Newton steps halved until the loss falls.  An
    example has one kind and one entry, so the entries' part of a step's matrix is diagonal and is eliminated.
    """
    out = Weights(entries=np.zeros(entries), without=(clean[1] + 0.05 * 20) / (clean[0] + 20))
    if not examples:
        return out
    at, n, toxic = (np.array(x) for x in zip(*examples, strict=True))
    kind, entry = at // entries, at % entries
    start = np.r_[out.kinds, out.entries]
    w = start.copy()

    def loss(w: np.ndarray) -> float:
        z = w[kind] + w[len(KINDS) + entry]
        return float((n * np.logaddexp(0, z) - toxic * z).sum() + pull / 2 * ((w - start) ** 2).sum())

    def by(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(kind, rest, len(KINDS)), np.bincount(entry, rest, entries)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(w[kind] + w[len(KINDS) + entry])))
        slope = np.r_[by(n * p - toxic)] + pull * (w - start)
        of_kinds, of_entries = (v + pull for v in by(n * p * (1 - p)))
        both = np.zeros((len(KINDS), entries))
        np.add.at(both, (kind, entry), n * p * (1 - p))
        a, b = slope[: len(KINDS)], slope[len(KINDS) :]
        of_kind = np.linalg.solve(np.diag(of_kinds) - (both / of_entries) @ both.T, a - both @ (b / of_entries))
        step = np.r_[of_kind, (b - both.T @ of_kind) / of_entries]
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    out.kinds, out.entries = w[: len(KINDS)], w[len(KINDS) :]
    return out


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def marked(labels: DataFrame) -> DataFrame:
    """doc_id and ``toxic`` (0 or 1) of what may be learned from: a row for each labelled doc_id that isn't held out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))


def neighbours(text: str) -> dict[str, tuple[int, int]]:
    """Of each distinct word of a text the words before and behind it, hashed, at the place where their hash is smallest."""
    words = [w for w in _WORD.findall(folded(text)) if w != ","]
    hashed = [0, *(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), 0]
    out: dict[str, tuple[int, int]] = {}
    mixed: dict[str, int] = {}
    for i, word in enumerate(words):
        before, behind = hashed[i], hashed[i + 2]
        mix = (before * 0x9E3779B1 ^ behind * 0x85EBCA77) & 0xFFFFFFFF
        if word not in mixed or (mix, before, behind) < (mixed[word], *out[word]):
            mixed[word], out[word] = mix, (before, behind)
    return out


#: Sides of a word that evidence is about: in clean documents none, in toxic ones the word before or behind.
CLEAN, BEFORE, BEHIND = range(3)
#: Rows that a task gathers before it hands them on.
HELD_ROWS = 300_000


def evidence(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """word, ``sites`` and ``clean`` of each word of a toxic document: its distinct neighbours there, on the side with
    fewer, a document giving one; and the clean documents that hold it.
    """

    def packed(rows: list[tuple[str, int, int, int]], clean: Counter) -> pa.RecordBatch:
        kinds = pa.string(), pa.int32(), pa.int64(), pa.int64()
        rows += ((word, CLEAN, 0, n) for word, n in clean.items())
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "side", "near", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, clean = [], Counter()
        for batch in batches:
            texts, toxic = batch.column("text"), batch.column("toxic")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if toxic[i].as_py():
                    for word, (before, behind) in neighbours(text).items():
                        rows += ((word, BEFORE, before, 1), (word, BEHIND, behind, 1))
                else:
                    clean.update(set(_WORD.findall(folded(text))))
                if len(rows) + len(clean) >= HELD_ROWS:
                    yield packed(rows, clean)
                    rows, clean = [], Counter()
        yield packed(rows, clean)

    # labels grow with the documents, so they are merged at every size and never broadcast
    read = docs.where(F.col("text").isNotNull() & ~held_out()).select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("text", "toxic")
    merged = read.mapInArrow(run, "word string, side int, near long, n long").groupBy("word", "side", "near").agg(F.sum("n").alias("n"))
    at = {side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n") if side == CLEAN else F.lit(1))), F.lit(0)) for side in (CLEAN, BEFORE, BEHIND)}
    return merged.groupBy("word").agg(F.least(at[BEFORE], at[BEHIND]).alias("sites"), at[CLEAN].alias("clean")).where("sites > 0")


#: Sites that a word needs to be judged; the share of wrong ones among the added words; the most that are added.
LEAST_SITES, WRONG, MOST_ADDED = 4, 0.01, 10_000


def added_words(docs: DataFrame, marks: DataFrame) -> tuple[str, ...]:
    """The words that labels add, sorted: more toxic than clean, and too often toxic for chance (Chernoff's bound of the
    binomial tail at the labels' toxic share, Benjamini and Hochberg's rule over all words that are judged).

    The driver sees the added words: those least likely by chance, ``MOST_ADDED`` at most.
    """
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return ()
    base = toxic / n
    words = stage(evidence(docs, marks).where(F.col("sites") >= LEAST_SITES), "toxicity-words")
    share = F.col("sites") / (F.col("sites") + F.col("clean"))
    nats = F.col("sites") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    likely = words.where((share > max(base, 0.5)) & ~F.col("word").isin(list(SYMBOL))).select("word", (-nats).alias("log_p"))
    judged = words.count()
    rows = likely.where(F.col("log_p") <= math.log(WRONG)).orderBy("log_p", "word").limit(MOST_ADDED).collect()
    most = max((i for i, r in enumerate(rows, 1) if r["log_p"] <= math.log(WRONG * i / judged)), default=0)
    return tuple(sorted(r["word"] for r in rows[:most]))


def matched(docs: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and ``found``, what ``matches`` gives for ``text``; one pass over whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(added)
        for batch in batches:
            texts = batch.column("text")
            found = pa.array((matches(texts[i].as_py(), lex) for i in range(batch.num_rows)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, found array<int>")


def fit(found: DataFrame, marks: DataFrame, entries: int = len(ENTRIES)) -> Weights:
    """Weights of all labelled rows that aren't held out.

    The driver sees a sum for each kind of clause and entry that occurs, 16 times the lexicon at most.
    """
    sums = found.join(marks, "doc_id").select("toxic", F.explode_outer("found").alias("number")).groupBy("number").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    rows = [(r["number"], r["n"], r["toxic"]) for r in sums.collect()]
    clean = next(((n, t) for number, n, t in rows if number is None), (0, 0))
    return learned(sorted((r for r in rows if r[0] is not None)), clean, entries)


def score(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text), by weights of ``labels`` (doc_id, toxic).

    Null, empty and unmatched texts get the share of toxic documents among unmatched ones.  A null doc_id isn't held out
    and has no label; null labels teach nothing; a doc_id with several labels is toxic if one says so; repeated rows are
    scored alike.  Without labels the starting weights hold.  An empty table gives no rows; extra columns are ignored.
    """
    marks = marked(labels)
    added = added_words(docs, marks)
    entries = len(ENTRIES) + len(added)
    found = stage(matched(docs, added), "toxicity-matches")
    weights = fit(found, marks, entries)
    table = F.lit(weights.kinds), F.lit(weights.entries)
    odds = F.transform("found", lambda k: F.element_at(table[0], (F.floor(k / entries) + 1).cast("int")) + F.element_at(table[1], (k % entries + 1).cast("int")))
    worst = F.array_max(odds)
    chance = F.when(F.size("found") > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), worst))))).otherwise(F.lit(float(weights.without)))
    return found.select("doc_id", held_out().alias("held_out"), F.greatest(chance, F.lit(float(weights.without))).alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))
