"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes (insult, threat, target, negation, reported speech,
conjunction, other), marks as ends of clauses and sentences and as quotation
marks; both pass a cascade of finite-state transducers, composed once into one
table.  The composed machine scores a matched clause, not a word: an insult
counts more with a target anywhere in its clause, a threat only with one; both
count little after a negation in the clause, less where they are reported:
after a word of speech to its sentence's end, or in a quotation that a word of
speech introduces or follows.  Clauses end at ``.!?;:``, at dashes, at
quotation marks, at line breaks, and at commas before a conjunction.

The insult words are learned from labels: words and word prefixes whose share
of toxic documents is significant given how many were tried, then a greedy
cover of the toxic documents, so that copies of one document do not fill the
lexicon, and what else a fiftieth of them show.  Labels are read from at most
``MAX_LABELLED`` training rows (lowest hashes first), a documented bound on
what the lexicon is fitted to; the lexicon is what that sample gives, without
a cap of its own, and all that is broadcast.

Defined cases: null and empty texts score as a text without a match; rows with
a null id are scored, and belong to neither fold's training rows; repeated
rows are scored each; an empty labels table gives an empty learned lexicon;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import batches_of, bounded_batches, cut

MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7)
FLOOR = 0.02  # score of a text without a match
CACHE_SIZE = 200_000
CACHED_CHARS = 64  # longer chunks are read anew each time
BATCH_BYTES = 4_000_000

OTHER, INSULT, THREAT, TARGET, PERSON, NEGATION, REPORTED, CONJUNCTION, COMMA, CLAUSE, SENTENCE, LINE, OPEN, CLOSE = range(14)
SYMBOLS = 14
WORD = range(COMMA)

#: Closed word classes in the four languages of the corpora.
WORDS = {
    THREAT: "kill hurt destroy murder stab töten umbringen verletzen tuer blesser détruire matar herir destruir",
    TARGET: "you your you're yourself him her them us du dich dir ihr euch ihn ihm tu te toi vous tú ti usted ustedes",
    PERSON: "he she they er sie il elle ils elles él ella ellos",
    NEGATION: "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás tampoco",
    REPORTED: "said says wrote quoted reported claimed sagte schrieb behauptete disait écrit affirme dijo escribió afirmó",
    CONJUNCTION: "and but or so because while und aber oder weil denn et mais ou car y pero porque sino",
}


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, output symbol)`` over small alphabets."""

    def __init__(self, states: int, step: Callable[[int, object], tuple[int, object]]):
        self.states, self.step = states, step

    def compose(self, after: Transducer) -> Transducer:
        """``after`` reads what this one writes."""

        def step(state: int, symbol: object) -> tuple[int, object]:
            a, out = self.step(state // after.states, symbol)
            b, out = after.step(state % after.states, out)
            return a * after.states + b, out

        return Transducer(self.states * after.states, step)

    def table(self, symbols: range) -> list[list[tuple[int, object]]]:
        return [[self.step(s, x) for x in symbols] for s in range(self.states)]


def _clauses() -> Transducer:
    """Writes (symbol, whether a clause ends before it): at a mark that says so, and at a conjunction after a comma."""

    def step(state: int, x: int) -> tuple[int, tuple[int, bool]]:
        return int(x == COMMA or (state and x in (OPEN, CLOSE))), (x, x in (CLAUSE, SENTENCE, LINE, OPEN, CLOSE) or (x == CONJUNCTION and state == 1))

    return Transducer(2, step)


def _negation(reach: int = 3) -> Transducer:
    """After a negation, the next ``reach`` words of its clause are marked negated."""

    def step(state: int, x: tuple) -> tuple[int, tuple]:
        if x[1]:
            state = 0
        if x[0] == NEGATION:
            return reach, (*x, False)
        return (max(0, state - 1) if x[0] in WORD else state), (*x, state > 0)

    return Transducer(reach + 1, step)


PLAIN, SAID, QUOTED, SAID_QUOTED = range(4)


def _speech() -> Transducer:
    """Marks words after a word of speech as reported, up to the sentence's end, a quotation it opens to that one's end.

    Words of another quotation are marked open: a word of speech after them decides.
    A line's end closes whatever is open.
    """

    def step(state: int, x: tuple) -> tuple[int, tuple]:
        s = x[0]
        own = PLAIN if s in (CLOSE, OPEN) or state == PLAIN else {SAID: SAID, QUOTED: QUOTED, SAID_QUOTED: SAID}[state]
        if s == REPORTED:
            state = SAID_QUOTED if state in (QUOTED, SAID_QUOTED) else SAID
        elif s == LINE or (s == SENTENCE and state == SAID):
            state = PLAIN
        elif s == OPEN:
            state = {PLAIN: QUOTED, SAID: SAID_QUOTED}.get(state, PLAIN)  # a mark that could be either closes what is open
        elif s == CLOSE and state in (QUOTED, SAID_QUOTED):
            state = PLAIN
        return state, (*x, own)

    return Transducer(4, step)


def _weight() -> Transducer:
    """(what ends before the symbol, its rank as a target, whether it is a word of speech, weights by the clause's rank, openness).

    An insult counts without a target, more with one or with a person spoken of; a threat only with a target.
    """

    def step(state: int, x: tuple) -> tuple[int, tuple]:
        symbol, ends, negated, speech = x
        factor = (NEGATED if negated else 1.0) * (REPORT if speech == SAID else 1.0)
        weights = {INSULT: (1.0, 1.25, 1.25), THREAT: (0.0, 0.0, 0.75)}.get(symbol, NOTHING)
        close = 2 if symbol == LINE or (symbol == SENTENCE and speech != QUOTED) else int(ends)
        return 0, (close, {TARGET: 2, PERSON: 1}.get(symbol, 0), symbol == REPORTED and speech != QUOTED, tuple(w * factor for w in weights), speech == QUOTED)

    return Transducer(1, step)


NEGATED, REPORT = 0.25, 0.25  # factors
NOTHING = (0.0, 0.0, 0.0)

GRAMMAR = _clauses().compose(_negation()).compose(_speech()).compose(_weight()).table(range(SYMBOLS))


class Matcher:
    """One text through the composed transducer.

    A clause is settled where it ends, as only then it is known whether it has a target, on whichever side.  What a
    quotation weighs is settled with its sentence, as a word of speech may follow it.
    """

    def __init__(self) -> None:
        self.state = self.rank = 0
        self.total = self.quoted = 0.0
        self.weights = [0.0, 0.0, 0.0]
        self.open = self.reported = False

    def _clause(self) -> None:
        if self.open:
            self.quoted += self.weights[self.rank]
        else:
            self.total += self.weights[self.rank]
        self.weights = [0.0, 0.0, 0.0]
        self.rank, self.open = 0, False

    def read(self, symbol: int, weight: float = 1.0) -> None:
        self.state, (close, rank, speech, weights, quoted) = GRAMMAR[self.state][symbol]
        if close:
            self._clause()
        if speech:
            self.reported = True
        if close == 2:
            self._sentence()
        self.rank = max(self.rank, rank)
        self.open |= quoted and symbol in WORD
        if any(weights):
            self.weights = [a + w * weight for a, w in zip(self.weights, weights, strict=True)]

    def _sentence(self) -> None:
        self.total += self.quoted * (REPORT if self.reported else 1.0)
        self.quoted, self.reported = 0.0, False

    def end(self) -> float:
        self.read(LINE)
        return self.total


_STRIP = re.compile(r"[^\w']+|_+")
_OPENING, _CLOSING = '"“„«»', '"”“»«'
_LETTER = re.compile(r"\w")


def _word(chunk: str) -> str:
    return _STRIP.sub("", chunk).strip("'")


def symbols(chunk: str, kind: int) -> tuple[int, ...]:
    """A chunk between white space as symbols: quotation marks, its word, marks after it."""
    has = bool(_word(chunk))
    lead, trail = chunk, ""
    if has:
        lead, trail = chunk[: _LETTER.search(chunk).start()], chunk[len(chunk) - _LETTER.search(chunk[::-1]).start() :]
    out: list[int] = [OPEN] if any(c in _OPENING for c in lead) else []
    if not has and any(c in "–—-;:" for c in lead):
        out.append(CLAUSE)
    if has:
        out.append(kind)
    marks = trail if has else lead
    if any(c in ".!?…" for c in marks):
        out.append(SENTENCE)
    elif any(c in ";:–—" for c in trail):
        out.append(CLAUSE)
    elif "," in marks:
        out.append(COMMA)
    if any(c in _CLOSING for c in trail):
        out.append(CLOSE)
    return tuple(out)


class Lexicon(dict):
    """Chunk between white space -> number of its symbols' sequence; weights of insults beside it."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.classes = {w: c for c, words in WORDS.items() for w in words.split()}
        self.learned = learned
        self.weight: dict[str, float] = {}
        self.sequences: list[tuple[int, ...]] = []  # some 150 at most
        self.numbers: dict[tuple[int, ...], int] = {}

    def __missing__(self, chunk: str) -> int:
        word = _word(chunk)
        w = max((self.learned.get(x, 0.0) for x in (word + "$", *(word[:k] for k in PREFIXES if len(word) >= k))), default=0.0) if word else 0.0
        kind = INSULT if w > 0 else self.classes.get(word, OTHER)
        found = symbols(chunk, kind)
        number = self.numbers.get(found)
        if number is None:
            number = self.numbers[found] = len(self.sequences)
            self.sequences.append(found)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
                self.weight.clear()
            self[chunk] = number
            if kind == INSULT:
                self.weight[chunk] = w
        return number

    def _weight_of(self, chunk: str) -> float:
        w = self.weight.get(chunk)
        if w is None:
            word = _word(chunk)
            w = max(self.learned.get(x, 0.0) for x in (word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)))
        return w

    def score(self, text: str | None) -> float:
        if not text:
            return FLOOR
        text = text.lower()
        used = set(map(self.__getitem__, text.split()))
        if not any(x in (INSULT, THREAT) for n in used for x in self.sequences[n]):
            return FLOOR
        m = Matcher()
        for line in text.splitlines():
            for chunk in line.split():
                for x in self.sequences[self[chunk]]:
                    m.read(x, self._weight_of(chunk) if x == INSULT else 1.0)
            m.read(LINE)
        return FLOOR + (1 - FLOOR) * (1 - math.exp(-m.end()))


def _terms(text: str | None) -> set[str]:
    """What a text shows to the learner: words (marked with $) and prefixes."""
    words = {_word(c) for c in (text or "").lower().split()}
    return {w + "$" for w in words if len(w) > 2} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def learn(labelled: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Lexicon from (text, toxic) rows: significant terms that cover the toxic ones."""
    if not positives or not negatives:
        return {}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for b in it:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (pos if y else neg).update(_terms(t))
        words = list(pos | neg)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([pos[w] for w in words], pa.int64()), pa.array([neg[w] for w in words], pa.int64())], ["term", "pos", "neg"])

    rate = positives / (positives + negatives)
    seen = labelled.select("text", "toxic").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = (F.col("pos") + F.col("neg")) * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0))
    # A text shows some hundred terms and a bounded number of rows is read: e^20 covers all the terms tried.
    strong = seen.filter((F.col("pos") >= 3) & (share > 0.9)).withColumn("gain", gain).filter(F.col("gain") > min(20.0, 2 + 2 * math.log(positives + 1)))
    top = strong.collect()  # terms of at most MAX_LABELLED rows that three or more toxic ones share
    if not top:
        return {}
    weight = {r.term: min(6.0, math.log((r.pos + 0.5) / (positives + 1)) - math.log((r.neg + 0.5) / (negatives + 1))) / 6 for r in top}
    known = labelled.sparkSession.sparkContext.broadcast(set(weight))

    def show(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(t) & known.value) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

    rows = [set(r.terms) for r in labelled.filter("toxic = 1").select("text").mapInArrow(show, "terms array<string>").collect()]
    lexicon: dict[str, float] = {}
    left = [r for r in rows if r]
    least = max(2, positives // 500)
    while left:
        best, n = max(Counter(t for r in left for t in r).items(), key=lambda x: (x[1], -len(x[0]), x[0]))
        if n < least:
            break
        lexicon[best] = weight[best]
        left = [r for r in left if best not in r]
    often = Counter(t for r in rows for t in r)
    floor = max(least, len(rows) // 50)  # words that documents of the cover show beside the chosen one
    return lexicon | {t: weight[t] for t, n in often.items() if n >= floor}


def learned_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 4, held_fold: int = 2) -> dict[str, float]:
    """Insult terms and weights from the labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    train = labels.filter((_fold(id_col, folds) != held_fold) & F.col("toxic").isNotNull()).select(F.col(id_col), F.col("toxic").cast("int").alias("toxic"))
    train = train.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64(id_col), id_col).limit(MAX_LABELLED)
    labelled = cut(docs.select(F.col(id_col), "text").join(F.broadcast(train), id_col).select("text", "toxic"))  # MAX_LABELLED ids at most
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return learn(labelled, n.get(1, 0), n.get(0, 0))


def _fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    lexicon = docs.sparkSession.sparkContext.broadcast(learned_lexicon(docs, labels, id_col, folds, held_fold))

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon.value)
        for b in batches_of(it, BATCH_BYTES, "text"):
            s = [words.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(_fold(id_col, folds) == held_fold, F.lit(False))
    return docs.select(F.col(id_col), held.alias("held_out"), "text").mapInArrow(apply, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    lexicon = docs.sparkSession.sparkContext.broadcast(learned_lexicon(docs, labels, id_col))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(lexicon.value)
        for b in batches_of(it, BATCH_BYTES, "text"):
            yield b.filter(pa.array([words.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
