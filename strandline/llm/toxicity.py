"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by the language of their document. Five transducers rewrite and weigh the classes of a clause: the insult transducer
lets an ambiguous word through only where someone is called so; negation cancels what follows closely, or all of it after a negating subject
or a negated opinion; reported speech weakens; self, verb and target make a threat, and so does a wish; a target strengthens. They are
composed into one machine, which scores a clause in one pass. A clause without a word that can weigh scores 0 by construction, so
the machine runs on the other clauses only.

The classes hold a small built-in lexicon of four languages, and insults learned from labelled documents: words and stems of words,
weighed by their log-odds. A document's score is held against its length; how, is chosen on labelled documents by words learned from others.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

OTHER, INSULT, MILD, TARGET, NEGATION, REPORT, SELF, THREAT, WEAK, BE, NOBODY, THINK, MODAL, FORCE, HOPE, DIE = range(16)
#: Further classes that the transducers write.
AIMED, REPORTED, MENACE = 16, 17, 18
CLASSES = 19
#: Classes of words that a clause needs one of to weigh anything.
HOT = (INSULT, MILD, WEAK, THREAT, FORCE, DIE)

#: Language -> class -> words. No word holds an apostrophe: i'll is i and ll, and the t of n't is a negation by contracted().
#: WEAK: insults that have another sense. FORCE: threats only after a modal verb. NOBODY: subjects that negate their clause. THINK: opinions that a negation reaches through.
LEXICON = {
    "en": {
        INSULT: "idiot idiots moron morons scum imbecile imbeciles cretin cretins scumbag scumbags",
        WEAK: "worthless pathetic disgusting stupid loser losers trash clown clowns vermin garbage pig pigs rat rats",
        TARGET: "you your yours they them their he she him her those these u ur",
        NEGATION: "not never no nor neither without",
        NOBODY: "nobody none noone",
        REPORT: "said says saying say wrote writes writing called calls quoted quotes quoting claimed claims allegedly reported reportedly",
        SELF: "i we",
        THREAT: "kill hurt destroy murder shoot stab",
        FORCE: "beat crush punish smash",
        BE: "are re is be were was being",
        THINK: "think thinks believe believes mean means suppose supposes consider considers",
        MODAL: "will ll shall gonna must can going",
        HOPE: "hope wish",
        DIE: "die rot perish",
    },
    "de": {
        INSULT: "idiot idioten idiotin trottel arschloch dummkopf schwachkopf",
        WEAK: "abschaum ratte ratten müll",
        TARGET: "du dich dir ihr euch sie",
        NEGATION: "nicht kein keine keinen niemals nie",
        NOBODY: "niemand keiner",
        REPORT: "sagte sagt schrieb nannte behauptet",
        SELF: "ich wir",
        THREAT: "töten umbringen zerstören verletzen töte",
        FORCE: "schlagen schlage bestrafen",
        BE: "bist seid ist sind",
        THINK: "denke glaube finde meine glaubt denkt",
        MODAL: "werde werden will wollen",
        HOPE: "hoffe wünsche",
        DIE: "stirbst sterbt krepierst verreckst",
    },
    "fr": {
        INSULT: "connard connards salaud salope imbécile crétin abruti",
        WEAK: "ordure ordures stupide minable",
        TARGET: "tu te toi vous ils elles",
        NEGATION: "pas jamais aucun aucune sans ni",
        NOBODY: "personne nul",
        REPORT: "dit disait écrit appelé",
        SELF: "je nous j",
        THREAT: "tuer détruire blesser",
        FORCE: "frapper punir écraser",
        BE: "es êtes est sont",
        THINK: "pense crois trouve pensons croit",
        MODAL: "vais allons veux voulons",
        HOPE: "espère souhaite",
        DIE: "crèves meures creves",
    },
    "es": {
        INSULT: "imbécil estúpido estúpida gilipollas cabrón",
        WEAK: "escoria basura rata ratas",
        TARGET: "usted ustedes ellos ellas ti vosotros tú te",
        NEGATION: "no nunca jamás ni ningún sin",
        NOBODY: "nadie ninguno",
        REPORT: "dijo dice escribió llamó",
        SELF: "yo nosotros",
        THREAT: "matar destruir matarte",
        FORCE: "golpear golpearte aplastar",
        BE: "eres sois es son está",
        THINK: "pienso creo opino cree",
        MODAL: "voy vamos quiero",
        HOPE: "espero ojalá",
        DIE: "mueras muera muráis",
    },
}
#: Rows of the table of classes; documents of other languages, or of none, have the last, which holds all words, of those in several languages the first's class.
LANGUAGES = (*LEXICON, "")
#: What a clause's word adds by its class after rewriting.
WEIGHTS = {INSULT: 1.0, MILD: 0.5, AIMED: 1.5, REPORTED: 0.3, MENACE: 2.0}
#: Words after a negation that it reaches, up to a target; words between a target's verb and an ambiguous word.
SCOPE, GAP = 3, 2
#: The score from which on a document of at most SPAN words is rejected; a longer one needs as much again for every SPAN words.
THRESHOLD, SPAN = 1.0, 200
#: What labelled documents choose from: factors of the threshold, and spans, those that are preferred among equals first.
FACTORS, SPANS = (1.0, 1.25, 0.75, 1.5, 0.5, 2.0, 2.5, 3.0, 4.0, 6.0, 0.25), (200, 150, 300, 100, 500, 50, 1000, 30)
#: Largest share of the clean documents of one language or length that the choice may lose, or one document; clean documents that a share is taken of, at least.
MOST_LOST, LEAST_CELL = 0.01, 20
#: Toxic documents from which on a language chooses for itself.
LEAST_TOXIC = 5
#: Words from which on a document is of the next length.
LENGTHS = (200, 500, 1500)
#: Bytes of stems, which longer words have; log-odds from which on a learned word weighs as much as a built-in one.
STEMS, FULL = (4, 5, 6), 4.0
_STEM = {n: np.uint64(0xA24BAED4963EE407 * n % 2**64) for n in STEMS}
#: Labelled documents that the insults are learned from, at most.
SAMPLE = 12_000
#: Of a learned insult: least likelihood ratio (G squared) and least share of toxic uses.
LEAST_G2, LEAST_SHARE = 28.0, 0.5
#: Uses of a word that a document counts, at most: insults come in numbers, but one document must not make a word.
USES = 4


@dataclass(frozen=True)
class Transducer:
    """next[state][class] and out[state][class]; state 0 is the start, and all states are final."""

    next: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]

    def after(self, first: "Transducer") -> "Transducer":
        """The composition that reads what first reads and writes what self writes of first's output."""
        states = list(product(range(len(first.next)), range(len(self.next))))
        place = {s: i for i, s in enumerate(states)}
        step = [[(first.next[a][c], self.next[b][first.out[a][c]], self.out[b][first.out[a][c]]) for c in range(CLASSES)] for a, b in states]
        return Transducer(tuple(tuple(place[x[:2]] for x in row) for row in step), tuple(tuple(x[2] for x in row) for row in step))


def transducer(states: int, moves, writes) -> Transducer:
    """moves(state, class) and writes(state, class) as tables."""
    return Transducer(
        tuple(tuple(moves(s, c) for c in range(CLASSES)) for s in range(states)),
        tuple(tuple(writes(s, c) for c in range(CLASSES)) for s in range(states)),
    )


def grammar() -> Transducer:
    """Insult, then negation, reported speech, threat and target, as one machine."""
    # 0: nothing, 1: behind a target, 2 and on: behind the target's verb, with GAP words left and fewer
    def called(s, c):
        if c == TARGET:
            return 1
        if c == BE and s == 1:
            return 2
        return 0 if s in (0, 1) and c != NEGATION else s if c == NEGATION else 0 if s == GAP + 2 else s + 1

    insult = transducer(GAP + 3, called, lambda s, c: (INSULT if s else OTHER) if c == WEAK else c)
    # 0: nothing, up to SCOPE: words that a negation still reaches, beyond: all of the clause
    rest = SCOPE + 1

    def negated(s, c):
        if s == rest or c == NOBODY or (s and c == THINK):
            return rest
        return SCOPE if c == NEGATION else 0 if c == TARGET else max(0, s - 1)

    negation = transducer(rest + 1, negated, lambda s, c: OTHER if s and c in (INSULT, MILD, THREAT, FORCE, HOPE, DIE) else c)
    reported = transducer(2, lambda s, c: 1 if c == REPORT else s, lambda s, c: {INSULT: REPORTED, MILD: OTHER, THREAT: OTHER, FORCE: OTHER, DIE: OTHER}.get(c, c) if s else c)
    # 0: nothing, 1: self, 2: self and modal verb, 3: self and threat, 4: self and wish, 5: self, wish and target
    steps = {(1, MODAL): 2, (1, THREAT): 3, (1, HOPE): 4, (2, THREAT): 3, (2, FORCE): 3, (3, TARGET): 0, (4, TARGET): 5, (5, DIE): 0}
    threat = transducer(6, lambda s, c: 1 if c == SELF else steps.get((s, c), s), lambda s, c: MENACE if (s, c) in ((3, TARGET), (5, DIE)) else c)
    target = transducer(2, lambda s, c: 1 if c == TARGET else s, lambda s, c: AIMED if s and c == INSULT else c)
    return target.after(threat.after(reported.after(negation.after(insult))))


def clause_score(machine: Transducer, classes, parts=None) -> float:
    """The weight that the machine gives a clause; parts are the shares of the words' weights, 1 without them."""
    s, total = 0, 0.0
    for c, part in zip(classes, parts or repeat(1.0)):
        total += WEIGHTS.get(machine.out[s][c], 0.0) * part
        s = machine.next[s][c]
    return total


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(core.span_hash(data, np.array([0]), np.array([len(data)]))[0])


def lexicon(learned: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending word hashes, and their classes by language. A learned word is one in every language, but where it has a class already that isn't WEAK."""
    rows = {lang: {word_hash(w): c for c, ws in classes.items() for w in ws.split()} for lang, classes in LEXICON.items()}
    every: dict[int, int] = {}
    for row in rows.values():
        every = row | every
    rows[""] = every
    found = [rows[lang] | {h: c for h, c in (learned or {}).items() if rows[lang].get(h, WEAK) == WEAK} for lang in LANGUAGES]
    keys = np.array(sorted(set().union(*found)), np.uint64)
    return keys, np.array([[row.get(int(k), OTHER) for k in keys] for row in found], np.int8)


def language_rows(col: pa.Array | None, rows: int) -> np.ndarray:
    """Each document's row of LANGUAGES by the first letters of its language."""
    if col is None:
        return np.full(rows, len(LANGUAGES) - 1)
    return np.array([LANGUAGES.index(x) if (x := (v or "").lower().split("-")[0].split("_")[0]) in LEXICON else len(LANGUAGES) - 1 for v in col.to_pylist()], np.int64)


def lower(col: pa.Array) -> pa.Array:
    """Texts in lower case, with straight apostrophes."""
    return pc.replace_substring(pc.utf8_lower(col), "\u2019", "'")


def contracted(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the t that negates a word before its apostrophe: that of isn't, don't or can't, not that of a quoted t."""
    at = np.flatnonzero((end - start == 1) & (data[start] == ord("t")) & (start > 1))
    at = at[(data[start[at] - 1] == ord("'")) & (data[start[at] - 2] == ord("n"))]
    return at[(start[at - 1] < end[at - 1] - 1) & (end[at - 1] == start[at] - 1)]


def stems(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(places, hashes) for each length of STEMS: the words longer than that, and their stems' hashes, which differ from those of words and other stems."""
    for n in STEMS:
        long = np.flatnonzero(end - start > n)
        yield long, core.mix(core.span_hash(data, start[long], start[long] + n) ^ _STEM[n])


@dataclass(frozen=True)
class Judge:
    """A lexicon with the share of its class's weight that each word has, and the score that a document is rejected from; own has (threshold, span) of some languages."""

    keys: np.ndarray
    kinds: np.ndarray
    parts: np.ndarray
    threshold: float
    span: float
    own: dict[str, tuple[float, float]]

    @classmethod
    def of(cls, learned: dict[int, tuple[int, float]], threshold: float = THRESHOLD, span: float = SPAN, own: dict | None = None) -> "Judge":
        keys, kinds = lexicon({h: c for h, (c, _) in learned.items()})
        ours = set(lexicon()[0].tolist())
        return cls(keys, kinds, np.array([learned[k][1] if k not in ours else 1.0 for k in keys.tolist()]), threshold, span, own or {})

    def rejects(self, total: np.ndarray, length: np.ndarray, langs: pa.Array | None) -> np.ndarray:
        each = [self.own.get(v or "", (self.threshold, self.span)) for v in (langs.to_pylist() if langs is not None else [None] * len(total))]
        threshold, span = np.array(each, float).reshape(-1, 2).T
        return total >= threshold * np.maximum(1.0, length / span)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, lang, toxic) of the sample labelled documents of the least hashes; lang is null if docs have none.

    A document with several labels is toxic if one says so; a null label is none.
    """
    few = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    core.ship(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).join(F.broadcast(few), "doc_id")


def halves(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The half, 0 or 1, of each row by its least hashed three words, so that copies and most near copies are in one half."""
    g, least = np.full(len(h), np.iinfo(np.uint64).max), np.full(rows, np.iinfo(np.uint64).max)
    if len(h) > 2:
        g[:-2] = np.where(row[:-2] == row[2:], core.grams(h, 3), g[:-2])
    np.minimum.at(least, row, g)
    lone = least[row] == np.iinfo(np.uint64).max
    np.minimum.at(least, row[lone], h[lone])
    return (core.mix(least) & np.uint64(1)).astype(np.int8)


def _uses(batches):
    """(word, setting, toxic, half) of the first USES uses of each word or stem in each document; the setting is the words on both sides."""
    for batch in batches:
        toxic = np.asarray(batch["toxic"].to_numpy(zero_copy_only=False) > 0)
        for lo, hi, _, _ in core.chunks(batch["text"]):
            data, offs = core.text_bytes(lower(batch["text"].slice(lo, hi - lo)))
            h, start, end, row = core.words(data, offs, lower=False)
            if not len(h):
                continue
            before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
            after = np.concatenate([h[1:], np.zeros(1, np.uint64)])
            setting, half = core.mix(before * np.uint64(3) + after), halves(h, row, hi - lo)
            for place, word in ((np.arange(len(h)), h), *stems(data, start, end)):
                own = word ^ core.mix(row[place].astype(np.uint64))
                order = np.argsort(own, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else np.zeros(0, np.int64)
                nth = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own))))
                first = order[nth < USES]
                at = place[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.signed(word[first])), pa.array(core.signed(setting[at])), pa.array(toxic[lo:hi][row[at]]), pa.array(half[row[at]])], ["word", "setting", "toxic", "half"]
                )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[dict[int, tuple[int, float]]]:
    """Insults of the labelled documents of the first half, of the second and of all: hashes of words and stems with INSULT or MILD and the
    share of its weight, which grows with the log-odds. A use counts once for each setting, so that copies of a document are one.

    No labels, or no toxic ones, give no words. What comes to the driver is bounded by the sample's words with at least four toxic uses.
    """
    found: list[dict[int, tuple[int, float]]] = [{}, {}, {}]
    uses = labelled(docs, labels, sample).select("text", "toxic").mapInArrow(core.tidy(_uses), "word long, setting long, toxic boolean, half byte").distinct()
    counts = uses.groupBy("word").agg(*(F.count_if((F.col("toxic") == (n == "a")) & (F.col("half") == k)).alias(f"{n}{k}") for n in "ab" for k in (0, 1))).where("a0 + a1 >= 4")
    total = labelled(docs.select("doc_id", F.lit("").alias("text")), labels, sample).agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not total[0]:
        return found
    nt, nn = float(total[0]), float(max(1, total[1]))
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(a).cast("double").alias("a"), F.expr(b).cast("double").alias("b"), F.lit(n).alias("n")) for k, a, b, n in ((0, "a0", "b0", 0.5), (1, "a1", "b1", 0.5), (2, "a0 + a1", "b0 + b1", 1.0))))
    each = counts.select("word", F.explode(parts).alias("x")).select("word", "x.*").where("a >= 4")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    rate = F.lit(nt / (nt + nn))
    g2 = 2 * (a * F.log(a / ((a + b) * rate)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - rate)))).otherwise(0.0))
    odds = F.log((a + 0.5) / (n * nt + 1)) - F.log((b + 0.5) / (n * nn + 1))
    strong = each.withColumn("share", a / (a + b)).withColumn("g2", g2).withColumn("part", F.least(F.lit(1.0), odds / FULL)).where((F.col("g2") >= LEAST_G2) & (F.col("share") >= LEAST_SHARE) & (F.col("part") > 0))
    for r in strong.collect():
        found[r.k][int(np.int64(r.word).view(np.uint64))] = (INSULT if r.share >= 0.9 else MILD, r.part)
    return found


def held_out(docs: DataFrame, labels: DataFrame, first: Judge, second: Judge, sample: int = SAMPLE) -> DataFrame:
    """(lang, toxic, half, length, score) of the labelled documents, each scored by the words of the half that it isn't in."""

    def run(batches):
        machine = grammar()
        for batch in batches:
            got = [_scores(batch["text"], j, machine, batch["lang"]) for j in (second, first)]
            half = got[0][3]
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["toxic"], pa.array(half), pa.array(got[0][2]), pa.array(np.where(half == 0, got[0][0], got[1][0]))], ["lang", "toxic", "half", "length", "score"]
            )

    return labelled(docs, labels, sample).select("text", "lang", F.col("toxic") > 0).toDF("text", "lang", "toxic").mapInArrow(core.tidy(run), "lang string, toxic boolean, half byte, length long, score double")


def choose(rows: list, threshold: float = THRESHOLD) -> tuple[float, float]:
    """(threshold, span) of held-out rows: of those that lose at most MOST_LOST of the clean documents of each language and of each length, the one
    that finds the most toxic ones; if none does, the one that loses least. Of equals the first of FACTORS, then of SPANS."""
    toxic, length, score = (np.array([r[c] for r in rows]) for c in ("toxic", "length", "score"))
    if not len(rows) or not toxic.any():
        return threshold, SPAN
    lang, size = np.array([r["lang"] or "" for r in rows]), np.searchsorted(LENGTHS, length, "right")
    cells = [c for c in [~toxic & (x == v) for x in (lang, size) for v in np.unique(x)] if c.sum() >= LEAST_CELL] or [~toxic]
    best = None
    for factor in FACTORS:
        for span in SPANS:
            hit = score >= threshold * factor * np.maximum(1.0, length / span)
            lost = max(((float(hit[c].sum()) - max(1.0, MOST_LOST * c.sum())) / c.sum() for c in cells if c.any()), default=0.0)
            rank = (lost <= 0, int((hit & toxic).sum()) if lost <= 0 else -lost)
            if best is None or rank > best[0]:
                best = rank, threshold * factor, span
    return best[1], best[2]


def judge_for(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> Judge:
    """What to judge docs by; without labelled toxic documents the built-in words, threshold and SPAN. At most sample rows of numbers come to the driver."""
    first, second, every = learn(docs, labels, sample) if labels is not None else ({}, {}, {})
    if not every:
        return Judge.of({}, threshold)
    rows = held_out(docs, labels, Judge.of(first), Judge.of(second), sample).collect()
    by = {}
    for r in rows:
        by.setdefault(r["lang"] or "", []).append(r)
    enough = {v: x for v, x in by.items() if v and sum(r["toxic"] for r in x) >= LEAST_TOXIC and sum(not r["toxic"] for r in x) >= LEAST_CELL}
    return Judge.of(every, *choose(rows, threshold), {v: choose(x, threshold) for v, x in enough.items()})


def _scores(col: pa.Array, judge: Judge, machine: Transducer, langs: pa.Array | None = None):
    """Each row's score, the scored clauses of those above 0, each row's words, and its half."""
    total, found, length, half = np.zeros(len(col)), {}, np.zeros(len(col), np.int64), np.zeros(len(col), np.int8)
    lang = language_rows(langs, len(col))
    for lo, hi, _, _ in core.chunks(col):
        data, offs = core.text_bytes(lower(col.slice(lo, hi - lo)))
        h, start, end, row = core.words(data, offs, lower=False)
        if not len(h):
            continue
        length[lo:hi] = np.bincount(row, minlength=hi - lo)
        half[lo:hi] = halves(h, row, hi - lo)
        kind, part = np.full(len(h), OTHER, np.int8), np.ones(len(h))
        # The longer a stem, the more it says; a word goes before its stems.
        for place, word in (*stems(data, start, end), (np.arange(len(h)), h)):
            at = np.minimum(np.searchsorted(judge.keys, word), len(judge.keys) - 1)
            hit = np.flatnonzero(judge.keys[at] == word)
            kinds = judge.kinds[lang[lo + row[place[hit]]], at[hit]]
            hit, kinds = hit[kinds != OTHER], kinds[kinds != OTHER]
            kind[place[hit]], part[place[hit]] = kinds, judge.parts[at[hit]]
        kind[contracted(data, start, end)] = NEGATION
        hot = np.isin(kind, HOT)
        if not hot.any():
            continue
        stops = np.union1d(np.flatnonzero(np.isin(data, np.frombuffer(b".!?;\n", np.uint8))) + 1, offs)
        clause = np.searchsorted(stops, start, "right")
        for c in np.unique(clause[hot]):
            i, j = np.searchsorted(clause, [c, c + 1])
            if w := clause_score(machine, kind[i:j].tolist(), part[i:j].tolist()):
                r = lo + int(row[i])
                total[r] += w
                found.setdefault(r, []).append((w, data[start[i] : end[j - 1]].tobytes().decode(errors="replace")))
    return total, found, length, half


def scores(col: pa.Array, machine: Transducer, langs: pa.Array | None = None) -> tuple[np.ndarray, dict[int, list[tuple[float, str]]]]:
    """Each row's score by the built-in words, and the scored clauses of those above 0."""
    return _scores(col, Judge.of({}), machine, langs)[:2]


def rejected(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxicity, clauses, worst_clause) of the documents that score too much for their length.

    A null or empty text scores 0 and is kept, an empty table gives no rows; a text of any length is read whole; repeated rows are each judged, and ties need no order. clauses counts the
    scored clauses, worst_clause is the first of the highest weight, in lower case. Of other columns only lang is read, if there is
    one: it says which lexicon holds. threshold is what a document of at most SPAN words is rejected from; labels may move it and change SPAN.
    """
    core.ship(docs.sparkSession)
    by = judge_for(docs, labels, threshold, sample)

    def judge(batches):
        machine = grammar()
        for batch in batches:
            total, found, length, _ = _scores(batch["text"], by, machine, batch["lang"])
            hit = np.flatnonzero(by.rejects(total, length, batch["lang"]))
            worst = [max(found[int(r)], key=lambda x: x[0])[1] for r in hit]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(hit)), pa.array(np.round(total[hit], 3)), pa.array([len(found[int(r)]) for r in hit], pa.int32()), pa.array(worst, pa.string())],
                ["doc_id", "toxicity", "clauses", "worst_clause"],
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    return texts.mapInArrow(core.tidy(judge), "doc_id long, toxicity double, clauses int, worst_clause string")


def keep_clean(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that rejected() would list, all columns as they are; one pass without a shuffle."""
    core.ship(docs.sparkSession)
    by = judge_for(docs, labels, threshold, sample)

    def judge(batches):
        machine = grammar()
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()) if "lang" in batch.schema.names else None
            total, _, length, _ = _scores(batch.column("text"), by, machine, langs)
            yield batch.filter(pa.array(~by.rejects(total, length, langs)))

    return docs.mapInArrow(core.tidy(judge), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Rejected documents of the whole table, with insults learned from the labels."""
    return rejected(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "labels"))
