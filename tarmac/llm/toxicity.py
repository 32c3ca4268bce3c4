"""Toxic clauses by a weighted finite-state grammar.

Words become symbols by a lexicon: insults (words and word beginnings with weights learned from labels),
threats, intentions, targets, negations and words of reported speech; colons and quotation marks are symbols too.
Transducers for threats, negation, reported speech and targets are composed and read a text clause by
clause. They are weighted and have alternatives: an attack stands alone, or promises that a target follows. The
weight of the best accepting path (the sum of its attacks' weights times the factors of its arcs) is the
clause's score. A document's score is a logistic function of its clauses' scores, fitted to the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.batches import mapped, slices
from tarmac.llm.storage import dropped, free_name, written

#: Labelled rows that the model is learned from, at most (those of the lowest hash).
TRAIN_ROWS = 20_000
#: Lengths of the word beginnings that may be learned; evidence that a term needs.
STEMS, LEAST_ROWS, LEAST_ODDS = range(3, 9), 3, 2.0
#: G squared that a term needs: a share of the toxic rows learned from, as a term of few rows can have no more, within bounds.
G2_SHARE, G2_BOUNDS = 0.4, (10.0, 30.0)
#: Terms that a task counts before it passes them on.
HELD_TERMS = 500_000

#: Symbols of the grammar; Y is the one addressed, P an intention, C a colon, Q a quotation mark.
INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, COLON, QUOTE, OTHER = "ITYNRPCQO"
WORDS = {
    THREAT: "kill hurt destroy strangle stab shoot murder beat töten umbringen vernichten schlagen tuer détruire frapper matar destruir golpear",
    INTENT: "will ll gonna going shall must should werde werden wirst soll sollte vais va allons vas devrait voy vamos debería",
    TARGET: "you your yours yourself u du dich dir dein deine euch euer tu te toi ton votre vous tú ti usted ustedes vuestro",
    NEGATION: "not no never neither nor isn aren wasn don doesn didn won nicht kein keine niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say called calls calling told wrote writes quoted claims claimed sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió",
}
_FIXED = {w: (s, 1.0) for s, words in WORDS.items() for w in words.split()} | {":": (COLON, 0.0)} | {q: (QUOTE, 0.0) for q in '"“”„«»'}
_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN, _GAP = re.compile(r'\w+|[:"“”„«»]'), re.compile(r"\W+")
_WORD = re.compile(r"\w+")
#: Symbols out of the machine that count: attacks, negated, reported, and negated in reported speech; in pairs, aimed and alone.
ATTACKS = "IiTtJjKk"


@dataclass
class Transducer:
    """A weighted transducer: arcs (state, symbol) -> alternatives (state, symbol out, factor of the symbol's weight).

    A symbol without an arc goes through unchanged, to the state that ``otherwise`` names. A path may end in
    any state outside ``open_states``.
    """

    arcs: dict = field(default_factory=dict)
    otherwise: dict = field(default_factory=dict)
    open_states: frozenset = frozenset()
    start: object = 0

    def steps(self, state, symbol) -> list[tuple]:
        return self.arcs.get((state, symbol)) or [(self.otherwise.get(state, state), symbol, 1.0)]

    def accepts(self, state) -> bool:
        return state not in self.open_states


@dataclass
class Composed:
    """What the first puts out is read by the second. States are pairs, made as they are met and kept."""

    first: object
    second: object
    _seen: dict = field(default_factory=dict)

    @property
    def start(self):
        return self.first.start, self.second.start

    def steps(self, state, symbol) -> list[tuple]:
        found = self._seen.get((state, symbol))
        if found is None:
            found = [((a, b), out, u * v) for a, mid, u in self.first.steps(state[0], symbol) for b, out, v in self.second.steps(state[1], mid)]
            self._seen[state, symbol] = found
        return found

    def accepts(self, state) -> bool:
        return self.first.accepts(state[0]) and self.second.accepts(state[1])


def grammar(scope: int = 4, intent: int = 4, bare: float = 0.4, negated: float = 0.4, reported: float = 0.6, alone: float = 0.7):
    """Threats, then negation, then reported speech, then targets.

    A threat word weighs in full within ``intent`` words of an intention, else ``bare``. Negation holds for
    ``scope`` words: I and T become i and t. Reported speech holds from its word to the end of the clause,
    over a colon, and where a quotation mark follows up to the next one: I, i, T, t become J, j, K, k. An
    attack before which no target stands is ``alone``, or waits for a target, without which no path ends.
    """
    threat = Transducer(otherwise={k: max(k - 1, 0) for k in range(intent + 1)})
    negation = Transducer(otherwise={k: max(k - 1, 0) for k in range(scope + 1)})
    for k in range(intent + 1):
        threat.arcs[k, INTENT] = [(intent, INTENT, 1.0)]
        threat.arcs[k, THREAT] = [(max(k - 1, 0), THREAT, 1.0 if k else bare)]
    for k in range(scope + 1):
        negation.arcs[k, NEGATION] = [(scope, NEGATION, 1.0)]
        if k:
            negation.arcs[k, INSULT] = [(k - 1, "i", negated)]
            negation.arcs[k, THREAT] = [(k - 1, "t", negated)]
    # states: plain, reported, reported within quotation marks
    report = Transducer(arcs={(0, REPORT): [(1, REPORT, 1.0)], (1, QUOTE): [(2, QUOTE, 1.0)], (2, QUOTE): [(0, QUOTE, 1.0)]})
    for state in (1, 2):
        for said, out in zip("IiTt", "JjKk", strict=True):
            report.arcs[state, said] = [(state, out, reported)]
    # states: nothing, a target was read, a target is promised
    target = Transducer(open_states=frozenset({2}))
    for state in range(3):
        target.arcs[state, TARGET] = [(1, TARGET, 1.0)]
        for attack in ATTACKS:
            target.arcs[state, attack] = [(state, attack, 1.0)] if state else [(0, attack, alone), (2, attack, 1.0)]
    return Composed(Composed(Composed(threat, negation), report), target)


def quoted(state) -> bool:
    """Whether a state of ``grammar`` lies within a reported quotation."""
    return state[0][1] == 2


def in_quotation(machine) -> object:
    """The state of ``machine`` at the beginning of a clause that a reported quotation goes on in."""
    (pair, _), target = machine.start
    return (pair, 2), target


def best_path(machine, state, symbols: list[tuple[str, float]]) -> tuple[float, str, object]:
    """(weight, symbols out, state) of the best accepting path; ties go to the least symbols out."""
    live = {state: (0.0, "")}
    for symbol, weight in symbols:
        new: dict = {}
        for at, (total, made) in live.items():
            for to, out, factor in machine.steps(at, symbol):
                found = (total + weight * factor, made + out) if out in ATTACKS else (total, made if out in "OPCQ" else made + out)
                old = new.get(to)
                if old is None or (-found[0], found[1]) < (-old[0], old[1]):
                    new[to] = found
        live = new
    return min(((total, made, at) for at, (total, made) in live.items() if machine.accepts(at)), key=lambda x: (-x[0], x[1]))


class Scorer:
    """Finds the clauses of a text that the grammar weighs, through one scan for the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.exact = dict(_FIXED)
        self.stems: dict[str, float] = {}
        scan = ahocorasick.Automaton()
        for w in WORDS[THREAT].split():
            scan.add_word(f" {w} ", 1)
        for term, weight in lexicon.items():
            if term.endswith("$"):
                self.exact[term[:-1]] = (INSULT, weight)
                scan.add_word(f" {term[:-1]} ", 1)
            else:
                self.stems[term] = weight
                scan.add_word(f" {term}", 1)
        scan.make_automaton()
        self.scan, self.lengths, self.machine = scan, sorted({len(s) for s in self.stems}, reverse=True), grammar()

    def symbol(self, word: str) -> tuple[str, float]:
        if found := self.exact.get(word):
            return found
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        return OTHER, 0.0

    def clauses(self, text: str) -> list[tuple[int, int, float, str]]:
        """(start, end, score, symbols out) of the clauses with an attack. A reported quotation goes on into the next sentence, but not into the next line."""
        if next(self.scan.iter(f" {_GAP.sub(' ', text.lower())} "), None) is None:
            return []
        out, inside, end = [], False, 0
        for m in _CLAUSE.finditer(text):
            inside = inside and "\n" not in text[end : m.start()]
            end = m.end()
            symbols = [self.symbol(word) for word in _TOKEN.findall(m[0].lower())]
            kinds = {s for s, _ in symbols}
            attack = INSULT in kinds or THREAT in kinds
            if not attack and QUOTE not in kinds:
                continue
            total, made, state = best_path(self.machine, in_quotation(self.machine) if inside else self.machine.start, symbols)
            inside = quoted(state)
            if attack:
                out.append((m.start(), m.end(), total, made))
        return out


def document_features(clauses: list, length: int) -> list[float]:
    """Sum, peak, plain, negated, reported and threatening clauses, and the sum against the length."""
    total = sum(c[2] for c in clauses)
    kinds = Counter(k for _, _, _, s in clauses for k in ("n" if set(s) & set("itjk") else "r" if set(s) & set("JK") else "p", *("t" if set(s) & set("TK") else "")))
    return [math.log1p(total), max((c[2] for c in clauses), default=0.0), *(math.log1p(kinds[k]) for k in "pnrt"), math.log1p(1000 * total / (length + 200))]


#: Weights before labels are seen, for the features in order and the intercept; how strongly they hold.
PRIOR = [0.3, 0.2, 0.3, 0.0, 0.1, 0.5, 0.3, -2.2]
PRECISION = [0.5, 0.5, 0.5, 1.0, 1.0, 1.0, 0.5, 0.05]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    weights: list[float]

    def score(self, df: DataFrame, text_col: str = "text", score_col: str = "toxicity", spans_col: str | None = None) -> DataFrame:
        """``df`` with a score from 0 to 1 of each whole text and, if named, the matched clauses with their patterns.

        A null or empty text has no clauses. Rows are scored one by one: ids may repeat or be null. A
        column called ``score_col`` is kept; the new one then gets trailing underscores, as its schema shows.
        """
        import pyarrow as pa

        names = [free_name(df.columns, score_col)]
        schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.DoubleType())])
        kinds = [pa.float64()]
        if spans_col:
            names.append(free_name([*df.columns, *names], spans_col))
            clause = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("pattern", T.StringType())])
            schema = schema.add(names[1], T.ArrayType(clause))
            kinds.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("pattern", pa.string())])))
        at, lexicon, weights = df.columns.index(text_col), self.lexicon, self.weights

        def run(batches: Iterator) -> Iterator:
            scorer = Scorer(lexicon)
            for b in slices(batches):
                scores, spans = [], []
                for text in b.column(at).to_pylist():
                    found = scorer.clauses(text or "")
                    z = weights[-1] + sum(w * x for w, x in zip(weights, document_features(found, len(text or "")), strict=False))
                    scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                    if spans_col:
                        spans.append([dict(zip(("start", "end", "score", "pattern"), f, strict=True)) for f in found])
                new = [pa.array(v, k) for v, k in zip((scores, spans), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

        return mapped(df, run, schema)


def held_out(doc_id="doc_id"):
    """Whether a row's label is kept from learning: crc32 of the id as text is divisible by 5 (a null id: kept)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` labelled rows that may be learned from, by the hash of the id, with their columns of ``docs``.

    Of labels that contradict each other the higher holds; of rows that repeat an id the least is learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_id")
    found = docs.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id").agg(F.min(F.struct("_label", *columns)).alias("_row")).select("_row.*")


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


def term_counts(sample: DataFrame) -> DataFrame:
    """term, pos, neg: rows of either label that hold the term, counted by task and then summed; the term null counts the rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[k] for n in counts.values()], pa.int64()) for k in (1, 0))], ["term", "pos", "neg"])
            counts.clear()
            return made

        for b in slices(batches):
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for term in (*_terms(text or ""), None):
                    counts.setdefault(term, [0, 0])[label > 0] += 1
            if len(counts) > HELD_TERMS:
                yield out()
        yield out()

    return mapped(sample, run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def least_g2(n_pos: int) -> float:
    return min(max(G2_SHARE * n_pos, G2_BOUNDS[0]), G2_BOUNDS[1])


def with_evidence(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """term, pos, odds: the terms with enough rows, log odds and G squared, of ``term_counts``."""
    total = float(n_pos + n_neg)
    have = F.col("pos") + F.col("neg")
    cells = (("pos", n_pos, have), ("neg", n_neg, have), (n_pos - F.col("pos"), n_pos, total - have), (n_neg - F.col("neg"), n_neg, total - have))
    g2 = F.lit(0.0)
    for seen, row, column in cells:
        seen = F.col(seen) if isinstance(seen, str) else seen
        g2 = g2 + F.when(seen > 0, 2 * seen * F.log(seen * total / (F.lit(float(row)) * column))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.25) / (n_pos + 0.5)) - F.log((F.col("neg") + 0.25) / (n_neg + 0.5))
    kept = counts.where(F.col("term").isNotNull() & (F.col("pos") >= LEAST_ROWS)).withColumns({"odds": odds, "_g2": g2})
    return kept.where((F.col("odds") >= LEAST_ODDS) & (F.col("_g2") >= least_g2(n_pos))).select("term", "pos", "odds")


def choose_terms(found: list[tuple[str, int, float]]) -> dict[str, float]:
    """Of terms with evidence (term, rows, log odds), those that say more than others, and their weights.

    Of beginnings that mark the same rows the longest stands, and a longer one is kept beside its own
    beginning only if it weighs more.
    """
    odds = {term: (min(lo, 8.0), pos) for term, pos, lo in sorted(found)}
    longer: Counter = Counter()
    for term, (_, pos) in odds.items():
        for n in STEMS:
            if n < len(term) and term[:n] in odds and term[:n] != term:
                longer[term[:n]] = max(longer[term[:n]], pos)
    closed = {t: v for t, v in odds.items() if longer[t] < 0.97 * v[1]}
    out: dict[str, float] = {}
    for term in sorted(closed, key=len):
        over = [out[term[:n]] for n in STEMS if n < len(term) and term[:n] in out]
        if not over or closed[term][0] > max(over) + 0.5:
            out[term] = closed[term][0]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "toxic") -> ToxicityModel:
    """Lexicon and weights from at most ``rows`` labelled rows that are not held out.

    Neither ids nor other columns than the text are inputs. Without labels of both kinds the lexicon is
    empty and the prior weights stand.
    """
    import numpy as np

    from tarmac.llm.logistic import fit

    sample = written(labelled_sample(docs, labels, label, ["text"], rows))
    counts = written(term_counts(sample))
    total = counts.where("term is null").first()
    lexicon: dict[str, float] = {}
    if total and total["pos"] and total["neg"]:
        lexicon = choose_terms([tuple(r) for r in with_evidence(counts, total["pos"], total["neg"]).collect()])
    dropped(counts)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(lexicon)
        for b in slices(batches):
            x = [document_features(scorer.clauses(t or ""), len(t or "")) for t in b.column(1).to_pylist()]
            y = [float(v > 0) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(7)), pa.array(y, pa.float64())], list("abcdefgy"))

    rows = mapped(sample, features, ", ".join(f"{c} double" for c in "abcdefgy")).collect()
    found = np.array(sorted(map(tuple, rows)), dtype=float).reshape(-1, 8)
    dropped(sample)
    weights = fit(found[:, :7], found[:, 7], np.array(PRIOR), np.array(PRECISION))
    return ToxicityModel(lexicon, [float(w) for w in weights])


def op2_clause_grammar_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text's toxicity; labels of held-out rows are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs, score_col="score").drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
