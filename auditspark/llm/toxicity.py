"""Operator 3: toxicity by a weighted finite-state pattern grammar.

Texts are cut into clauses.  A clause's words are read as symbols: other word,
target (address and naming of people), negation, reporting verb, modal verb,
insult, threat.  Five transducers rewrite that line one after the other:

* insult marks insults;
* threat marks threats, by a smaller weight where no modal verb is in reach;
* target marks those that come after a target, and a target that comes after one;
* negation marks those in reach of a negation;
* reported speech marks those that come after a reporting verb.

``compose`` makes one machine of the five: a table of states and arcs, where an
arc's weight is the product of the weights it is made of.  The machine reads a
clause once; every mark that comes out is an event with its whole context (say, a
negated insult of a target), and the clause scores the sum over its events of the
word's weight, the arc's weight and the learned weight of that pattern.  Words
that are in no lexicon mark nothing.

The lexicon and the pattern weights are learned from labelled rows of the
training fold; no word of the lexicon is given.  What is counted for a word is
families of texts that hold it (texts with one least hash of their word triples),
so that the copies and near copies of one text count about once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from auditspark.llm.common import few_rows, fold, quoted, sampled, ship, table, written

#: Labelled rows that the model is fitted on, at most (about).
FIT_ROWS = 20_000
#: Log-likelihood ratio from which a word enters the lexicon, and the log odds it needs besides.
EVIDENCE = 24.0
WEIGHT = 3.0
#: Letters of a stem.
STEMS = (8, 7, 6, 5, 4)
#: Words that a worker remembers as being in no lexicon.
REMEMBER = 200_000
#: Words that a negation and a modal verb reach over.
REACH = 4
MODAL_REACH = 2
#: A lexicon word is a threat if in this share of its toxic families it follows a modal verb and comes before a target.
AIMED = 0.5

# Closed-class words of English, German, French and Spanish.
TARGET = frozenset(
    "you your yours yourself u ur he she they him her them his their this that these those who people everyone "
    "du dich dir dein deine ihr euch euer sie ihnen er diese dieser leute alle "
    "tu toi ton ta tes vous votre vos il elle ils elles ce cette ces gens "
    "tú ti tu tus usted ustedes vosotros él ella ellos ellas ese esa esos gente".split()
)
NEGATION = frozenset("not no never nor isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split())
REPORTED = frozenset(
    "said says say saying told called calls wrote writes quoted quote claimed claims alleged according "
    "sagte sagt sagen nannte nennt schrieb zitierte laut dit disait appelé appelle écrit selon dijo dice llamó llama escribió según".split()
)
MODAL = frozenset("will would shall should must may might can could going gonna want wanna werde wirst wird werden soll sollte muss kann vais vas va veux dois peux voy vas quiero debo puedo".split())

_MARKS = ",;:!?()[]{}\"«»“”„|#$%&*"
_ENDS = ".;!?\n"


def clauses(text: str) -> list[list[str]]:
    """Lower-cased words of each clause."""
    text = text.lower()
    for c in _ENDS:
        text = text.replace(c, " \n ")
    for c in _MARKS:
        if c not in _ENDS:
            text = text.replace(c, " ")
    return [words for line in text.split("\n") if (words := line.split())]


# --- transducers

WORDS = ("word", "target", "negation", "reported", "modal", "insult", "threat")


@dataclass
class Transducer:
    """State 0 is the start and every state accepts.  ``arcs`` has, for each state
    and symbol, the next state, the symbol that comes out and the weight."""

    symbols: tuple[str, ...]
    arcs: dict[tuple[int, str], tuple[int, str, float]]

    def run(self, line: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """What comes out for a line of weighted symbols."""
        state, out = 0, []
        for symbol, weight in line:
            state, symbol, own = self.arcs[state, symbol]
            out.append((symbol, weight * own))
        return out

    def output(self) -> tuple[str, ...]:
        return tuple(sorted({out for _, out, _ in self.arcs.values()}))


def machine(symbols, states: int, arc) -> Transducer:
    """The transducer whose arcs are ``arc(state, symbol)``."""
    return Transducer(tuple(symbols), {(q, x): arc(q, x) for q in range(states) for x in symbols})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does what ``second`` does to what comes out of ``first``."""
    number, open_, arcs = {(0, 0): 0}, [(0, 0)], {}
    while open_:
        pair = open_.pop()
        for x in first.symbols:
            p, middle, a = first.arcs[pair[0], x]
            q, out, b = second.arcs[pair[1], middle]
            if (p, q) not in number:
                number[p, q] = len(number)
                open_.append((p, q))
            arcs[number[pair], x] = (number[p, q], out, a * b)
    return Transducer(first.symbols, arcs)


def _mark(symbol: str) -> bool:
    return symbol[:1] in "IH"


def cascade() -> list[Transducer]:
    """The five transducers.  Marks begin with I (insult) or H (threat); ``+``, ``-``
    and ``"`` are added for a target, a negation and reported speech; T is a target
    that comes after a mark."""
    insult = machine(WORDS, 1, lambda q, x: (0, "I" if x == "insult" else x, 1.0))
    threat = machine(insult.output(), MODAL_REACH + 2, lambda q, x: (MODAL_REACH + 1 if x == "modal" else max(q - 1, 0), "H" if x == "threat" else x, 0.75 if x == "threat" and not q else 1.0))

    def aim(q, x):  # 1: a target came; 2: a mark came, and no target yet
        if x == "target":
            return (1, "T" if q == 2 else "word", 0.25 if q == 2 else 1.0)
        return (q or 2, x + "+", 1.25) if _mark(x) and q == 1 else (2, x, 1.0) if _mark(x) else (q, x, 1.0)

    target = machine(threat.output(), 3, aim)
    negation = machine(target.output(), REACH + 2, lambda q, x: (REACH + 1 if x == "negation" else max(q - 1, 0), x + "-" if _mark(x) and q else x, 0.4 if _mark(x) and q else 1.0))
    reported = machine(negation.output(), 2, lambda q, x: (1 if x == "reported" else q, x + '"' if _mark(x) and q else x, 0.5 if _mark(x) and q else 1.0))
    return [insult, threat, target, negation, reported]


def composed() -> Transducer:
    first, *rest = cascade()
    for t in rest:
        first = compose(first, t)
    return first


#: What may come out besides plain words.
PATTERNS = tuple(x for x in composed().output() if _mark(x) or x == "T")
_CLASSES = [(w, k) for k, words in (("modal", MODAL), ("reported", REPORTED), ("negation", NEGATION), ("target", TARGET)) for w in words]


def entries(word: str) -> list[str]:
    """What of a lexicon would accept a word, the closest first: itself, then its stems."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@dataclass
class Grammar:
    """Lexicon, weights of the composed machine's patterns, and the final score."""

    insult: dict[str, float]
    threat: dict[str, float]
    pattern: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 1.0
    silent: float = 0.05

    def __post_init__(self):
        self.pattern = dict.fromkeys(PATTERNS, 1.0) | self.pattern
        self.lexicon = dict.fromkeys(self.insult, "insult") | dict.fromkeys(self.threat, "threat")
        self.weight: dict[str, float] = {}  # of the words met so far that the lexicon accepts
        self.clean: set[str] = set()
        number = {x: i for i, x in enumerate(WORDS)}
        self.number, self.symbol = number, {w: number[k] for w, k in _CLASSES}
        at = {x: i for i, x in enumerate(PATTERNS)}
        self.table = {}
        for (q, x), (to, out, weight) in composed().arcs.items():
            self.table[q * len(WORDS) + number[x]] = (to * len(WORDS), at.get(out), weight)

    def _holds(self, words: list[str]) -> bool:
        """Whether the lexicon accepts a word of a clause; words are looked up once."""
        if self.clean.issuperset(words):
            return False
        found = False
        for w in words:
            if w in self.weight:
                found = True
            elif w not in self.clean:
                entry = next((e for e in entries(w) if e in self.lexicon), None) if w not in self.symbol else None
                if entry is None:
                    self.clean.add(w)
                    continue
                found, kind = True, self.lexicon[entry]
                self.weight[w] = (self.insult if kind == "insult" else self.threat)[entry]
                self.symbol[w] = self.number[kind]
        return found

    def events(self, words: list[str]):
        """(number of the pattern, weight) of each event of a clause."""
        if not self._holds(words):
            return
        state, symbol, table, last = 0, self.symbol, self.table, 0.0
        for w in words:
            state, pattern, weight = table[state + symbol.get(w, 0)]
            if pattern is not None:
                last = self.weight.get(w, last)  # a late target bears the weight of the word before it
                yield pattern, weight * last

    def sums(self, text: str | None) -> tuple[list[float], list[float]]:
        """Events and their weights by pattern; each distinct clause counts once."""
        n, weight = [0.0] * len(PATTERNS), [0.0] * len(PATTERNS)
        seen = set()
        if len(self.clean) > REMEMBER:
            self.clean = set()
        for words in clauses(text or ""):
            if not self.clean.issuperset(words) and (key := tuple(words)) not in seen:
                seen.add(key)
                for pattern, w in self.events(words):
                    n[pattern] += 1
                    weight[pattern] += w
        return n, weight

    def evidence(self, text: str | None) -> float:
        return sum(w * self.pattern[p] for p, w in zip(PATTERNS, self.sums(text)[1], strict=True) if w) if text else 0.0

    def score(self, evidence: float) -> float:
        if evidence <= 0:
            return self.silent
        x = self.bias + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -30 else 0.0


# --- fitting


def labelled(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """``text``, ``toxic`` of at most about ``bound`` rows of the training fold.
    Of several labels of one doc_id the largest counts."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    train = sampled(train, "doc_id", bound)
    # The sample is bounded by a parameter, so it may be broadcast.
    return docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "toxic")


def _family(words: list[str]) -> int:
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def _aimed(words: list[str]) -> set[str]:
    """Words of a clause that follow a modal verb and come before a target."""
    modal = [i for i, w in enumerate(words) if w in MODAL]
    target = {i for i, w in enumerate(words) if w in TARGET}
    return {words[k] for i in modal for k in range(i + 1, min(len(words), i + 2 + MODAL_REACH)) if not target.isdisjoint(range(k + 1, k + 3))} if modal and target else set()


def _family_words(batches):
    """word, toxic, family, aimed of each word and stem of a text; the empty word stands for the text."""
    for b in few_rows(batches):
        word, label, family, aimed = [], [], [], []
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            parts = clauses(text)
            words = [w for c in parts for w in c]
            at = {e for w in set().union(*map(_aimed, parts)) for e in entries(w)}
            one = ["", *sorted({e for w in set(words) for e in entries(w)})]
            word += one
            label += [toxic] * len(one)
            family += [_family(words)] * len(one)
            aimed += [int(w in at) for w in one]
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(label, pa.int32()), pa.array(family, pa.int64()), pa.array(aimed, pa.int32())], ["word", "toxic", "family", "aimed"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Grammar:
    """Learn lexicon, pattern weights and calibration from the training fold.

    All words that pass ``EVIDENCE`` and ``WEIGHT`` enter the lexicon; closed-class
    words do not.  Without any usable label it is empty, and all texts get the
    same score.
    """
    ship(docs.sparkSession)
    train = written(labelled(docs, labels, bound), "toxic-train")
    seen = train.mapInArrow(_family_words, "word string, toxic int, family long, aimed int").groupBy("word", "toxic", "family").agg(F.max("aimed").alias("aimed"))
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("m"), F.sum(F.col("aimed") * F.col("toxic")).alias("aimed"))
    counts = written(counts, "toxic-words")
    total = counts.where("word = ''").first()
    n1, n0 = (total["k"], total["m"]) if total else (0, 0)
    if not (n1 and n0):
        return Grammar({}, {})
    p = n1 / (n1 + n0)
    k, m = F.col("k").cast("double"), F.col("m").cast("double")
    ratio = 2 * (F.when(k > 0, k * F.log(k / ((k + m) * p))).otherwise(0) + F.when(m > 0, m * F.log(m / ((k + m) * (1 - p)))).otherwise(0))
    weight = F.log((k + 0.5) / (n1 + 1) / ((m + 0.5) / (n0 + 1)))
    strong = counts.where("word <> ''").where((ratio >= EVIDENCE) & (weight >= WEIGHT)).select("word", weight.alias("weight"), (F.col("aimed") >= AIMED * k).alias("threat"))
    insult, threat = {}, {}
    for r in strong.collect():  # words of the fitting sample that are rare among its clean texts
        if r["word"] not in TARGET | NEGATION | REPORTED | MODAL:
            (threat if r["threat"] else insult)[r["word"]] = r["weight"]
    return _calibrated(Grammar(insult, threat), train)


def _calibrated(grammar: Grammar, train: DataFrame) -> Grammar:
    """Pattern weights from the patterns' rates in toxic and clean texts, then a
    logistic curve from evidence to probability; both from one pass of the machine."""

    def run(batches):
        for b in few_rows(batches):
            n, weight = zip(*(grammar.sums(t) for t in b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(n, pa.list_(pa.float64())), pa.array(weight, pa.list_(pa.float64()))], ["toxic", "n", "weight"])

    rows = written(train.mapInArrow(run, "toxic int, n array<double>, weight array<double>"), "toxic-events")
    rates = rows.groupBy("toxic").agg(*[F.sum(F.get("n", F.lit(i))).alias(str(i)) for i in range(len(PATTERNS))]).collect()
    pattern = {}
    for i, name in enumerate(PATTERNS):
        of = {r["toxic"]: r[str(i)] or 0.0 for r in rates}
        # Between the arc's own weight (no event seen) and the share of such events that stand in toxic texts.
        pattern[name] = (20 + 1.25 * of.get(1, 0.0)) / (20 + sum(of.values()))
    evidence = sum((F.get("weight", F.lit(i)) * pattern[name] for i, name in enumerate(PATTERNS)), F.lit(0.0))
    bins = rows.select(F.round(evidence, 1).alias("e"), "toxic").groupBy("e").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()  # at most a bin per sampled row
    none = [r for r in bins if r["e"] <= 0]
    some = [r for r in bins if r["e"] > 0]
    silent = (sum(r["k"] for r in none) + 1) / (sum(r["n"] for r in none) + 20)
    x, n, k = (np.array([r[c] for r in some] or [0.0], dtype=float) for c in ("e", "n", "k"))
    a, s = -2.0, 1.0
    for _ in range(50):  # Newton steps on a logistic fit with a weak prior that keeps separable data finite
        q = 1 / (1 + np.exp(-np.clip(a + s * x, -30, 30)))
        gradient = np.array([np.sum(k - n * q) - 0.5 * (a + 2), np.sum((k - n * q) * x) - 0.5 * (s - 1)])
        w = n * q * (1 - q)
        hessian = np.array([[w.sum() + 0.5, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.5]])
        a, s = np.array([a, s]) + np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return Grammar(grammar.insult, grammar.threat, pattern, float(a), float(max(s, 0.05)), float(min(silent, 0.45)))


def score(docs: DataFrame, grammar: Grammar, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the named columns) with ``score`` and ``predicted``.

    Null and empty texts, and texts without an event, get the grammar's base score;
    a score of 0.5 is predicted 1.  Texts of any length are read whole.  Repeated
    rows each get a row, an empty table gives an empty result.  Columns of these
    two names are replaced, all others stay.
    """
    ship(docs.sparkSession)
    names = [c for c in columns or docs.columns if c.lower() not in ("score", "predicted")]
    at = _text_at(names)
    kept = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])

    def apply(batches):
        for b in few_rows(batches):
            found = pa.array([grammar.score(grammar.evidence(t)) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "score"])

    out = kept.mapInArrow(apply, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).toDF(*names, "score", "predicted")


def _text_at(names: list[str]) -> int:
    return [c.lower() for c in names].index("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows that the fitted grammar scores 0.5 or more, columns
    as they were.  Every row is judged by its own text, whatever its doc_id."""
    ship(docs.sparkSession)
    grammar = fit(docs, labels, bound)
    at = _text_at(docs.columns)
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def apply(batches):
        for b in few_rows(batches):
            yield b.filter(pa.array([grammar.score(grammar.evidence(t)) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return kept.mapInArrow(apply, kept.schema).toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    grammar = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, grammar, ["doc_id", "text"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
