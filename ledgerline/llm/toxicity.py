"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon and weights learnt from labels."""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workers import Cache, map_batches, once, share
from ledgerline.session import durable

#: The sample that lexicon and weights are learnt from: rows per label.
SAMPLE_ROWS = 6_000
#: Entries of the lexicon, their least log odds, and how far a likelihood ratio has to exceed what chance gives among all candidates.
LEXICON = 20_000
LEAST_ODDS = 2.5
BEYOND_CHANCE = 8.0
STEMS = (4, 5, 6)
CACHE_WORDS = 200_000

# Fixed word lists of the grammar in four languages.
TARGETS = frozenset("you your yourself he she they him them his her du dich dir ihr euch er sie ihn tu te toi vous il elle ils elles tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nor neither isn't aren't don't doesn't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni tampoco".split())
REPORTS = frozenset("said says say told claims claimed wrote called quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
THREATS = frozenset("kill murder hurt destroy strangle stab shoot umbringen töten erschlagen verprügeln tuer frapper étrangler matar golpear degollar".split())

WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:,\n]|[\"“”„«»]")
ENDS, QUOTES = frozenset(".!?;:,\n"), frozenset("\"“”„«»")

#: Kinds of matched clauses and the weights they have before labels are seen: constant, per kind, the number of matches.
KINDS = ("insult", "targeted", "negated", "reported", "threat")
PRIOR = np.array([-3.0, 1.5, 2.0, 0.3, 0.6, 2.0, 1.0])


@dataclass(frozen=True)
class Machine:
    """A transducer over token classes: ``moves`` maps (state, class) to a state; other classes lead to ``rest[state]``."""

    moves: dict[tuple[int, str], int]
    rest: tuple[int, ...]

    def step(self, state: int, sign: str) -> int:
        return self.moves.get((state, sign), self.rest[state])


#: A negation reaches over the next three words.
NEGATION = Machine({(s, "not"): 3 for s in range(4)}, (0, 0, 1, 2))
#: From a verb of saying or a quotation mark on, what the clause says is reported.
REPORT = Machine({(s, sign): 1 for s in range(2) for sign in ("report", "quote")}, (0, 1))
#: Whether the clause speaks of somebody.
TARGET = Machine({(s, "target"): 1 for s in range(2)}, (0, 1))


class Grammar:
    """The machines composed: their states move together, and insults and threats are put out with the state they meet."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.insult = Cache(self._insult, CACHE_WORDS)
        self.table: dict[tuple[int, int, int, str], tuple[int, int, int]] = {}

    def _insult(self, word: str) -> float:
        """The largest weight of the word or its stems; -1 marks a threat, 0 a word without interest."""
        if word in THREATS:
            return -1.0
        get = self.lexicon.get
        return max(get("=" + word, 0.0), *(get(word[:n], 0.0) if len(word) > n else 0.0 for n in STEMS))

    def sign(self, word: str) -> str:
        if word in TARGETS:
            return "target"
        if word in NEGATIONS:
            return "not"
        if word in REPORTS:
            return "report"
        return "quote" if word in QUOTES else "word"

    def _move(self, state: tuple[int, int, int], sign: str) -> tuple[int, int, int]:
        key = (*state, sign)
        if key not in self.table:
            self.table[key] = (NEGATION.step(state[0], sign), REPORT.step(state[1], sign), TARGET.step(state[2], sign))
        return self.table[key]

    def matches(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        """(begin, end, kind, weight) of every clause with an insult or a threat, one for each of them."""
        if not any(map(self.insult.__getitem__, map(str.lower, WORDS.findall(text)))):
            return
        begin, state, met = 0, (0, 0, 0), []
        for found in TOKENS.finditer(text):
            word = found[0].lower()
            if word in ENDS:
                yield from self._close(begin, found.end(), state, met)
                begin, state, met = found.end(), (0, 0, 0), []
                continue
            weight = self.insult[word]
            if weight:
                met.append((weight, state[0] > 0, state[1] > 0))
            state = self._move(state, self.sign(word))
        yield from self._close(begin, len(text), state, met)

    def _close(self, begin: int, end: int, state: tuple[int, int, int], met: list) -> Iterator[tuple[int, int, str, float]]:
        """A clause's end decides: a threat needs somebody it is about, an insult is stronger with one."""
        for weight, negated, reported in met:
            if weight < 0:
                if state[2] and not negated and not reported:
                    yield begin, end, "threat", 1.0
            else:
                yield begin, end, "negated" if negated else "reported" if reported else "targeted" if state[2] else "insult", weight


def clause_features(found: list[tuple[int, int, str, float]]) -> list[float]:
    """Per kind log(1 + the sum of the weights of its matches), and the logarithm of the number of matches."""
    sums = dict.fromkeys(KINDS, 0.0)
    for _, _, kind, weight in found:
        sums[kind] += weight
    return [*(math.log1p(sums[kind]) for kind in KINDS), math.log(max(len(found), 1))]


def fit_weights(rows: np.ndarray, toxic: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, held near the grammar's own (PRIOR) where labels say nothing."""
    inputs = np.hstack([np.ones((len(rows), 1)), rows])
    weights, hold = PRIOR.copy(), 0.5
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (importance * (toxic - chance)) - hold * (weights - PRIOR)
        curve = (inputs * (importance * chance * (1 - chance))[:, None]).T @ inputs + hold * np.eye(len(PRIOR))
        change = np.linalg.solve(curve, slope)
        weights += change
        if np.abs(change).max() < 1e-9:
            break
    return weights


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of about ``rows`` rows of each label, chosen by a hash of the id, and the part of each label that was taken."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where(learn).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = durable(texts.select("id").distinct().join(marks, "id"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = {label: min(1.0, rows / n) for label, n in counts.items()}
    wanted = F.lit(False)
    for label, share_ in part.items():
        wanted = wanted | ((F.col("toxic") == label) & (draw < share_))
    # at most 4 * rows ids, so they are sent to the texts and no text is shuffled
    chosen = F.broadcast(known.where(wanted).limit(4 * rows))
    return durable(texts.join(chosen, "id").select("id", "text", "toxic")), part


def _stems(length: int) -> Column:
    """The first letters of all longer words."""
    return F.transform(F.filter("words", lambda w: F.char_length(w) > length), lambda w: F.substring(w, 1, length))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic texts of the sample have far oftener than others, with their log odds.

    A candidate stays if its likelihood ratio is beyond what the best of so many candidates reaches by chance.
    Copies would make any of their words look telling, so of texts with the same least hash of
    three-word shingles one is counted.  A word counts once a text.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    each = sample.select("id", "toxic", words.alias("words")).where(F.size("words") > 0)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 3)))
    single = each.withColumn("mark", F.array_min(triples)).groupBy("mark").agg(F.min_by(F.struct("toxic", "words"), "id").alias("row")).select("row.*")
    single = durable(single.select("toxic", F.array_distinct("words").alias("words")))
    counts = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return {}
    marks = [F.transform("words", lambda w: F.concat(F.lit("="), w))]
    marks += [_stems(n) for n in STEMS]
    marked = single.select("toxic", F.explode(F.array_distinct(F.concat(*marks))).alias("mark")).groupBy("mark").agg(
        F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses")
    )
    marked = durable(marked.where((F.col("hits") > 2) & (F.col("hits") > F.col("misses"))))
    rate = lambda column, total: (F.col(column) + 1) / (total + 2)
    odds = F.log(rate("hits", counts[1]) / rate("misses", counts[0]))
    toxic_part = counts[1] / (counts[0] + counts[1])
    surprise = lambda column, part: F.when(F.col(column) > 0, F.col(column) * F.log(F.col(column) / ((F.col("hits") + F.col("misses")) * part))).otherwise(0.0)
    ratio = 2 * (surprise("hits", toxic_part) + surprise("misses", 1 - toxic_part))
    chance = 2 * math.log(max(marked.count(), 2))
    kept = marked.withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (ratio >= chance + BEYOND_CHANCE))
    best = kept.orderBy(F.desc("odds"), "mark").limit(LEXICON).collect()
    return {r["mark"]: r["odds"] for r in best}


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity of every whole text: id, score (0 to 1), matches (begin, end, kind, weight of clauses).

    ``labels`` has (id, toxic 0 or 1); ``learn`` says which rows of ``docs`` may be learnt from.  Lexicon and
    weights come from a bounded sample of those.  Texts are cut into clauses, machines for
    negation, reported speech and target run over each, and insults and threats are weighed by the
    state they meet; single words count for nothing by themselves.

    Null and empty texts have no match and the score of the constant.  Without labels of both kinds
    the grammar keeps its own weights and finds threats only.  Rows with a null label or id are not learnt from; of
    several labels of one id the larger counts.  Repeated rows and null ids keep their rows, other columns are not read.
    """
    spark = docs.sparkSession
    sample, part = labelled_sample(docs, labels, learn, id_col, text_col, rows)
    lexicon = learn_lexicon(sample)
    packed = share(spark, zlib.compress(pickle.dumps(lexicon)))

    def grammar() -> Grammar:
        data = packed.value
        return once(("toxicity", zlib.crc32(data)), lambda: Grammar(pickle.loads(zlib.decompress(data))))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [clause_features(list(grammar().matches(x))) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["toxic", "found"])

    seen = map_batches(sample.select("toxic", "text"), measure, "toxic int, found array<double>").collect()
    toxic = np.array([r["toxic"] for r in seen], float)
    weights = PRIOR
    if len(part) == 2:
        importance = np.array([1 / part[r["toxic"]] for r in seen])
        weights = fit_weights(np.array([r["found"] for r in seen]), toxic, importance / importance.mean())
    final = weights.tolist()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = grammar()
        found = [list(own.matches(x)) for x in batch.column(1).to_pylist()]
        sums = [final[0] + sum(a * b for a, b in zip(final[1:], clause_features(x), strict=True)) for x in found]
        scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in sums]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("weight", pa.float64())]))
        names = ("begin", "end", "kind", "weight")
        matches = pa.array([[dict(zip(names, m, strict=True)) for m in x] for x in found], kind)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), matches], names=["id", "score", "matches"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, score double, matches array<struct<begin:bigint,end:bigint,kind:string,weight:double>>"
    return map_batches(texts, work, schema).withColumnRenamed("id", id_col)
