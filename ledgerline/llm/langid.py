"""Language ID by a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workers import map_batches, once, share

#: The sample that the model is fitted on: rows per language, words per row.  Beyond so many languages each has fewer
#: rows, LEAST_ROWS or more, and there are more sequences; every language is a label.
SAMPLE_ROWS = 400
SAMPLE_WORDS = 200
LANGUAGES = 100
LEAST_ROWS = 40
#: Words per training sequence, sequences, gradient steps, and in how many words a feature has to occur.
SEQUENCE = 96
SEQUENCES = 1_200
STEPS = 60
LEAST_COUNT = 3
#: Words that a worker remembers before it begins anew, words in a block, and blocks that are worked on at a time.
CACHE_WORDS = 100_000
BLOCK = 128
BLOCKS = 4_096
#: Numbers in an array of one step: with many labels fewer blocks or sequences are worked on at a time.
CELLS = 10_000_000
UNDETERMINED = "und"


def core(word: str) -> str:
    """The letters of a word, lower-cased."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def features(letters: str) -> list[str]:
    """Of a word's letters: n-grams of two and three with the ends marked, affixes of three, and the word for the lexicon."""
    if not letters:
        return []
    ends = f"^{letters}$"
    found = [ends[i : i + 2] for i in range(len(ends) - 1)] + [ends[i : i + 3] for i in range(len(ends) - 2)]
    return [*found, ends[:4], ends[-4:], f"={letters}"]


@dataclass
class Model:
    """Labels, feature rows, weights (rows x labels), transition and start scores."""

    labels: list[str]
    rows: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, letters: list[str]) -> np.ndarray:
        """Emission scores (words x labels) of words' letters; unknown features weigh nothing."""
        get = self.rows.get
        return summed(self.weights, [[r for f in features(x) if (r := get(f)) is not None] for x in letters])


def summed(weights: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """For every list the sum of its rows of ``weights``."""
    sizes = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), weights.shape[1]))
    if sizes.any():
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
        full = sizes > 0
        out[full] = np.add.reduceat(weights[flat], (np.cumsum(sizes) - sizes)[full])
    return out


def _positive(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


class Chain:
    """Exact forward-backward over many texts laid end to end.

    The words are cut into blocks of equal length.  The product of a block's step matrices is computed for all
    blocks at once, then a message passes from block to block in both directions, then all blocks
    compute their words' marginals at once.  A text's first word has a matrix that forgets what
    came before, so texts of any length share the blocks, and memory does not follow the longest text.
    """

    def __init__(self, model: Model):
        self.move, self.start = np.exp(model.move - model.move.max()), _positive(model.start)
        self.size = len(model.labels)

    def _step(self, carried: np.ndarray, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``carried`` (blocks x m x labels) moved over one word of every block, each block scaled to sum one."""
        made = (carried.reshape(-1, self.size) @ self.move).reshape(carried.shape)
        if first.any():
            made[first] = carried[first].sum(axis=2, keepdims=True) * self.start
        made *= emit[:, None, :]
        made /= made.sum(axis=(1, 2), keepdims=True)
        return made

    def marginals(self, emission: np.ndarray, index: np.ndarray, first: np.ndarray):
        """Yields (from, to, marginals) over the words ``index`` (rows of ``emission``); ``first`` marks where texts begin."""
        total = len(index)
        count = -(-total // BLOCK)
        index = np.concatenate([index, np.full(count * BLOCK - total, len(emission), index.dtype)]).reshape(count, BLOCK)
        first = np.concatenate([first, np.ones(count * BLOCK - total, bool)]).reshape(count, BLOCK)
        emission = np.vstack([emission, np.ones(self.size)])
        step = max(1, min(BLOCKS, CELLS // max(self.size**2, self.size * BLOCK)))
        ranges = [(i, min(i + step, count)) for i in range(0, count, step)]
        held = {}

        def products(lo: int, hi: int) -> np.ndarray:
            """The products of a range's blocks; kept as long as all of them are few, else made anew for the way back."""
            if lo in held:
                return held[lo]
            carried = np.broadcast_to(np.eye(self.size), (hi - lo, self.size, self.size)).copy()
            for t in range(BLOCK):
                carried = self._step(carried, emission[index[lo:hi, t]], first[lo:hi, t])
            if count * self.size**2 <= CELLS:
                held[lo] = carried
            return carried

        ahead, behind = np.empty((count, self.size)), np.empty((count, self.size))
        message = np.full(self.size, 1 / self.size)
        for lo, hi in ranges:
            for i, product in enumerate(products(lo, hi), lo):
                ahead[i] = message
                message = message @ product
                message /= message.sum()
        message = np.full(self.size, 1 / self.size)
        for lo, hi in reversed(ranges):
            product = products(lo, hi)
            for i in range(hi - 1, lo - 1, -1):
                behind[i] = message
                message = product[i - lo] @ message
                message /= message.sum()
        for lo, hi in ranges:
            emit, begins = emission[index[lo:hi]], first[lo:hi]
            forward = np.empty_like(emit)
            now = ahead[lo:hi, None, :]
            for t in range(BLOCK):
                now = self._step(now, emit[:, t], begins[:, t])
                forward[:, t] = now[:, 0]
            now = behind[lo:hi].copy()
            for t in range(BLOCK - 1, -1, -1):
                forward[:, t] *= now
                now = (emit[:, t] * now) @ self.move.T
                now[begins[:, t]] = 1.0
                now /= now.sum(axis=1, keepdims=True)
            forward /= forward.sum(axis=2, keepdims=True)
            yield lo * BLOCK, min(hi * BLOCK, total), forward.reshape(-1, self.size)[: min(hi * BLOCK, total) - lo * BLOCK]


def fit(samples: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """A model from (language, words) samples.

    Training sequences switch between languages: spans of samples are laid end to end, so
    the transitions learn both to stay and to change.  Their number grows with the languages beyond LANGUAGES, so that
    each is drawn as often.  Weights are the conditional likelihood's, by full
    gradients from forward-backward with an L2 penalty.
    """
    random = np.random.default_rng(seed)
    labels = sorted({language for language, _ in samples})
    size = len(labels)
    by_label = [[words for language, words in samples if language == label and words] for label in labels]
    by_label = [x or [[""]] for x in by_label]
    words, gold = [], []
    sequences = SEQUENCES * max(size, LANGUAGES) // LANGUAGES
    for _ in range(sequences):
        line, marks = [], []
        while len(line) < SEQUENCE:
            label = int(random.integers(size))
            source = by_label[label][int(random.integers(len(by_label[label])))]
            span = int(random.integers(4, SEQUENCE))
            at = int(random.integers(max(1, len(source) - span + 1)))
            part = source[at : at + span]
            line += part
            marks += [label] * len(part)
        words += line[:SEQUENCE]
        gold += marks[:SEQUENCE]
    kinds = {word: i for i, word in enumerate(dict.fromkeys(words))}
    index = np.array([kinds[w] for w in words]).reshape(sequences, SEQUENCE)
    gold_at = np.array(gold).reshape(sequences, SEQUENCE)
    found = [features(core(word)) for word in kinds]
    counts = Counter(f for x in found for f in x)
    rows = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= LEAST_COUNT))}
    lists = [[rows[f] for f in x if f in rows] for x in found]
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(lists)), sizes)

    weights, move, start = np.zeros((len(rows), size)), np.eye(size), np.zeros(size)
    observed = np.zeros((len(kinds), size))
    np.add.at(observed, (index.ravel(), gold_at.ravel()), 1.0)
    observed_move = np.zeros((size, size))
    np.add.at(observed_move, (gold_at[:, :-1].ravel(), gold_at[:, 1:].ravel()), 1.0)
    observed_start = np.bincount(gold_at[:, 0], minlength=size).astype(float)
    params = [weights, move, start]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    several = max(1, CELLS // (SEQUENCE * size))
    for step in range(1, STEPS + 1):
        emission, moves = _positive(summed(weights, lists)), np.exp(move)
        expected, expected_move, expected_start = np.zeros((len(kinds), size)), np.zeros((size, size)), np.zeros(size)
        for lo in range(0, sequences, several):
            at = index[lo : lo + several]
            emit = emission[at]
            forward = np.empty(emit.shape)
            now = np.exp(start) * emit[:, 0]
            for t in range(SEQUENCE):
                if t:
                    now = (now @ moves) * emit[:, t]
                now /= now.sum(axis=1, keepdims=True)
                forward[:, t] = now
            marginal, now = np.empty_like(forward), np.ones((len(at), size))
            for t in range(SEQUENCE - 1, -1, -1):
                both = forward[:, t] * now
                marginal[:, t] = both / both.sum(axis=1, keepdims=True)
                if t:
                    right = emit[:, t] * now
                    weight = ((forward[:, t - 1] @ moves) * right).sum(axis=1, keepdims=True)
                    expected_move += moves * ((forward[:, t - 1] / weight).T @ right)
                    now = right @ moves.T
                    now /= now.sum(axis=1, keepdims=True)
            expected += np.stack([np.bincount(at.ravel(), marginal[..., k].ravel(), len(kinds)) for k in range(size)], axis=1)
            expected_start += marginal[:, 0].sum(axis=0)
        left = observed - expected
        gradient = [
            np.stack([np.bincount(flat, left[owner, k], len(rows)) for k in range(size)], axis=1) - 0.5 * weights,
            observed_move - expected_move - 0.5 * move,
            observed_start - expected_start - 0.5 * start,
        ]
        for p, g, m, v in zip(params, gradient, means, squares, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, rows, weights, move, start)


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """(language, words) of about ``rows`` labelled rows per language, ``words`` successive words of each.

    Rows are chosen by a hash of id and text.  With more than LANGUAGES languages each has fewer, but LEAST_ROWS.
    A language that none was drawn of gives one text, so that none is left out.  At most twice the rows asked for
    come to the driver, and one for each language.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), learn.alias("learn"), F.xxhash64(id_col, text_col).alias("draw"))
    known = known.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    if len(counts) > LANGUAGES:
        rows = max(min(rows, LEAST_ROWS), rows * LANGUAGES // len(counts))
    share_of = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, rows / r["count"])))])
    drawn = known.where(F.pmod("draw", F.lit(1 << 30)) < share_of[F.col("lang")] * float(1 << 30))
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    at = F.pmod(F.shiftright("draw", 20), F.greatest(F.size("parts") - words + 1, F.lit(1))) + 1

    def cut(some: DataFrame) -> DataFrame:
        return some.withColumn("parts", parts).select("lang", "draw", F.slice("parts", at.cast("int"), words).alias("words"))

    found = cut(drawn).limit(2 * rows * max(LANGUAGES, len(counts))).collect()
    missed = sorted({r["lang"] for r in counts} - {r["lang"] for r in found})
    if missed:
        rest = cut(known.where(F.col("lang").isin(missed)))
        found += rest.groupBy("lang").agg(F.min(F.struct("draw", "words")).alias("one")).select("lang", "one.*").collect()
    picked = sorted(((r["lang"], r["draw"], r["words"]) for r in found), key=lambda x: x[:2])
    return [(lang, parts) for lang, _, parts in picked]


class Labeller:
    """Labels the words of texts with a fitted model; remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model, self.chain = model, Chain(model) if model.labels else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.cores: dict[str, int] = {}
        self.emission = np.empty((0, len(self.model.labels)))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.emission`` for the words; words with the same letters share one."""
        known, cores = self.index, self.cores
        new = {word: core(word) for word in set(words).difference(known)}
        if new:
            fresh = sorted(set(new.values()).difference(cores))
            cores.update(zip(fresh, range(len(cores), len(cores) + len(fresh)), strict=True))
            self.emission = np.vstack([self.emission, _positive(self.model.scores(fresh))])
            known.update((word, cores[letters]) for word, letters in new.items())
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def label(self, texts: list[str]):
        """For every text (language, score, run labels, run lengths): mean marginals of its words with letters, and runs of one label."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        lists = [text.split() for text in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        words = list(chain.from_iterable(lists))
        size = len(self.model.labels)
        means, best = np.zeros((len(texts), size)), np.zeros(len(words), np.int16)
        ends = np.cumsum(sizes)
        if words and size:
            index = self.rows_of(words)
            first = np.zeros(len(words), bool)
            first[(ends - sizes)[sizes > 0]] = True
            owner = np.repeat(np.arange(len(texts)), sizes)
            counted = np.ptp(self.emission, axis=1)[index] > 0
            for lo, hi, marginal in self.chain.marginals(self.emission, index, first):
                best[lo:hi] = marginal.argmax(axis=1)
                for k in range(size):
                    means[:, k] += np.bincount(owner[lo:hi], marginal[:, k] * counted[lo:hi], len(texts))
        for i, (text, n) in enumerate(zip(texts, sizes, strict=True)):
            if not size or not any(map(str.isalpha, text)):
                yield UNDETERMINED, 0.0, [], []
                continue
            own = best[ends[i] - n : ends[i]]
            borders = np.flatnonzero(np.diff(own, prepend=-1))
            total = means[i].sum()
            k = int(means[i].argmax())
            score = float(means[i, k] / total) if total else 1 / size
            yield self.model.labels[k], min(score, 1.0), [self.model.labels[x] for x in own[borders]], np.diff(borders, append=n).tolist()


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Language of every whole text: row (a struct of ``carry``, by default the id), lang_pred, score, runs.

    ``learn`` says from which rows of ``docs`` text and language may be learnt.  The field is fitted on a
    sample of them, bounded per language (SAMPLE_ROWS); its labels are all languages that can be learnt.  Words are
    the runs between white space.  ``runs`` is an array of (lang, words): how many successive words
    have one label.  ``lang_pred`` is the label with the largest mean marginal probability over the words with known features,
    ``score`` that mean.

    Null texts and those without a letter are ``und`` with score 0, as all are if nothing can be
    learnt.  A null ``lang`` is not learnt from.  Texts none of whose features is known get the first label at even odds.
    Repeated rows and null ids keep their rows, extra columns do not matter.  Nothing is shuffled but the counts of languages.
    """
    samples = training_sample(docs, learn, id_col, text_col, lang_col)
    model = fit(samples) if samples else Model([], {}, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    packed = share(docs.sparkSession, zlib.compress(pickle.dumps(model)))
    carry = carry or [id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = packed.value
        labeller = once(("langid", zlib.crc32(data)), lambda: Labeller(pickle.loads(zlib.decompress(data))))
        done = list(labeller.label([text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]))
        runs = [[{"lang": a, "words": b} for a, b in zip(x[2], x[3], strict=True)] for x in done]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        columns = [batch.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.float64()), pa.array(runs, kind)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "runs"])

    # a text that is carried goes to the worker and back once, in front as a part of its row
    own = [name for name in carry if name != text_col]
    row = F.struct(*[F.col(f"`{name}`") for name in own]) if own else F.struct(F.lit(0))
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = "lang_pred string, score double, runs array<struct<lang:string,words:bigint>>"
    if text_col not in carry:
        return map_batches(rows, work, f"row {kind}, {found}").withColumn("row", F.struct(*[F.col(f"row.`{name}`") for name in carry]))

    def work_on_text(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = work(batch)
        return pa.RecordBatch.from_arrays([*made.columns, batch.column(1)], names=[*made.schema.names, "text"])

    made = map_batches(rows, work_on_text, f"row {kind}, {found}, text string")
    row = F.struct(*[(F.col("text") if name == text_col else F.col(f"row.`{name}`")).alias(name) for name in carry])
    return made.select(row.alias("row"), "lang_pred", "score", "runs")
