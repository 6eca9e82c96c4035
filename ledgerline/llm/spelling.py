"""Spelling variants: words at one edit from each other, found by grams of variable length."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workers import map_batches, share
from ledgerline.session import durable

#: Runs of letters, the candidates for words.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Lengths of grams; a gram is extended until it is rare or has the largest length.
SHORTEST, LONGEST = 2, 5
#: Grams with more places than this count as frequent; the limit rises with the words, so that fewer than
#: (LONGEST - SHORTEST + 1) * FREQUENT grams are, whatever their number.
LEAST_PLACES, FREQUENT = 30, 60_000
#: Distinct words that a task counts before it sends them on.
HELD = 200_000
#: Characters of a text that are searched at a time.
BLOCK = 1 << 20
#: Marks of a word's begin and end; no word holds them.
BEGIN, END = "\x02", "\x03"


def blocks(text: str) -> Iterator[str]:
    """A text in parts that end where no run goes on."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and RUN.match(text, end):
            end += 1
        yield text[at:end]
        at = end


def runs_of(text: str) -> Counter:
    """How often each run of letters occurs; only A-Z are lower-cased."""
    found: Counter = Counter()
    for block in blocks(text):
        found.update(RUN.findall(block.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    return found


def drop_letter(doc_id: str, run: str, modulus: int) -> str:
    """The run, or without one letter where ``modulus`` divides the hash of id and run."""
    digest = zlib.crc32(f"{doc_id}:{run}".encode())
    if digest % modulus:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, alter: Callable[[str, str], str] | None = None, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_length`` characters with at least ``least_count`` occurrences over all documents.

    ``alter`` gives the word for (id as text, run).  A task counts up to HELD words at a time and sends them on; a null id is the empty text,
    a null text has no words.
    """

    def work(batch: pa.RecordBatch, held: Counter) -> pa.RecordBatch:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run, n in runs_of(text).items():
                word = alter(key, run) if alter else run
                if len(word) >= least_length:
                    held[word] += n
        full = dict(held) if len(held) >= HELD else {}
        if full:
            held.clear()
        return counted(full)

    def counted(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = map_batches(rows, work, "word string, n bigint", state=Counter, rest=counted)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grams_of(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram at every place of the marked word: the shortest that is not frequent, as far as length and word allow.

    A gram depends on its own characters alone.  So an edit changes those that cover the place and moves
    the others as they are.
    """
    marked = BEGIN + word + END
    found = []
    for at in range(len(marked) - SHORTEST + 1):
        end = at + SHORTEST
        while end - at < LONGEST and end < len(marked) and marked[at:end] in frequent:
            end += 1
        found.append(marked[at:end])
    return found


def affected(grams: list[str]) -> int:
    """The most grams that one edit can change: those over one place of the word."""
    edges = [0] * (len(grams) + LONGEST + 1)
    for at, gram in enumerate(grams):
        edges[at] += 1
        edges[at + len(gram)] -= 1
    most = depth = 0
    for place in range(len(grams)):
        depth += edges[place]
        if place:  # the first place is the mark
            most = max(most, depth)
    return most


def signature(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(place, gram) of the rarest grams: one more than an edit can change.

    Of two words at one edit, the grams that both keep stand in the same order of rarity, gram and place in
    both.  Only changed ones can come before the first of them, so it is among these in both words.
    """
    grams = grams_of(word, frequent)
    return sorted(enumerate(grams), key=lambda x: (frequent.get(x[1], 0), x[1], x[0]))[: affected(grams) + 1]


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams of SHORTEST to LONGEST characters and their places in the distinct words.

    A longer gram is no more frequent than its beginnings, so these are in the dictionary too.  The limit
    is raised until the bound on the number of frequent grams holds, which bounds what the driver gets.
    """

    def work(batch: pa.RecordBatch, held: Counter) -> pa.RecordBatch:
        for word in batch.column(0).to_pylist():
            marked = BEGIN + word + END
            held.update(marked[at : at + n] for n in range(SHORTEST, LONGEST + 1) for at in range(len(marked) - n + 1))
        full = dict(held) if len(held) >= HELD else {}
        if full:
            held.clear()
        return counted(full)

    def counted(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "places"])

    letters = words.agg(F.sum(F.char_length("word") + 1)).scalar()
    limit = F.greatest(F.lit(LEAST_PLACES), F.ceil(letters / F.lit(FREQUENT)))
    grams = map_batches(words.select("word"), work, "gram string, places bigint", state=Counter, rest=counted)
    frequent = grams.groupBy("gram").agg(F.sum("places").alias("places")).where(F.col("places") > limit)
    return {r.gram: r.places for r in frequent.collect()}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two words at one inserted, deleted or replaced character, both ways round.

    ``words`` has distinct words of at least LONGEST characters.  Each goes under the few grams of its
    ``signature``, with place and length.  Words meet at equal grams whose places fit: at the same place if they are as long, or
    at the same or the next one in a word that is longer by one.  What meets is verified by edit distance.
    """
    frequent = share(words.sparkSession, gram_dictionary(words))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(row, gram, place) for row, word in enumerate(batch.column(1).to_pylist()) for place, gram in signature(word, frequent.value)]
        rows, grams, places = zip(*found, strict=True) if found else ((), (), ())
        picked = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(places, pa.int32()), batch.column(1).take(picked), batch.column(0).take(picked)], names=["gram", "place", "word", "n"])

    size = F.char_length("word")
    index = durable(map_batches(words.select("n", "word"), work, "gram string, place int, word string, n bigint").withColumn("length", size))
    steps = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(on).alias("on")) for more, on in ((0, 0), (1, 0), (1, 1))])
    asked = index.withColumn("step", F.explode(steps)).select(
        "gram",
        (F.col("place") + F.col("step.on")).alias("place"),
        (F.col("length") + F.col("step.more")).alias("length"),
        F.col("word").alias("near"),
        F.col("n").alias("near_n"),
    )
    met = index.join(asked, ["gram", "place", "length"])
    other = (F.char_length("near") < F.col("length")) | (F.col("near") < F.col("word"))
    pairs = durable(met.where(other & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n").distinct())
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of the way from form to form, in rounds that double their step.

    A form is at least twice as frequent as its word, so there are no circles and a way has fewer steps than a count has bits.
    """
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        after = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(state.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def group_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct words (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's; the root is where following forms ends, the word itself without one.
    Words of fewer than LONGEST characters are refused, since one edit could change all their grams.  No words give no rows.
    """
    words = durable(words.select("word", F.col("n").cast("bigint").alias("n")))
    if not words.where(F.char_length("word") < LONGEST).isEmpty():
        raise ValueError(f"words need at least {LONGEST} characters")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = durable(near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    strong = -F.col("best.minus") >= F.col("n") * ratio
    near = near.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    ends = roots(near.where(F.col("form").isNotNull()))
    every = words.join(near, "word", "left").join(ends, "word", "left")
    return every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, alter: Callable[[str, str], str] | None = None, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of whole texts with their variants (see ``word_counts`` and ``group_variants``).

    Null and empty texts have no words; repeated rows count again; other columns are not read; an empty
    table gives no rows.
    """
    return group_variants(word_counts(docs, alter, least_length, least_count, id_col, text_col))
