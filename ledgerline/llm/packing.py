"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.bpe import byte_letters, read_vocabulary
from ledgerline.llm.workers import Cache, enter, map_batches, once, share
from ledgerline.session import durable

#: Words, and pieces between blanks that go to the library, whose ids a worker remembers (at most twice as many).
CACHE_WORDS = 200_000
CACHE_PIECES = 20_000
#: Characters of a text that are split at a time.
BLOCK = 1 << 20
#: Texts of these characters are split and lower-cased here; of others the library takes the pieces between blanks that hold another one.
USUAL = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
#: Fixed settings of the tokenizer files that are supported.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Lines of letters, blanks and single stops and commas, which blanks part as well.
PLAIN = re.compile(r"(?:[a-zß-öø-ÿ \t\r]++|[.,](?![.,]))*+")
#: The pattern for lower-case text without unusual characters.
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\ra-zß-öø-ÿ0-9]+")
#: Ranks stay under this in the lookup of runs.
RANKS = 1 << 44


class WordTokens:
    """Packed ids (little-endian, unsigned, 32 bits) of texts by a tokenizer file with word ends.

    White space only parts words and no token crosses it or a word's border.  So a text is split into words by the file's pattern, a word
    that comes again is looked up, and the library's model gives the ids of the others.  Pieces with other than plain
    Latin characters, or with what may be an added token, go through the library as a whole.
    """

    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0].get("pattern") == {"Regex": PATTERN}
        if not known or [x.get("type") for x in steps] != ["Split", "ByteLevel"] or not all("<|" in x["content"] for x in spec["added_tokens"]):
            raise ValueError("not a file of lower-case words with plain normalising")
        self.model = self.library.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.words = Cache(self._word, CACHE_WORDS)
        self.pieces = Cache(self._piece, CACHE_PIECES)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}I", *ids)

    def _simple(self, text: str) -> bytes | None:
        """Ids of a text without unusual characters and added tokens, None for others."""
        if not USUAL.fullmatch(text) or "<|" in text:
            return None
        words: list[str] = []
        for line in text.lower().split("\n"):
            words += line.replace(".", " . ").replace(",", " , ").split() if PLAIN.fullmatch(line) else PARTS.findall(line)
        return b"".join(map(self.words.__getitem__, words))

    def _piece(self, piece: str) -> bytes:
        done = self._simple(piece)
        if done is not None:
            return done
        ids = self.library.encode(piece, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= BLOCK else text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            block = text[at:end]
            done = self._simple(block)
            out += map(self.pieces.__getitem__, block.replace("\n", " ").split(" ")) if done is None else [done]
            at = end
        return b"".join(out)


class OpenBins:
    """Remaining capacities that some open bin has, as a segment tree: the tightest that fits is found in logarithmic time."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.leaves
        self.tree[at] = is_open
        while at > 1:
            at >>= 1
            self.tree[at] = self.tree[2 * at] | self.tree[2 * at + 1]

    def tightest(self, length: int) -> int:
        """The smallest open capacity of ``length`` or more; -1 without one."""
        at = length + self.leaves
        while not self.tree[at]:
            while at & 1:  # a right child: go on above
                at >>= 1
            if not at:
                return -1
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.tree[2 * at])
        return at - self.leaves


def plan_runs(counts: dict[int, int], limit: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing over all documents: runs (length, first rank, first bin, per bin, offset) and the number of bins.

    Documents of one length are interchangeable, and so are bins with one remaining capacity, so
    the plan needs only how many documents each length has.  A document goes to the
    tightest open bin.  While that bin still takes one more of the length it stays the tightest, so all
    bins of a capacity take as many as they hold, in one step.

    A length splits at most two ranges of bins and opens two, so there are at most 4 x ``limit`` ranges, and the
    lengths of a bin are different in different runs, so a range is in fewer than sqrt(2 x limit) + 1 runs: for 2048,
    530,000 runs at most, whatever the number of documents.
    """
    tree, pools = OpenBins(limit), {}

    def free(capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            if not pools.get(capacity):
                tree.put(capacity, True)
            pools.setdefault(capacity, []).append((first, bins))

    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            capacity = tree.tightest(length)
            if capacity < 0:
                new = -(-(count - rank) // (limit // length))
                free(limit, opened, new)
                opened += new
                continue
            first, bins = pools[capacity].pop()
            if not pools[capacity]:
                tree.put(capacity, False)
            fit = capacity // length
            full = min(bins, (count - rank) // fit)
            if full:
                runs.append((length, rank, first, fit, limit - capacity))
                free(capacity - fit * length, first, full)
                rank += full * fit
            if full < bins and rank < count:  # the last documents of this length do not fill a bin's share
                runs.append((length, rank, first + full, fit, limit - capacity))
                free(capacity - (count - rank) * length, first + full, 1)
                rank, full = count, full + 1
            free(capacity, first + full, bins - full)
    return np.array(runs, np.int64).reshape(-1, 5), opened


def cut_documents(docs: DataFrame, path: str, limit: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Documents as pieces of at most ``limit`` tokens: id, piece, start, length, ids_crc32, ids, nth.

    ``nth`` numbers the pieces of one length within a task, from 0.
    """
    packed = share(docs.sparkSession, read_vocabulary(path))
    end = pack("<I", end_id)

    def work(batch: pa.RecordBatch, seen: Counter) -> pa.RecordBatch:
        model = once(("words", zlib.crc32(packed.value)), lambda: WordTokens(zlib.decompress(packed.value).decode()))
        found = {name: [] for name in ("row", "piece", "start", "length", "crc", "ids", "nth")}
        for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            ids = memoryview(model.encode(text) + end)
            for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                part = ids[at : at + 4 * limit]
                length = len(part) // 4
                for name, value in (("row", row), ("piece", piece), ("start", at // 4), ("length", length), ("crc", zlib.crc32(part)), ("nth", seen[length])):
                    found[name].append(value)
                found["ids"].append(bytes(part) if with_ids else None)
                seen[length] += 1
        columns = [batch.column(0).take(pa.array(found["row"], pa.int64())), pa.array(found["piece"], pa.int32())]
        columns += [pa.array(found[name], pa.int64()) for name in ("start", "length", "crc", "nth")] + [pa.array(found["ids"], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "nth", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, ids binary"
    return map_batches(rows, work, schema, state=Counter)


def pack_documents(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids (packed) if asked for.

    Whole texts are tokenised where they are read, each followed by ``end_id``.  Only documents over
    ``limit`` tokens are cut, every ``limit`` tokens.  The pieces, without texts, are kept in the shared folder; a piece's rank among
    those of its length is its number in its task plus the counts of the tasks before.  The driver sees one
    count per length and plans best fit decreasing for all documents at once (``plan_runs``); the
    plan's size depends on ``limit`` alone, it is broadcast, and every piece finds its place in it by rank.  A
    length that most pieces share costs no more than others.

    Sequences are numbered from 0 and filled without gaps from offset 0.  Null texts count as empty: one piece, the end
    id.  Repeated rows and null ids are documents of their own.  An empty table gives no rows.  Other
    columns are not read.
    """
    pieces = durable(cut_documents(docs, path, limit, end_id, id_col, text_col, with_ids)).withColumn("task", F.spark_partition_id())
    counts = durable(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("rows")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    lengths = counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()
    runs, _ = plan_runs({r.length: r.rows for r in lengths}, limit)
    shared = share(docs.sparkSession, runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(f"{__name__}.place")  # the tokenizer and what it remembers are done with
        length, first, bins, fit, offset = shared.value.T
        keys = length * RANKS + first
        for batch in batches:
            own, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            at = np.searchsorted(keys, own * RANKS + rank, side="right") - 1
            step = rank - first[at]
            columns = {name: batch.column(name) for name in kept}
            columns |= {"sequence_id": pa.array(bins[at] + step // fit[at]), "offset": pa.array(offset[at] + step % fit[at] * own)}
            yield pa.RecordBatch.from_pydict(columns)

    kept = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(starts, ["task", "length"]).select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    schema = ", ".join(f"{name} {ranked.schema[name].dataType.simpleString()}" for name in kept)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack_documents(..., with_ids=True)``: sequence_id, n_tokens, pieces, ids.

    A sequence has no more pieces than tokens, so ``limit`` bounds every group.
    """
    part = F.struct("offset", "ids")
    joined = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("pieces"), joined.alias("ids"))
