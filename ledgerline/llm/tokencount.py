"""Token counts of a sentence-piece vocabulary by a two-tier lookup in the map tasks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workers import Cache, map_batches, once, share, ship_code

#: Entries of the broadcast table, their longest key, and pieces that a worker remembers besides (at most twice as many).
TABLE_PIECES = 65_536
TABLE_KEY = 32
CACHE_PIECES = 200_000
#: The frequent pieces are looked for in so many partitions, in so many of their first rows.  This only tunes the table:
#: what it lacks is encoded, so counts do not depend on it.
SAMPLE_PARTITIONS = 16
SAMPLE_ROWS = 1_500
SPACE = "▁"
LOOSE_BLANK = re.compile(r" (?: |\Z)")
CUT = re.compile(r" +[^ ]*|[^ ]+")
PROBE = "ﬁ Ａ ½ é Å İ x　y\tz"


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def cuts_are_exact(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether texts may be cut before blanks and around line breaks.

    They may if no token has a space mark after another character and none holds a line break
    (merges only make tokens, so none crosses such a border), and if texts are not normalised.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
        return False
    spelled = "".join(p if not model.is_byte(model.piece_to_id(p)) else f"\0{p[3:5]}" for p in model.encode("  " + PROBE + " ", out_type=str))
    plain = re.sub(r"(?:\0[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("\0", "")).decode(), spelled)
    return plain == SPACE + ("  " + PROBE + " ").replace(" ", SPACE)


class TokenCounter:
    """Token counts of whole texts: pieces looked up in the table, then in the cache, else encoded."""

    def __init__(self, content: bytes, table: dict[str, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.exact = cuts_are_exact(self.model)
        self.pieces = Cache(self._piece, CACHE_PIECES, fixed=table)

    def _piece(self, piece: str) -> int:
        """Tokens of a piece that follows one blank; line breaks are tokens of their own."""
        lines = piece.split("\n")
        if len(lines) == 1:
            return len(self.model.encode(piece)) if piece else 1
        # after a line break there is no space mark: the break is put before, and it and the mark are taken off
        later = sum(len(self.model.encode("\n" + line)) - 1 for line in lines[1:])
        return (len(self.model.encode(lines[0])) if lines[0] else 1) + later

    def _blanks(self, piece: str) -> int:
        """Tokens of a piece that begins with several blanks: the model adds one space mark itself."""
        return len(self.model.encode(piece[1:])) if piece != " " else 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact:
            return len(self.model.encode(text))
        text = text.replace(SPACE, " ")
        if LOOSE_BLANK.search(text) or text[0] == " ":
            return sum(self._loose(piece) for piece in CUT.findall(" " + text))
        return sum(map(self.pieces.__getitem__, text.split(" ")))

    def _loose(self, piece: str) -> int:
        if piece[1:2] != " " and len(piece) > 1:
            return self.pieces[piece[1:]]
        head, breaks, rest = piece.partition("\n")
        return self._blanks(head) + (self.pieces["\n" + rest] - 1 if breaks else 0)


def frequent_pieces(docs: DataFrame, text_col: str, partitions: int = SAMPLE_PARTITIONS, rows: int = SAMPLE_ROWS, size: int = TABLE_PIECES) -> list[str]:
    """The most frequent pieces of a bounded sample: some rows of partitions spread over the input.

    Each task sends at most ``size`` counts, so the driver merges ``partitions * size`` at most.
    """
    ship_code(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).where(F.col(text_col).isNotNull()).rdd

    def count(part):
        seen = Counter()
        for row in islice(part, rows):
            seen.update(x for x in row.text.split(" ") if 0 < len(x) <= TABLE_KEY and "\n" not in x and SPACE not in x)
        return [seen.most_common(size)]

    total = texts.getNumPartitions()
    chosen = sorted({i * total // min(partitions, total) for i in range(min(partitions, total))}) if total else []
    merged = Counter()
    for part in docs.sparkSession.sparkContext.runJob(texts, count, chosen) if chosen else []:
        merged.update(dict(part))
    return [piece for piece, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:size]]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: id, n_bytes (UTF-8), n_tokens, as the library gives them without added tokens.

    Texts are cut into pieces at blanks in the task that reads them.  A broadcast table holds the
    lengths of frequent pieces, TABLE_PIECES keys of TABLE_KEY characters at most; other pieces are
    encoded and remembered by the worker.  No piece is shuffled.  If the model's tokens
    or its normalisation do not allow such cuts, whole texts are encoded.

    Null texts count as empty: no bytes, no tokens.  Repeated rows and null ids keep their rows,
    other columns are not read.
    """
    content = read_model(path)
    counter = TokenCounter(content, {})
    frequent = frequent_pieces(docs, text_col) if counter.exact else []
    lengths = np.array([min(counter._piece(piece), 255) for piece in frequent], np.uint8)
    packed = share(docs.sparkSession, zlib.compress(lengths.tobytes() + " ".join(frequent).encode()))
    model, entries, version = share(docs.sparkSession, content), len(frequent), zlib.crc32(content)

    def make() -> TokenCounter:
        data = zlib.decompress(packed.value)
        table = dict(zip(data[entries:].decode().split(" "), data[:entries], strict=True)) if entries else {}
        return TokenCounter(model.value, {piece: n for piece, n in table.items() if n < 255})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = once(("tokens", (version, packed.value[:64], len(packed.value))), make).count
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([counts(x) for x in batch.column(2).to_pylist()], pa.int64())], names=["id", "n_bytes", "n_tokens"]
        )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
