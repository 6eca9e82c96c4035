"""Byte-pair encoding by longest matches and a compatibility table, and decoding by an offset table."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise
from pathlib import Path
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.workers import Cache, map_batches, once, share

#: Pre-tokens, and pieces between blanks of unusual texts, whose ids a worker remembers (at most twice as many), and checked pairs of tokens.
CACHE_WORDS = 150_000
CACHE_PIECES = 10_000
CACHE_PAIRS = 150_000
#: Rests of words whose longest first token a worker remembers.
CACHE_REST = 50_000
#: Fixed pattern of the byte-level pre-tokenizer.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Texts of these characters are split by USUAL_SPLIT, which is the pattern above for them.
USUAL = re.compile(r"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
USUAL_SPLIT = re.compile(r""" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^ \t\n\r0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+""")
#: A blank that is followed by white space or ends the text: such texts are cut by CUT instead of at every blank.
LOOSE_BLANK = re.compile(r" (?:\s|\Z)")
CUT = re.compile(r"(?= \S)")
LINE = re.compile(r"(\S+)\n(\S+)")


@lru_cache
def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary (``vocab`` and ``merges`` of a tokenizer file) for texts.

    A sequence of tokens is the one that the merges give if and only if the text's bytes are covered and
    every two neighbours are compatible, that is, the merges leave them apart.  So the
    longest matches are taken from the left; where a neighbour does not fit, shorter prefixes are
    tried and at last the token before is taken back.  A position that was given up is never entered
    again, which keeps the work linear in the length.

    ``remember`` scales what is remembered of words and pairs; it changes time and memory, never the ids.
    """

    def __init__(self, content: str, remember: float = 1.0):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE file")
        if spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("a setting of the file is not supported")
        latin = lambda token: "".join(chr(letters[c]) for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ids = {latin(token): i for token, i in model["vocab"].items() if token not in self.special}
        self.merged: dict[tuple[int, int], int] = {}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (self.ids[latin(left)], self.ids[latin(right)])
            made = self.ids[latin(left + right)]
            if self.parts[made] is not None:
                raise ValueError("two merges make one token")
            self.merged[pair], self.parts[made], self.rank[made] = rank, pair, rank
        self.words: list[str] = [""] * size
        self.usable: dict[str, int] = {}
        self.matcher = ahocorasick.Automaton()
        for word, i in self.ids.items():
            if len(word) == 1 or self.parts[i] is not None:  # a token that no merge makes never occurs
                self.words[i] = word
                self.usable[word] = i
                self.matcher.add_word(word, i)
        self.matcher.make_automaton()
        texts = [word.encode("latin-1") for word in self.words]
        for content_, i in self.special.items():
            texts[i] = content_.encode()
        self.longest = max(map(len, self.words))
        self.lengths = list(map(len, self.words))
        self.shorter = [self._prefix(word, len(word) - 1) for word in self.words]
        self.first = Cache(lambda rest: self._prefix(rest, self.longest), int(CACHE_REST * remember), longest=32)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.fits = Cache(self._fits, int(CACHE_PAIRS * remember))
        self.words_seen = Cache(self._word, int(CACHE_WORDS * remember))
        self.pieces = Cache(self._piece, int(CACHE_PIECES * remember))

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave two tokens apart when they stand side by side.

        Undo the merges of both sides, latest first, and see whether one across the border came before.

        ``until`` is the rank that a merge across has to stay under to come first.  Equal ranks are
        merged from left to right, so the right side is undone first and a tie goes to the border.
        """
        a, b = pair
        if a < 0:  # nothing stands before
            return True
        until = len(self.merged)
        while True:
            if self.merged.get((a, b), until) < until:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until, a = self.rank[a], self.parts[a][1]
            else:
                until, b = self.rank[b] + 1, self.parts[b][0]

    def _prefix(self, word: str, length: int) -> int:
        """The longest token that ``word`` begins with, of ``length`` bytes at most; -1 without one."""
        for n in range(min(length, self.matcher.longest_prefix(word)), 0, -1):
            found = self.usable.get(word[:n])
            if found is not None:
                return found
        return -1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 letters for its bytes."""
        found = [token for _, token in self.matcher.iter_long(word)]
        fits = self.fits
        pairs = list(map(fits.__getitem__, pairwise(found)))
        if False not in pairs:
            return found
        lengths, shorter, first, longest, size = self.lengths, self.shorter, self.first, self.longest, len(word)
        sound = pairs.index(False) + 1
        taken, token, last = found[:sound], found[sound], found[sound - 1]
        closed = bytearray(size + 1)
        at = sum(map(lengths.__getitem__, taken))
        while at < size:
            while token >= 0 and (closed[at + lengths[token]] or not fits[last, token]):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += lengths[token]
                last, token = token, first[word[at : at + longest]]
            else:
                closed[at] = 1
                at -= lengths[last]
                token = shorter[taken.pop()]
                last = taken[-1] if taken else -1
        return taken

    def _word(self, word: str) -> bytes:
        ids = self.encode_word(word.encode().decode("latin-1"))
        return pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.words_seen.__getitem__, SPLIT.findall(text)))

    def _piece(self, piece: str) -> bytes:
        """Packed ids of a piece: without white space it stands for itself after a blank, else as it is."""
        if line := LINE.fullmatch(piece):  # a line break between words stands alone
            return self.pieces[line[1]] + self.pieces["\n"] + self._words(line[2])
        return self._words(piece if piece[0].isspace() else f" {piece}")

    def _plain(self, text: str) -> bytes:
        """Usual texts are split as a whole; others are cut at every blank before a character that is no white space, where a pre-token begins."""
        if not text:
            return b""
        if USUAL.fullmatch(text):
            return b"".join(map(self.words_seen.__getitem__, USUAL_SPLIT.findall(text)))
        if LOOSE_BLANK.search(text):
            return b"".join(map(self._words, CUT.split(text)))
        first, _, rest = text.partition(" ")
        head = self._words(first) if first else b""
        return head + b"".join(map(self.pieces.__getitem__, rest.split(" "))) if rest else head

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens in the text are taken whole."""
        if self.special_split is None or not any(word in text for word in self.special):
            return self._plain(text)
        parts = self.special_split.split(text)
        return b"".join(pack("<I", self.special[x]) if x in self.special else self._plain(x) for x in parts)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the bytes between a token's offsets, invalid UTF-8 replaced."""
        tokens = np.frombuffer(ids, "<u4")
        begin = self.offsets[tokens]
        sizes = self.offsets[tokens + 1] - begin
        ends = np.cumsum(sizes)
        places = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[places].tobytes().decode("utf-8", errors="replace")


def read_vocabulary(path: str) -> bytes:
    """The tokenizer file, compressed; its size is that of the vocabulary."""
    return zlib.compress(Path(path).read_bytes())


def encoder(packed: bytes, remember: float = 1.0) -> Encoder:
    """This worker's encoder for a compressed tokenizer file."""
    return once(("bpe", zlib.crc32(packed), remember), lambda: Encoder(zlib.decompress(packed).decode(), remember))


#: What ``round_trip`` can give: Arrow type, and the value from (packed ids, decode).
OUTPUTS = {
    "n_tokens": ("bigint", pa.int64(), lambda ids, text: len(ids) // 4),
    "ids": ("binary", pa.binary(), lambda ids, text: ids),
    "ids_sha256": ("string", pa.string(), lambda ids, text: sha256(ids).hexdigest()),
    "decoded": ("string", pa.string(), lambda ids, text: text),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: sha256(text.encode()).hexdigest()),
}


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("n_tokens", "ids", "decoded"), remember: float = 1.0) -> DataFrame:
    """Encode whole texts and decode the ids again: id and ``outputs``, any of n_tokens, ids (packed, little-endian), decoded, and digests of both.

    Every row is worked on by itself where it is read; nothing is shuffled.  Digests are taken there, so texts and ids go
    back only if they are asked for.  The file is read by the driver and broadcast, which its size bounds.  Null
    texts count as empty and give no tokens.  Repeated rows and null ids keep their rows, other columns are not read.
    With a smaller ``remember`` workers take less memory and more time (see ``Encoder``).
    """
    packed = share(docs.sparkSession, read_vocabulary(path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = encoder(packed.value, remember)
        found: list[list] = [[] for _ in outputs]
        for text in batch.column(1).to_pylist():
            ids = model.encode(text)
            decoded = model.decode(ids)
            for values, name in zip(found, outputs, strict=True):
                values.append(OUTPUTS[name][2](ids, decoded))
        columns = [pa.array(values, OUTPUTS[name][1]) for values, name in zip(found, outputs, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *outputs])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [f"id {rows.schema['id'].dataType.simpleString()}", *[f"{name} {OUTPUTS[name][0]}" for name in outputs]]
    return map_batches(rows, work, ", ".join(kinds)).withColumnRenamed("id", id_col)
