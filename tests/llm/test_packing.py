import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing as X

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, limit):
    """Capacities left by plain best fit decreasing, document by document."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(free) if room >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(limit - length)
    return sorted(free)


@pytest.mark.parametrize("limit", [1, 7, 40, 64])
def test_plan_equals_document_by_document(limit):
    for seed in range(40):
        draw = random.Random(f"{limit}{seed}")
        lengths = [draw.randint(1, limit) if seed % 2 else max(1, int(limit * draw.random() ** 3)) for _ in range(draw.randint(0, 150))]
        runs, bins = X.plan_runs(Counter(lengths), limit)
        fill, places = Counter(), Counter()
        by_length = defaultdict(list)
        for run in runs:
            by_length[run[0]].append(run)
        for length, count in Counter(lengths).items():
            own = sorted(by_length[length], key=lambda r: r[1])
            for rank in range(count):
                _, first, start, fit, offset = [r for r in own if r[1] <= rank][-1]
                at = start + (rank - first) // fit
                begin = offset + (rank - first) % fit * length
                fill[at] += length
                places.update((at, x) for x in range(begin, begin + length))
        assert not places or max(places.values()) == 1
        assert all((at, x) in places for at, n in fill.items() for x in range(n))
        assert len(fill) == bins and sorted(limit - n for n in fill.values()) == best_fit(lengths, limit)


def test_tightest_capacity():
    tree, draw, held = X.OpenBins(100), random.Random(1), set()
    for _ in range(3000):
        capacity = draw.randint(1, 100)
        tree.put(capacity, capacity not in held)
        held ^= {capacity}
        length = draw.randint(1, 100)
        assert tree.tightest(length) == min((c for c in held if c >= length), default=-1)


def check(frame, rows, limit):
    library = Tokenizer.from_file(PATH)
    found = frame.collect()
    want = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want.append((key, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ends = defaultdict(list)
    for r in found:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(limit - sum(n for _, n in parts) for parts in ends.values()) == best_fit([r.length for r in found], limit)
    return found


ODD = [
    "", None, " ", "\n\n\t", "Hello WORLD's dog, it'S 12.5% off!", "<|startoftext|> x <|endoftext|>y <|ENDOFTEXT|>", "éa ́b ≠ ≮", "ΑΣ ΑΣ. İstanbul ẞtraße ×÷",
    "ñandú Ñ öl", "中文 テスト한국어", "a\x0bb\x0cc\x1cd\x85e\xa0f g", "a​b 👍🏽 '' ''s '", "x" * 5000, "word " * 900, "퟿ ￿ \x00", "don't we'll I'D they've", "ſ K Å",
]


@pytest.mark.parametrize("limit", [16, 2048])
def test_equal_to_library_and_best_fit(spark, documents, prose, limit):
    rows = [(i, prose(["xx", "yy", "zz"][i % 3], 5 + i * 7 % 400, i)) for i in range(120)]
    rows += [(1000 + i, text) for i, text in enumerate(ODD)] + [(None, "no id"), (5, "again"), (5, "again"), (7, rows[7][1])]
    rows += [(2000 + i, "the same hot text") for i in range(150)]
    check(X.pack_documents(documents(rows).repartition(5), PATH, limit), rows, limit)


def test_random_unicode(spark, documents):
    draw = random.Random(3)
    letters = [chr(c) for c in [*range(0x20, 0x250), 0x301, 0x308, 0x338, 0x3A3, 0x130, 0x2028, 0x3000, 0x4E2D, 0xAC00, 0x1F600, 0x1D400]] + list("  \n\t'.,stre")
    rows = [(i, "".join(draw.choices(letters, k=draw.randint(0, 60)))) for i in range(800)]
    check(X.pack_documents(documents(rows), PATH, 64), rows, 64)


def test_sequences_hold_their_pieces(spark, documents, prose):
    rows = [(i, prose("xx", 3 + i, i)) for i in range(60)]
    packed = X.pack_documents(documents(rows), PATH, 32, with_ids=True).cache()
    ids = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in X.sequences(packed).collect():
        parts = sorted((offset, x) for (sequence, offset), x in ids.items() if sequence == r.sequence_id)
        assert bytes(r.ids) == b"".join(x for _, x in parts) and r.n_tokens * 4 == len(r.ids) <= 128 and r.pieces == len(parts)


def test_empty_table(spark, documents):
    assert X.pack_documents(documents([]), PATH).count() == 0


def test_unknown_file_is_refused(spark, documents):
    with pytest.raises(ValueError):
        X.WordTokens(open(public_tokenizers.path("byte_bpe_50k.json")).read())


def test_few_words_are_remembered():
    """Two workers of an executor have to stay in a few hundred MB, whatever number of words they have met."""
    model = X.WordTokens(open(PATH).read())
    for number in range(450_000):
        model.words[str(number)]
    assert len(model.words) + len(model.words.old) <= 400_000
    assert model.encode("450000 449999") == model._word("450000"[:0]) + b"".join(model._word(c) for c in "450000449999")
