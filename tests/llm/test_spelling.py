import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import queries
from ledgerline.llm import spelling as X


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """Rows of the contract by comparing every two words."""
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for word in words:
        best = min(near[word], key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None
    rows = []
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        rows.append((word, counts[word], len(near[word]), form[word], counts[form[word]] if form[word] else None, root))
    return sorted(rows)


def contract_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def collected(frame):
    return sorted(tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect())


def vocabulary(seed, size, letters="abcé", longest=9):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.randint(5, longest))) for _ in range(size)}
    for word in list(words)[: size // 2]:
        at = draw.randrange(len(word))
        words |= {word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[:at] + draw.choice(letters) + word[at + 1 :]}
    return {w: draw.choice([3, 5, 9, 20, 41, 90, 200]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("seed, letters, longest, least", [(1, "abcé", 9, 30), (2, "ab", 8, 3), (3, "abcdefghijÿ", 14, 1), (4, "aaab", 12, 30)])
def test_equal_to_comparing_all_words(spark, monkeypatch, seed, letters, longest, least):
    monkeypatch.setattr(X, "LEAST_PLACES", least)
    counts = vocabulary(seed, 300, letters, longest)
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    assert collected(X.group_variants(frame)) == plain(counts)


@pytest.mark.parametrize("seed", range(4))
def test_signatures_of_near_words_meet(seed):
    draw = random.Random(seed)
    counts = vocabulary(seed, 400, "abcd" if seed % 2 else "ab")
    places = Counter(m[i : i + n] for w in counts for m in [X.BEGIN + w + X.END] for n in range(2, 6) for i in range(len(m) - n + 1))
    frequent = {g: n for g, n in places.items() if n > draw.choice([2, 20, 200])}
    frequent |= {g[:n]: places[g[:n]] for g in list(frequent) for n in range(2, len(g))}
    words = sorted(counts)
    for i, a in enumerate(words):
        grams = X.grams_of(a, frequent)
        assert 0 < X.affected(grams) <= X.LONGEST and len(grams) == len(a) + 1
        for b in words[i + 1 :]:
            if one_edit(a, b):
                short, long = sorted((a, b), key=len)
                mine, theirs = set(X.signature(short, frequent)), set(X.signature(long, frequent))
                steps = [0] if len(a) == len(b) else [0, 1]
                assert any((place + step, gram) in theirs for place, gram in mine for step in steps), (a, b)


def test_chain_of_forms(spark):
    counts = {"aaaaa" + "b" * i: 3 * 2**i for i in range(20)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = collected(X.group_variants(frame))
    assert got == plain(counts) and {r[-1] for r in got} == {"aaaaa" + "b" * 19}


def test_contract(spark, documents, prose, monkeypatch, tmp_path):
    monkeypatch.setattr(X, "HELD", 50)
    monkeypatch.setattr(X, "BLOCK", 40)
    rows = [(i, prose(["xx", "yy", "zz"][i % 3], 150, i % 40)) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "12 ,. 中文中文中"), (None, "ORDER order OrDeR ÀÖ×÷ß àö×÷ß"), (203, "order ÀÖ×÷ß " * 5), (203, "order ordér ordér ordér ORDÉR"), (204, "x" * 3000 + " " + "y" * 70), (204, ("x" * 3000 + " ") * 3 + ("x" * 3001 + " ") * 7)]
    documents(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    want = plain(contract_counts(rows))
    assert collected(found) == want and any(r[3] for r in want)


def test_empty_and_short(spark, documents):
    assert X.spelling_variants(documents([])).count() == 0
    assert X.spelling_variants(documents([(1, "a b c")])).count() == 0
    with pytest.raises(ValueError):
        X.group_variants(spark.createDataFrame([("abcd", 3)], "word string, n bigint"))
