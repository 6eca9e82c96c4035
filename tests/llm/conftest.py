import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents from (id, text) or (id, text, lang, source) rows, with extra columns whose names clash with internal ones."""

    def make(rows):
        full = [(tuple(r) + (None,) * 4)[:4] + (None, i, f"r{i}", -1) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENTS + ", size int, digest string, score int")

    return make


@pytest.fixture
def prose():
    """Invented words of one language each, the same for the same seed."""
    parts = {"xx": ["ka", "to", "mi", "ru", "sel"], "yy": ["schn", "au", "gr", "öf", "eit"], "zz": ["ère", "ou", "lle", "pa", "né"]}

    def make(lang, words, seed):
        draw = random.Random(f"{lang}{seed}")
        return " ".join("".join(draw.choices(parts[lang], k=draw.randint(1, 3))) for _ in range(words))

    return make
