import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from helpers import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; ids count from 0 unless given."""

    def build(texts, ids=None, sources=None):
        rows = [
            (k if ids is None else ids[k], t, "en", "a" if sources is None else sources[k], None if t is None else len(t))
            for k, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, and columns that operators use inside."""
    base = " ".join(prose(1, 300))
    near = base.replace(base.split()[150], "changed", 1)
    long_ = " ".join(prose(2, 30_000, 4000))
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, near, "en", None, None), (None, base, None, "b", 3), (None, None, None, None, None),
        (3, "", "en", "a", 0), (3, "", "en", "a", 0), (4, " \n\t ", "de", "b", 4), (5, long_, "en", "b", len(long_)), (6, "one two", "en", "c", 7),
        (7, "ONE two", "en", "c", 7), (8, "é日本😀 <|endoftext|> it's", "fr", "c", 22),
    ]
    schema = SCHEMA + ", cls long, uid string, size string, token int, text_hash string, shard string, slot string, label string, n long, end string"
    return spark.createDataFrame([r + (9, "u", "s", 1, "h", "x", "y", "l", 5, "e") for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
