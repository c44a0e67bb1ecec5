from __future__ import annotations

import pytest


#: Names that operators use, or have used, for columns of their own; the user's stay as they are.
CLASHES = "_gone _s _h _n _block _stretch _fp _first _score _offset _start lines numbers nth source_name hash token size set root slot_rank _word _bit".split()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with all that may go wrong: nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{k % 977} other{k}" for k in range(30_000))
    texts = [None, "", " \n\t ", "one", "The same text here, said twice.\nAnd a second line of it.", "The same text here, said twice.\nAnd a second line of it.", long, "x" * 70_000, "Ümlaut ß 你好 🙂 a b", "password = hunter2hunter2"]
    rows = [(k, t, None if k == 3 else "en", f"src{k % 3}" if k != 4 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[4], rows[6], (None, "a row without an id", None, None, 1), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.selectExpr("*", "1 AS score", "2 AS fp", "'x' AS ids", "'y' AS h", "3 AS bucket", "4 AS slot", "5 AS place", "6 AS class", "7 AS _key", "8 AS row", "9 AS terms", *[f"{k} AS `{n}`" for k, n in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
