from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """documents with nulls, an empty and a very long text, ties, repeated rows."""
    long = " ".join(f"w{i % 997}x{i // 997}" for i in range(20_000))
    rows = [
        (0, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3, "en", "src0", 1),
        (1, None, "en", "src0", None),
        (2, "", None, "src1", 0),
        (3, long, "en", None, None),
        (4, " \t\r\n\x0b\x0c ", "fr", "src1", 3),
        (5, "one two three\none two three\n\n\nfour # $ % ééé", "fr", "src1", 3),
        (5, "one two three\none two three\n\n\nfour # $ % ééé", "fr", "src1", 3),
        (None, "a b c d e f g h " * 4, "de", "src2", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
