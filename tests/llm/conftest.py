from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to ``doc_id, text, lang, source, n_chars`` with clashing extra columns."""
    def made(rows):
        full = [(i, t, "en", s, len(t or ""), "x", 1, 2) for i, t, s in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, line string, copy int, id int"
        )

    return made
