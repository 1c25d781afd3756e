import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with columns whose names clash with internal ones."""

    def make(rows):
        data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 7) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_units string, covered int")

    return make


#: Empty, null, very long, repeated and odd texts.
ODD = [None, "", " ", "\n\n\n", "word", "two words", "a" * 5000, "é" * 300 + " ñandú 日本 🙂", "same text here today", "same text here today", "tab\tand\x0bvt\x1csep", "\x00nul"]


@pytest.fixture(scope="session")
def odd():
    return list(enumerate(ODD)) + [(None, "no id"), (8, "same text here today")]
