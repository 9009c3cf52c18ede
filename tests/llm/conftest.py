import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
OTHER = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"


def words(text):
    return WORD.findall(text or "")


#: Nulls, blanks, repeated rows, a shared passage, near copies, odd white space, wide characters, a very long text.
ROWS = [
    (5, BASE), (3, OTHER + "\t" + BASE), (9, BASE), (9, BASE), (1, None), (2, ""), (4, " \n\t "), (6, "short text"), (7, "short text"), (8, BASE.replace("omega", "end") + " more"),
    (10, "é ü ß " + BASE.upper()), (11, "x" * 5000), (12, " ".join(f"w{i % 977}" for i in range(30000))), (13, OTHER), (None, BASE), (14, "one two three four"), (15, "one two three four"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, blob string, __text string"


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", None, 1, "b", "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
