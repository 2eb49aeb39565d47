"""Small tables with the cases every operator must define."""

import pytest

WORDS = "amber birch cedar dune ember fjord grove heath islet jetty knoll lagoon marsh nook oasis pond quarry ridge slope tarn upland vale weir yard zephyr".split()


def sentence(seed: int, n: int) -> str:
    """n words that look alike for no two seeds."""
    return " ".join(WORDS[(seed * 7 + i * (seed % 11 + 3) + i * i % 13) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


LONG = " ".join(sentence(i, 200) for i in range(500, 700))  # 40,000 words
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    sentence(1, 60),
    sentence(1, 60),  # an exact copy under another id
    sentence(1, 59) + " changed",
    sentence(2, 40) + "\n" + sentence(3, 12) + "\n\n" + sentence(4, 30),
    sentence(5, 40) + "\n" + sentence(3, 12) + "\n" + sentence(6, 30),
    "äöü ß 漢字 🙂 " + sentence(7, 30),
    "\x00 nul and \r\n line ends\r\n" + sentence(8, 25),
    "#" * 50 + " " + sentence(9, 20),
    LONG,
]
#: Columns whose names the operators might use inside.
CLASHES = ("text_hash", "rid", "w", "h", "node", "id", "n_words", "shard", "address", "hit", "key", "label", "cand", "_removed", "bands", "TH")


@pytest.fixture(scope="session")
def documents(spark):
    """With a repeated row, a null id (twice), and extra columns with clashing names."""
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, sentence(10, 30), None, None), (None, None, None, None)]
    rows = [(*r, len(r[1]) if r[1] is not None else None, *[f"x{k}" for k in range(len(CLASHES))]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, sentence(4, 30)), (2, None), (3, ""), (4, "one"), (None, sentence(6, 20)), (5, sentence(4, 30)), (6, "äöü ß")]
    return spark.createDataFrame(rows, "item_id long, text string")
