import pytest

WORDS = "stone river light garden under bright window carry small distant walk morning over paper cloud quiet green table music winter bridge letter ocean north family answer yellow simple market engine".split()


def prose(seed: int, n: int = 80) -> str:
    """Different text for each seed: n words in lines of ten."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str(x % 97) if x % 5 == 0 else "") + ("\n" if k % 10 == 9 else " "))
    return "".join(out).strip()


LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def documents(spark):
    """Ordinary rows, and every odd one: nulls in any column, empty and blank and very long texts, ties, repeated rows, an
    id with two texts, and extra columns under names that operators use themselves."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 10) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \n\t ", "en", "s1", 4), (33, LONG, "en", "s1", len(LONG)), (None, prose(900), "en", "s2", 9)]
    rows += [(34, prose(3), "en", "s2", 9), (35, prose(3), "en", None, 9), (36, prose(36), "en", "s0", 9), (36, prose(36), "en", "s0", 9), (37, prose(370), "en", "s0", 9), (37, prose(371), "en", "s1", 9)]
    made = [(*r, 1.5, "k", 7, [1, 2]) for r in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, examples array<int>")


@pytest.fixture(scope="session")
def none(spark, documents):
    return spark.createDataFrame([], documents.schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
