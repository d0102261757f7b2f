import pytest
from pyspark.sql import SparkSession

import quarry.llm  # noqa: F401


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Texts with nulls, empties, white space, ties, repeats, punctuation and several scripts.
WORDS = "the cat sat on a mat while rain fell over old Town hall and été naïve straße people sang loud songs until dawn came back again".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def rows():
    base = [sentence(1, 60), sentence(2, 45), sentence(3, 200), sentence(5, 7)]
    out = [None, "", "   ", "\n\t ", "one", "One", "two words", "!!! ???", "a b c d", "a  b\tc\nd", "x" * 5000]
    out += base + [base[0]] * 3 + [base[0].upper()]
    words = base[2].split()
    out += [" ".join(words[:i] + ["Zebra"] + words[i + 1 :]) for i in (3, 50, 120)]
    out += [" ".join(words[:100]), "prefix " + base[1], base[1] + " suffix", sentence(8, 3000), "don't  stop -- it's 2024!\r\n" * 3]
    out += [sentence(k, 5 + k) for k in range(10, 26)] + [sentence(k, 5 + k) + " extra" for k in range(10, 26)]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, g string").repartition(3)
