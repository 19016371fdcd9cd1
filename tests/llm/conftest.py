import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts every operator must take: null, empty, blank, tabs, non-ASCII, one very long word, repeats.
ODD = [
    None,
    "",
    " ",
    "\n\n  \n",
    "a\tb\r\nc\x0bd",
    "plain words, plain words.  Two spaces\nand a line",
    "été ß 日本語 🙂🙂 ﬁ naïve",
    "<|endoftext|> <unk> <0x41> ▁x",
    "x" * 5000,
    "it's they'll 12345 !!!??? $$$",
    "plain words, plain words.  Two spaces\nand a line",
    " leading and trailing  ",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts; repeated and null ids, and columns whose names clash with the operators' own."""
    rows = [(i if i != 5 else None, t, "zz", i, i, i) for i, t in enumerate(ODD)] + [(1, "", "zz", 0, 0, 0)]
    schema = "doc_id long, text string, lang string, length long, start long, pack_group long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
