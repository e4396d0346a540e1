import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded texts with copies, near copies, shared passages, empty, null and odd ones; ids repeat and are null."""
    import random

    r = random.Random(5)
    vocabulary = [a + b for a in WORDS for b in ("", "s", "ing", "é", "X")]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 150))) for _ in range(60)]
    passage = " ".join(r.choices(vocabulary, k=60))
    texts += [f"{r.choice(vocabulary)} {passage} {r.choice(vocabulary)}" for _ in range(8)]
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[1] + " ", "", None, " \t", "same " * 80, "one", "one two", "ÀB àb Ça", "\U0001f600 x"]
    texts += [" ".join(texts[3].split()[:-1] + ["changed"]), "long " + " ".join(r.choices(vocabulary, k=4000))]
    rows = [(i, t, r.choice(["a", "b", "B", None]), r.choice(["en", None])) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "no id", "a", "en"), (None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, prose):
    return spark.createDataFrame([(*row, 0, "clash") for row in prose], "doc_id long, text string, source string, lang string, n_chars long, __odd string").repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
