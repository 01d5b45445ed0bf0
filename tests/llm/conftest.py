import random

import pytest
from pyspark.sql import types as T

#: Names that operators use inside, as columns of the input.
CLASHING = ["id", "node", "component", "kept", "score", "lang_pred", "rank", "salt", "length", "tokens", "random", "contaminated", "block", "email", "label"]


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(1 + rng.randrange(3))) + str(rng.randrange(size) % 7) * 0 for _ in range(n)]


def make_texts() -> list:
    """Ordinary, repeated, near-equal, empty, null, blank, tiny and very long texts."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(3, 160))) for _ in range(60)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage = " ".join(words(rng, 50))
    shared = [f"{' '.join(words(rng, 20))} {passage}\n{' '.join(words(rng, 15))}" for _ in range(5)]
    hot = [base[40]] * 25
    long = [" ".join(words(rng, 30_000)), "x" * 50_000]
    odd = [None, None, "", " \n\t ", "a", "Straße État ÉÀ", "日本語 テキスト", "it's I'm 12.5 %", "1234 5678", "<|endoftext|> y", "x  y é"]
    return base + base[:5] + near + shared + hot + long + odd


@pytest.fixture(scope="session", autouse=True)
def shared_checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def texts():
    return dict(enumerate(make_texts()))


def frame_of(spark, rows):
    """doc_id, text and clashing columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(i, t, *["?"] * len(CLASHING)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame_of(spark, texts.items()).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame_of(spark, [])


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: frame_of(spark, rows)
