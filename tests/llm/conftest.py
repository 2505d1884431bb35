import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("size", "shard", "kept", "media", "score", "s", "id", "h", "node", "epochs", "last", "n_lines", "rid", "token", "target", "clean_text")],
    ]
)


def rows():
    """Texts of every awkward kind: null, empty, spaces, long, ties, copies, near copies, repeated rows, null ids and sources."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 7))) for _ in range(160)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared_line = "This line of boilerplate is in very many of the documents here."
    texts = [None, "", "   \n\t ", "\n\n", "one", "Two words", "é" * 50 + "\n" + "É" * 50, "x" * 5000]
    texts += ["\n".join(say(rng.randint(5, 14)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    base = say(120)
    texts += [base, base, base.upper(), base + " tail", base.replace(words[0], "changed")]
    texts += [say(30) + "\n" + shared_line + "\n" + say(12) for _ in range(14)]
    texts += [say(9000), " a b  c　 d\n e "]
    out = []
    for i, t in enumerate(texts):
        source = None if i % 13 == 5 else f"src{0 if i % 3 else i % 5}"
        out.append((None if i == 9 else i, t, "en", source, None if t is None else len(t), *["clash"] * 16))
    return [*out, out[20], out[20], out[60]]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
