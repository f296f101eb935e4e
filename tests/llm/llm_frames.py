"""Fixture data of the training-data operators."""

SCHEMA = "doc_id long, text string, score string, kept string, fp string, spans string, word string, _verdict string, chunk string, place string, n_tokens string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def prose(rnd, n, words=400):
    vocabulary = ["".join(rnd.choice("abcdefghinorstué") for _ in range(rnd.randint(2, 8))) for _ in range(words)]
    return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(n))
