import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, fp string, n_tokens string, ids string, keep string, shard string, spans string"


def prose(seed, words):
    draw = random.Random(seed)
    parts = ["an", "re", "the", "on", "ti", "er", "in", "st", "en", "ou", "é", "ñ"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(words))


def frame(spark, texts, start=0):
    """Documents with the given texts, ids from ``start``."""
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
