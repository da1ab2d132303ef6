"""Small tables for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))

TONGUES = {
    "en": "the and of to in that was for with this from they have been which their would there could other".split(),
    "de": "der die und nicht sich mit auch werden einer wurde über durch können müssen während größer".split(),
    "fr": "les des une dans pour qui était avec sont être même après où leurs français très déjà".split(),
}


def sentence(rng: random.Random, lang: str, words: int = 40) -> str:
    return " ".join(rng.choice(TONGUES[lang]) for _ in range(words))


def corpus(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, of: int = 5000) -> list[str]:
    return [f"w{rng.randrange(of)}" for _ in range(n)]
