import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the and of to in is that for with this from are was which have".split(),
    "de": "der und die von mit ist das für nicht auch eine über schön größe".split(),
    "fr": "le et de la que une dans pour être où très même été avec".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    stems = WORDS[lang]
    return " ".join(rng.choice(stems) if rng.random() < 0.5 else rng.choice(stems) + rng.choice(stems) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents from (id, text) or (id, text, lang) rows."""

    def make(rows, extra: str = ""):
        full = [(*r, None, None, None)[:3] if len(r) == 2 else tuple(r) for r in rows]
        named = [(i, t, lang, f"src{k % 3}" if k % 4 else None, len(t) if t else None) for k, (i, t, lang) in enumerate(full)]
        df = spark.createDataFrame(named, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"cast('x' as string) as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    long = prose("en", 30_000, 1)
    rows = [
        (1, "One two three four five six seven eight.", "en"), (2, "one  two three four\tfive six seven eight.", "en"),
        (2, "One two three four five six seven eight.", "en"), (3, None, None), (4, "", "en"), (5, " \n\t ", None),
        (None, "no id here at all but words", "en"), (None, None, None), (6, long, "en"), (7, long + " end", "en"), (8, long, None),
        (9, "x" * 50_000, "en"), (10, "12345 %% 678", "de"), (11, "naïve 日本語 🙂 é", "fr"), (11, "naïve 日本語 🙂 é", "fr"),
        (11, "other text under the same id", "en"),
    ]
    names = "ids _norm _digest _maybe _word row row_key key id digest size part shard score held_out marks url spans _held"
    return frame(rows, names)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
