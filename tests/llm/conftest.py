import random

import pytest

SYLLABLES = {"en": "the ing and th er ou wh sh ea ly".split(), "de": "sch ein ich ung ver be zu ö ü ge".split(), "fr": "eau que ment les tion é è oi re ou".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text, lang, source, n_chars): nulls, empty and blank texts, repeats, ties, one long text, near and exact copies."""
    rng = random.Random(11)
    texts = []
    for i in range(40):
        lang = ("en", "de", "fr")[i % 3]
        texts.append((prose(rng, lang, rng.randint(3, 120)) + ".\n" + prose(rng, lang, 12) + ". " + prose(rng, lang, 9), lang))
    texts += [(texts[0][0], "en"), (texts[0][0], "en"), (texts[1][0].upper(), "de")]
    texts += [(t.replace(t.split()[5], "changed", 1), lang) for t, lang in texts[:6]]
    texts += [("common line of every text here\n" + prose(rng, "en", 30), "en") for _ in range(8)]
    texts += [(None, "en"), ("", None), ("   \t\n \x0b", "fr"), ("1234 !?", None), ("Ünïcode ＷＩＤＥ 漢字 🙂 text", "xx"), ("same same same " * 4000, "en"), (None, None)]
    rows = [(i * 3, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    rows += [rows[2], rows[2], (None, "a row without an id, in plain words", "en", None, 35), (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that no operator knows, with names that they use inside.
EXTRA = ["row", "key", "at", "fp", "spans", "score", "quality", "n_words", "component_id", "lang_pred", "half", "anchor", "id", "path", "__row", "__gone"]


@pytest.fixture(scope="session")
def docs(spark, messy):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy, SCHEMA).repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))


@pytest.fixture(scope="session")
def clean(spark, messy):
    """Without repeated or null ids."""
    seen, rows = set(), []
    for r in messy:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    return rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
