"""Small tables with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

WORDS = {
    "en": "the and then with over under tion ing house river stone bright walking morning".split(),
    "de": "der und dann mit über unter schaft ung haus fluss stein hell gehend morgen früh".split(),
}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ",", "en", "lich" if lang == "de" else "ly"]) for _ in range(n))


def documents(seed=0, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        text = "\n".join(sentence(r, lang, r.randrange(5, 30)) for _ in range(r.randrange(1, 5)))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    base = rows[1][1]
    odd = [None, "", " ", "\n\t \x0b", "one", "two words", "éa b c d e f", base, base + " tail", "x " * 3000, "!!! ###", "line\nline\nline\nother words here now", "a b c d e f a b c d e g"]
    rows += [(n + k, t, None if k % 4 == 0 else "en", "hot", None if t is None else len(t)) for k, t in enumerate(odd)]
    rows += [rows[2], (None, "no id here at all", "en", "s0", 17), (None, base, "en", "s0", len(base))]
    return rows


def frame(spark, rows=None, ddl=DOCS):
    return spark.createDataFrame(rows if rows is not None else documents(), ddl)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    extra = ["score", "component_id", "fp", "n_words", "kept", "__row", "__text", "rate", "p", "piece", "length", "quality", "fingerprint", "refers_to", "payload", "states"]
    return df.withColumns({c: F.lit("x") for c in extra if c not in df.columns})
