"""Failing lines are taken out of the documents that the quality stage keeps."""

from ledgerlens.llm import quality_rules

GOOD = "The river ran past the old mill and the people of the town walked along it every evening."


def test_kept_documents_lose_their_failing_lines(spark):
    rows = [
        (1, f"Home | News | Sport | Contact\n{GOOD}\n\nAnother sentence, with words of its own, stands here.\nAll rights reserved\n", 7),
        (2, f"{GOOD}\n\n Another line stands here. \n", 8),
        (3, "Home | News | Sport | Contact | And | Many | Other | Words | Stand | Here", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in quality_rules.keep_good(docs).collect()}
    text = f"{GOOD}\n\nAnother sentence, with words of its own, stands here.\n"
    assert set(out) == {1, 2}
    assert (out[1].text, out[1].n_chars) == (text, len(text))
    assert (out[2].text, out[2].n_chars) == rows[1][1:]
    assert quality_rules.keep_good(docs).schema == docs.schema


def failing(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "text string")
    lines = F.split("text", "\n")
    return [x for x, bad in zip(text.split("\n"), df.select(quality_rules.failing(lines, quality_rules.hints(F.col("text")))).first()[0]) if bad]


def test_lines_by_ratio_in_any_form(spark):
    bad = [
        "Home > News > Sport",
        "Home | News | Sport | Contact us",
        "### foo ### bar ### baz",
        "foo## bar## baz##",
        "BUY NOW! BEST PRICE! CALL TODAY!",
        "BUY EVERYTHING HERE NOW",
        "Really! Come in! Look at this!",
        "Tous droits réservés",
        "this line of many words simply stops in the middle of its sentence and never",
        "КУПЕТЕ СЕГА И НЕ ЧАКАЙТЕ",
    ]
    good = [
        GOOD,
        "A line that is wrapped at some column goes on in the next one, where the",
        "sentence ends.",
        "Er sagte: „Das kostet 5 % mehr als im Jahr 2020.“",
        "A heading",
        "He wrote C++ & C# code for R&D in 1999, and that was all of it, more or less.",
        "She asked \"why?\"",
        "",
        "Es war ein Fest! Alle kamen, sangen und tanzten bis in den Morgen, und keiner ging vor dem Frühstück nach Hause.",
    ]
    assert failing(spark, "\n".join(x + "\n" for x in bad)) == bad
    assert failing(spark, "\n".join(good)) == []
    menu = ["Home", "About us", "Our products", "Contact"]
    assert failing(spark, "\n".join([*menu, GOOD])) == menu and failing(spark, "\n".join([*menu[:3], GOOD])) == []


def test_windows_of_equal_hashes_are_told_apart(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    texts = ["a b c d e f a b c d e", "a b c d e f g h i j k l", "x " * 9, "a b c d e a b c d e f " * 3, "one two", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.filter(F.split("t", " "), lambda w: w != "").alias("w"))

    def want(t):
        w = t.split()
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        return len({k + o for k, x in enumerate(windows) if n[x] > 1 for o in range(5)})

    for h in (F.xxhash64, lambda *c: F.lit(7).cast("long"), lambda *c: F.xxhash64(c[0])):
        monkeypatch.setattr(quality_rules, "window_hash", h)
        assert [r[0] for r in df.select(quality_rules.repeated_words(F.col("w"))).collect()] == list(map(want, texts))
