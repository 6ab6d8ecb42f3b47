"""Line-first quality rules, as Column expressions only: no Python runs per row and nothing is shuffled.

Each line is judged by ratios, in any language: a line of several words with hardly a sentence in it and without
end punctuation, which the next line doesn't go on with, short items between separators, mostly symbols, mostly capitals, exclamation marks
every few words, boilerplate phrases in a short line, and short unpunctuated lines where most of a text's lines
are such (menus). Failing lines are removed; a document that loses more than MAX_LOSS_PERCENT of its characters
is rejected. Base counts reject documents that are too short or that mostly repeat themselves.

Cases: a null text has no words and is rejected like an empty one; other columns may be null, repeated or
carry any name. Lengths count code points. Equal rows get equal results. An empty table gives an empty one.
Very long texts: windows of words are told apart by their words, not by hashes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is rejected when more than this percentage of its characters stands in failing lines.
MAX_LOSS_PERCENT = 50
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Marks that end a sentence, and what may follow them.
ENDS = (".", "!", "?", "…", ":", ";", ",", "-", "。", "！", "？", "」")
CLOSING = "\"')»”’] "
#: A line of this many words or more needs end punctuation, a next line that goes on in lower case, or a sentence's end in every SENTENCE_WORDS words.
OPEN_WORDS, SENTENCE_WORDS = 12, 30
SENTENCE_ENDS = ".!?…。！？"
#: Separators of navigation items, and the words an item has at most on average.
SEPARATORS = "|»›·•>"
ITEM_WORDS = 4
#: Characters that hardly stand in prose; a line fails with more of them than this percentage of its letters.
MARKS = "#*$%&<>|~^_=+\\{}[]@"
MAX_MARK_PERCENT = 10
EXCLAMATIONS = "!¡"
#: Lines of at most this many words without end punctuation are menu lines where they are MENU_LINES or more and the most of a text's lines.
SHORT_WORDS, MENU_LINES = 4, 4
#: Phrases of site furniture; a line of at most BOILERPLATE_WORDS words with one fails.
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "subscribe to our", "click here", "sign up for",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic",
)


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def _letters(line: Column) -> Column:
    """Characters of a line but blanks."""
    return F.length(F.replace(line, F.lit(" "), F.lit("")))


def _words(line: Column) -> Column:
    """Words of a trimmed line, as its blanks and one."""
    return F.length(line) - _letters(line) + 1


def _is_open(line: Column) -> Column:
    return ~F.substring(F.rtrim(line, F.lit(CLOSING)), -1, 1).isin(*ENDS)


def _goes_on(following: Column) -> Column:
    """Whether a line starts with a lower-case letter; false where there is none."""
    c = F.substring(F.trim(following), 1, 1)
    return F.coalesce((c == F.lower(c)) & (c != F.upper(c)), F.lit(False))


def is_menu_line(line: Column) -> Column:
    return _is_open(F.trim(line)) & (_words(F.trim(line)) <= SHORT_WORDS)


def _some_phrase(text: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out |= F.contains(text, F.lit(phrase))
    return out


#: What lines of these kinds have at least; where a whole text has none, its lines aren't looked at for it.
ODD = "[" + "".join("\\" + c for c in MARKS + SEPARATORS + EXCLAMATIONS) + "]"
TWO_CAPITALS = r"\p{Lu}\p{Lu}"


def hints(text: Column) -> Column:
    return F.struct(text.rlike(ODD).alias("odd"), text.rlike(TWO_CAPITALS).alias("capitals"), _let(F.lower(text), _some_phrase).alias("phrase"))


def line_fails(line: Column, following: Column, in_menu: Column, hint: Column) -> Column:
    """in_menu: whether the text's short open lines are a menu."""
    line = F.trim(line)
    words, letters, seps, exclaimed = _words(line), _letters(line), _count(line, SEPARATORS), _count(line, EXCLAMATIONS)
    return (
        (_is_open(line) & ((in_menu & (words <= SHORT_WORDS)) | ((words >= OPEN_WORDS) & ~_goes_on(following) & (SENTENCE_WORDS * _count(line, SENTENCE_ENDS) < words))))
        | (hint["odd"] & line.rlike(ODD) & ((seps >= 2) & (words <= ITEM_WORDS * (seps + 1) + seps) | (100 * _count(line, MARKS) > MAX_MARK_PERCENT * letters) | (exclaimed >= 3) & (4 * exclaimed >= words)))
        | (hint["capitals"] & line.rlike(TWO_CAPITALS) & (words >= 3) & (2 * F.length(F.regexp_replace(line, r"\P{Lu}+", "")) > letters))
        | (hint["phrase"] & (words <= BOILERPLATE_WORDS) & _let(F.lower(line), _some_phrase))
    )


def _has_words(line: Column) -> Column:
    return line.rlike(WORD)


def failing(lines: Column, hint: Column) -> Column:
    """Whether each of an array of lines fails; blank ones don't."""
    some = F.size(F.filter(lines, _has_words))
    menu = F.size(F.filter(lines, lambda x: is_menu_line(x) & _has_words(x)))
    is_menu = (menu >= MENU_LINES) & (2 * menu > some)
    return _let(is_menu, lambda m: F.transform(lines, lambda x, i: line_fails(x, F.get(lines, i + 1), m, hint) & _has_words(x)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Hash of a window's words; equal hashes are compared word by word.
window_hash = F.xxhash64


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur at least twice in the array, first occurrence included.

    Where all windows' 64-bit hashes differ there are none. Else each hash keeps its high bits and takes its
    position in the low ones, as many as the word count needs; one primitive sort then brings equal windows
    together in position order. Where windows of equal hashes differ in their words, the text's windows are
    sorted by their words instead.
    """
    bits = F.length(F.bin(F.size(words).cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    n = F.size(words) - WINDOW + 1
    each = F.sequence(F.lit(0), n - 1)

    def packed(h: Column, i: Column) -> Column:
        return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

    def high(x: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, bits)

    def window(x: Column) -> Column:
        return F.slice(words, x.bitwiseAND(mask).cast("int") + 1, WINDOW)

    def twice(s: Column, same) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))

    def covered(positions: Column) -> Column:
        at = F.sort_array(positions)
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def by_words() -> Column:
        rows = F.array_sort(F.transform(each, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.cast("long").alias("i"))))
        return _let(rows, lambda s: covered(F.transform(twice(s, lambda a, b: a["w"] == b["w"]), lambda x: x["i"])))

    def by_hash(t: Column) -> Column:
        mixed = F.exists(F.transform(t, lambda x, i: F.coalesce((high(x) == high(F.get(t, i + 1))) & (window(x) != window(F.get(t, i + 1))), F.lit(False))), lambda x: x)
        return F.when(mixed, by_words()).otherwise(covered(F.transform(t, lambda x: x.bitwiseAND(mask))))

    zero = F.lit(0).cast("long")

    def repeats(hashes: Column) -> Column:
        hits = _let(F.sort_array(F.transform(hashes, packed)), lambda s: twice(s, lambda a, b: high(a) == high(b)))
        return F.when(F.size(F.array_distinct(hashes)) == n, zero).otherwise(_let(hits, lambda t: F.when(F.size(t) == 0, zero).otherwise(by_hash(t))))

    return F.when(n < 2, zero).otherwise(_let(F.transform(each, lambda i: window_hash(*[F.get(words, i + k) for k in range(WINDOW)])), repeats))


def measures(text: Column) -> Column:
    """Struct of the base counts and of the line rules' loss for one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    on_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), total(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))

    def judged(a: Column, hint: Column) -> Column:
        some = F.filter(a, _has_words)
        return F.struct(
            (F.size(some) - F.size(F.array_distinct(some))).cast("long").alias("n_dup_lines"),
            total(some).alias("line_chars"),
            _let(failing(a, hint), lambda f: total(F.filter(a, lambda x, i: F.get(f, i)))).alias("lost_chars"),
        )

    n_symbols = F.when(text.rlike(f"[{SYMBOLS}]"), _count(text, SYMBOLS)).otherwise(0).cast("long")
    on_lines = _let(F.split(text, "\n"), lambda a: _let(hints(text), lambda h: judged(a, h)))
    return F.struct(on_words.alias("w"), on_lines.alias("l"), n_symbols.alias("n_symbols"))


def clean_text(text: Column) -> Column:
    """The text without its failing lines."""
    text = F.coalesce(text, F.lit(""))
    kept = lambda a, h: _let(failing(a, h), lambda f: F.array_join(F.filter(a, lambda x, i: ~F.get(f, i)), "\n"))
    return _let(F.split(text, "\n"), lambda a: _let(hints(text), lambda h: kept(a, h)))


def _verdict(m: Column) -> tuple[Column, Column]:
    n = m["w"]["n_words"]
    base_failed = (n < MIN_WORDS) | (100 * m["w"]["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    return base_failed, ~base_failed & (100 * m["l"]["lost_chars"] <= MAX_LOSS_PERCENT * m["l"]["line_chars"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, line_chars, lost_chars, base_failed and kept for every row."""
    # an explode of one element keeps the measures from being computed once per use
    m = docs.select("doc_id", F.explode(F.array(measures(F.col("text")))).alias("m"))
    base_failed, kept = _verdict(F.col("m"))
    return m.select(
        "doc_id",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.w.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        kept.alias("kept"),
        F.col("m.l.line_chars").alias("line_chars"),
        F.col("m.l.lost_chars").alias("lost_chars"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that are kept, without their failing lines; n_chars, where there is one, is that of the new text. Other columns stay as they came."""
    m = "__quality_measures"
    held = docs.select("*", F.explode(F.array(measures(docs["text"]))).alias(m)).where(_verdict(F.col(m))[1])
    cleaned = held.withColumn("text", F.when(F.col(m)["l"]["lost_chars"] > 0, clean_text(F.col("text"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(m)["l"]["lost_chars"] > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.drop(m)
