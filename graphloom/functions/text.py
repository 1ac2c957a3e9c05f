"""Text functions: search tokens, n-grams, windows, entities."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What search tokens are made of, and what separates them.
TOKEN, SEPARATOR = r"[\p{L}\p{N}_-]+", r"[^\p{L}\p{N}_-]+"
#: Words that start sentences or mark roles, which are no entities.
STARTERS = tuple("""
Absolutely Additionally Alongside Although Among And Anyway Around As Attending Beautifully Before Being Beyond Building But Certainly
Collaboration Community Considering Creating Depending Despite Doing During Each Either Engaging Enjoying Especially Even Every Exploring
Finally First Following Furthermore Generally Given Going Having Hello Here However Importantly Indeed Initially Initiatives Interesting
Just Knowing Last Letting Likewise Looking Making Many Maybe Meanwhile Moreover Most Much Nevertheless New Next Note Now Often Once One
Only Originally Other Otherwise Our Overall Particularly People Perhaps Please Plus Practicing Probably Putting Recently Regarding
Remember Same Seeing Several Similarly Since Some Sometimes Soon Specifically Starting Still Such Sure Taking Than Thanks That The Their
Then There Therefore These They This Those Though Through Throughout Thus Together Towards Trying Understanding Unfortunately Unless
Until Upon Usually Very Watching Well What When Whenever Where Whether Which While Who Why With Within Without Working Yes Yet You Your
Also Did Embracing For Have How Instead Lastly Not Reflecting Ultimately
Conducting Connecting Continuing Discovering Discussing Focusing Implementing Integrating Learning Living Managing Preparing Pursuing Sharing Studying
User USER Assistant ASSISTANT System SYSTEM
""".split())
#: Words that are no key words, beside those of fewer than three letters.
STOP_WORDS = tuple("""
the and for are but not you all can her was one our out day get has him his how man new now old see two way who boy did its let put say
she too use this that with from they them have been were will into your what when make like just than then look only come over also back
after work first well even want give most very such here there would could should
""".split())
#: Markers of a turn's role, in the order in which they are taken out.
ROLE_MARKERS = (r"(?i)\[USER\]\s*User:?\s*", r"(?i)\[ASSISTANT\]\s*Assistant:?\s*", r"(?i)\[SYSTEM\][^\n]*\n?", r"(?i)\[USER\]", r"(?i)\[ASSISTANT\]", r"(?i)\[SYSTEM\]")
#: A run of letters, digits and underscores in any script, and the shapes of runs that are entities.
WORD, NAME, MEASURE = r"[\p{L}\p{N}_]+", r"[A-Z][A-Za-z0-9]{2,}", r"[0-9]{4}|[0-9]+(km|min|s|hr|h|m|kg)"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the ASCII letters that they are made from."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xDF, 0x250)]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base.islower()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


ACCENTED, PLAIN = _accents()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """text in lower case, Latin letters without their marks. Text of one byte a character has none."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, PLAIN))


def fold(word: str) -> str:
    """A word of a query as folded() would have it."""
    return word.lower().translate(str.maketrans(ACCENTED, PLAIN))


def tokens(*parts: Column) -> Column:
    """Folded search tokens of the parts, one after the other; null parts have none."""
    return F.filter(F.split(folded(F.concat_ws(" ", *parts)), SEPARATOR, -1), lambda w: w != "")


def key_tokens(text: Column) -> Column:
    """Words of three letters or more, in lower case, but for stop words and role markers. Text without a bracket has no marker."""
    bare = text
    for marker in ROLE_MARKERS:
        bare = F.regexp_replace(bare, marker, " ")
    bare = F.when(F.contains(text, F.lit("[")), bare).otherwise(text)
    return F.filter(F.split(F.lower(bare), r"[^\p{L}\p{N}_]+", -1), lambda w: (F.char_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def ngrams(words: Column, n: int) -> Column:
    def grams(w: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(parts)

    return let(words, grams)


def char_windows(text: Column, width: int, stride: int) -> Column:
    """Windows of width characters every stride, the last one that which reaches the end; a text that fits in one has none."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), n - width + stride - 1, F.lit(stride))
    return F.when(n <= width, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width))))


def word_windows(text: Column, width: int, stride: int) -> Column:
    """Windows of width words, from a first word's start to a last word's end with the white space between kept."""
    def windows(x: Column) -> Column:
        words, after = x["words"], x["after"]
        # Each word but a window's last is followed by its white space.
        whole = F.zip_with(words, F.slice(after, F.lit(2), F.size(words)), lambda w, gap: F.concat(w, gap))
        starts = F.sequence(F.lit(1), F.size(words) - width + stride, F.lit(stride))
        last = lambda i: F.least(i + width - 1, F.size(words))
        return let(whole, lambda y: F.transform(starts, lambda i: F.concat(F.array_join(F.slice(y, i, last(i) - i), ""), F.element_at(words, last(i)))))

    parts = F.struct(F.regexp_extract_all(text, F.lit(r"\S+"), 0).alias("words"), F.split(text, r"\S+", -1).alias("after"))
    return let(parts, lambda x: F.when(F.size(x["words"]) <= width, F.array().cast("array<string>")).otherwise(windows(x)))


def paragraphs(text: Column, boundary: str = "\n", min_chars: int = 1) -> Column:
    """Trimmed segments between boundaries; a text of fewer than two has none."""
    parts = F.filter(F.transform(F.split(text, boundary, -1), lambda x: F.trim(x)), lambda x: F.char_length(x) >= min_chars)
    return let(parts, lambda p: F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(p))


def entities(text: Column) -> Column:
    """Sorted names, years, measures and prices; a word is what has no letter, digit or underscore beside it, in any script."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))
    named = F.filter(words, lambda w: (w.rlike(f"^{NAME}$") & ~w.isin(*STARTERS)) | w.rlike(f"^({MEASURE})$"))
    prices = F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}\p{N}_])\$[0-9]+(?![\p{L}\p{N}_])"), 0)
    return F.array_sort(F.array_distinct(F.concat(named, prices)))


def truncated(text: Column, most: int) -> Column:
    """text in at most `most` characters, cut after a word and with three dots if it is longer."""
    if most <= 3:
        return F.substring(text, 1, most)
    head = F.substring(text, 1, most - 3)
    cut = F.char_length(head) - F.locate(" ", F.reverse(head))
    by_word = F.when((F.locate(" ", head) > 0) & (cut > 0), F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.rtrim(by_word), F.lit("...")))
