"""Column expressions over texts: tokens, statistics, sentiment, numbers, cleaning, similarity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.config import CLEAN_PENALTIES, LEXICONS

WORD = r"[\p{L}\p{N}_]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


#: A whole word of two characters or more that is not all digits: one pattern, so that words need no second look.
_TOKEN = r"((?<![\p{L}\p{N}_])(?!\p{Nd}+(?![\p{L}\p{N}_]))[\p{L}\p{N}_]{2,}+)"


def tokens(text: Column, stop_words: Sequence[str] = (), pattern: str = WORD) -> Column:
    """Words longer than a character that are neither all digits nor stop words, in order."""
    known = F.coalesce(text, F.lit(""))
    if pattern == WORD:
        words = F.regexp_extract_all(known, F.lit(_TOKEN), F.lit(1))
    else:
        words = F.filter(F.regexp_extract_all(known, F.lit(f"({pattern})"), F.lit(1)), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\p{Nd}+$"))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def pieces(text: Column, pattern: str) -> Column:
    """The trimmed parts between matches of ``pattern`` that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != "")


def count_in(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


_BLANK, _DIGITS = " \t\n\x0b\x0c\r", "[0-9]+(?:_[0-9]+)*"


def whole_number(text: Column) -> Column:
    """The number that a text is, as an integer: halves go away from zero; exponents, digits parted by ``_`` and the
    prefixes 0x and 0b are read.  Null for any other text, and beyond an integer's range."""
    bare = F.btrim(text, F.lit(_BLANK))
    plain = F.regexp_replace(F.regexp_replace(bare, "_", ""), r"(?<=[eE][+-]?[0-9]{1,9})\.\z", "").try_cast("double")
    prefixed = F.ltrim(text, F.lit(_BLANK))
    digits = F.regexp_replace(F.regexp_replace(F.substring(prefixed, 3, 1 << 30), "_", ""), r"\A0+(?=.)", "")
    base = lambda n, most: F.conv(F.when(F.length(digits) <= most, digits), n, 10).try_cast("int")
    found = F.when(bare.rlike(rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?[0-9]+\.?)?\z"), F.round(plain).try_cast("int"))
    return found.when(prefixed.rlike(r"\A0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*\z"), base(16, 8)).when(prefixed.rlike(r"\A0[bB][01]+(?:_[01]+)*\z"), base(2, 31))


def number_text(value: Column, places: int) -> Column:
    """A double rounded to some places as text: the shortest digits, without exponent up to 1e16, the sign also of a zero."""
    rounded = F.round(value, places)
    plain, size = rounded.cast("string"), F.abs(rounded)
    whole = F.regexp_replace(rounded.try_cast(f"decimal(38,{max(places, 1)})").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    found = F.when((size == 0) & value.cast("string").startswith("-"), F.lit("-0.0")).when((size >= 1e7) & (size < 1e16), whole)
    return found.when((size >= 1e16) & (size < float("inf")), F.regexp_replace(plain, r"(?:\.0)?E", "e+")).otherwise(plain)


def any_of(text: Column, lexicon: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in lexicon])


def sum_of(text: Column, lexicon: Sequence[str]) -> Column:
    """How many words of the lexicon the text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in lexicon])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def mean_length(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w))
    return ratio(total, F.size(words))


def text_stats(text: Column, stop_words: Sequence[str] = ()) -> dict[str, Column]:
    """Counts and means of a text; sentences end at ``。！？；`` or a line's end."""
    words, sentences = tokens(text, stop_words), F.size(pieces(text, r"[。！？；\n]"))
    n = F.size(words)
    return {
        "char_count": F.length(F.coalesce(text, F.lit(""))), "word_count": n, "sentence_count": sentences, "avg_word_length": mean_length(words),
        "avg_sentence_length": ratio(n, sentences), "unique_word_ratio": ratio(F.size(F.array_distinct(words)), n), "unique_word_count": F.size(F.array_distinct(words)),
    }


def readability(avg_sentence_length: Column, avg_word_length: Column) -> Column:
    return F.least((0.6 * avg_sentence_length + 0.4 * avg_word_length) / 10, F.lit(1.0))


def sentiment(words: Column, positive: Sequence[str] = LEXICONS.positive, negative: Sequence[str] = LEXICONS.negative) -> Column:
    """(positive - negative) / words."""
    return _let(words, lambda w: ratio((count_in(w, positive) - count_in(w, negative)).cast("double"), F.size(w)))


def numbers(text: Column, patterns: Sequence[str] = LEXICONS.number_patterns) -> Column:
    """The numbers that any pattern's first group captures, pattern by pattern."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)), lambda x: x.try_cast("double")) for p in patterns]
    return F.array_compact(F.concat(*found))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct entries; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def set_cosine(a: Column, b: Column) -> Column:
    sizes = F.sqrt(F.size(F.array_distinct(a)).cast("double")) * F.sqrt(F.size(F.array_distinct(b)).cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / sizes)


# Cleaning, a step a function; ``clean`` runs them in order.


def basic_clean(text: Column) -> Column:
    """Tags, addresses and long digit runs go, white space is collapsed, marks beyond the listed ones go."""
    steps = ((r"<[^>]+>", ""), (r"https?://[^\s<>\"']+", ""), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b", ""), (r"\s+", " "), (r"[^\p{L}\p{N}_\s.,!?;:()（）【】“”‘’《》、。，！？；：]", ""), (r"\b\d{10,}\b", ""))
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, F.coalesce(text, F.lit(""))))


def strip_tags(text: Column) -> Column:
    """Tags go, the common entities are decoded, whatever entity is left goes. Texts without their marks are not searched."""
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, "<[^>]+>", "")).otherwise(text)
    plain = bare
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    decoded = F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", ""), "&[a-zA-Z0-9#]+;", "")
    return F.when(F.contains(bare, F.lit("&")), decoded).otherwise(bare)


def drop_controls(text: Column) -> Column:
    """Control characters (line ends among them) and zero-width ones go."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", ""), r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{feff}]", "")


def drop_astral(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "")


def redecoded(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again: texts of Latin-1 characters alone, with pairs that begin a UTF-8
    character, whose bytes are valid UTF-8; others stay as they are."""
    suspect = ~text.rlike(r"[^\x{0}-\x{ff}]") & text.rlike(r"[\x{c2}-\x{f4}][\x{80}-\x{bf}]")
    # Characters beyond Latin-1 are left out of what is encoded; such texts are not suspect.
    encoded = F.encode(F.regexp_replace(text, r"[^\x{0}-\x{ff}]", ""), "ISO-8859-1")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(encoded.cast("string")), text)).otherwise(text)


def normalise_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\x0b\x0c\r]+", " "), r"\n\s*\n\s*\n+", "\n\n")


def commas_to_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(" "))


def without_sentences(text: Column, pattern: str, end: str = "。") -> Column:
    """Sentences that match ``pattern`` go. Of a list of words, texts that hold none are left as they are."""
    kept = lambda t: F.array_join(F.filter(F.split(t, end), lambda s: ~s.rlike(pattern)), end)
    words = _spellings(pattern)
    return _let(text, lambda t: F.when(any_of(t, words), kept(t)).otherwise(t)) if words else kept(text)


def _spellings(pattern: str, most: int = 32) -> list[str]:
    """What the words of a pattern that is ``(?i)`` and a list of words may look like; none of other patterns, and of
    those with many letters."""
    words = pattern.removeprefix("(?i)").split("|")
    if not pattern.startswith("(?i)") or not all(w.isalnum() for w in words) or sum(2 ** sum(c.isascii() and c.isalpha() for c in w) for w in words) > most:
        return []
    return [w for word in words for w in map("".join, product(*[dict.fromkeys((c.lower(), c.upper())) if c.isascii() else c for c in word]))]


def without_contacts(text: Column, pattern: str = LEXICONS.contact) -> Column:
    gone = lambda t: F.regexp_replace(t, pattern, "")
    if pattern != LEXICONS.contact:
        return gone(text)
    # What each of the listed kinds holds is found sooner than the kinds.
    return _let(text, lambda t: F.when(F.contains(t, F.lit("@")) | F.contains(t, F.lit("www.")) | t.rlike("[0-9]{7}"), gone(t)).otherwise(t))


#: What a text with three equal words in a row holds: a word that ends like the one before it, and that the next begins with.
_AGAIN = r"(\S)\s++(?=\S*?\1\s)(\S++)\s++\2"


def without_repeats(text: Column, end: str = "。") -> Column:
    """Runs of four or more of one character become three, three or more of one word one, sentences once."""
    runs = _let(F.regexp_replace(text, r"(.)\1{3,}", "$1$1$1"), lambda t: F.when(t.rlike(_AGAIN), F.regexp_replace(t, r"(\S++)(\s+\1){2,}", "$1")).otherwise(t))
    return distinct_sentences(runs, end)


def distinct_sentences(text: Column, end: str = "。") -> Column:
    sentences = F.transform(F.split(text, F.concat(F.lit("\\Q"), F.lit(end), F.lit("\\E"))), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c")))
    return F.array_join(F.array_distinct(F.filter(sentences, lambda s: s != "")), end)


def closed(text: Column) -> Column:
    """Trimmed, with a full stop unless an end mark stands there."""
    return _let(F.trim(text), lambda t: F.when((t == "") | t.rlike("[。！？…]$"), t).otherwise(F.concat(t, F.lit("。"))))


def clean(text: Column) -> Column:
    """The whole cleaning order; Unicode normal form is a step of its own (``functions.unicode``)."""
    t = drop_astral(strip_tags(F.coalesce(text, F.lit(""))))
    t = commas_to_spaces(normalise_space(drop_controls(t)))
    t = without_sentences(without_sentences(t, LEXICONS.disclaimer), LEXICONS.advertisement)
    return closed(without_repeats(without_contacts(t)))


def top_share(words: Column) -> Column:
    """The most frequent word's share of all words: the longest run of the sorted array."""

    def longest(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(starts, lambda at: F.array_max(F.transform(at, lambda i, j: F.coalesce(F.get(at, j + 1), F.size(s)) - i)))

    return _let(F.sort_array(words), lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(longest(s) / F.size(s)))


def repeats_beyond(words: Column, share: float) -> Column:
    """Whether ``top_share`` is beyond ``share``: a word of such a share stands at one of few places of the sorted array."""

    def at_places(s: Column) -> Column:
        n = F.size(s)
        places = F.sequence(F.lit(0), n - 1, F.greatest(F.floor(n * share).cast("int"), F.lit(1)))
        return F.exists(F.transform(places, lambda i: F.get(s, i)), lambda w: (n - F.size(F.array_remove(s, w))) / n > share)

    return _let(F.sort_array(words), lambda s: (F.size(s) > 0) & at_places(s))


def han_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]++", "")) / F.greatest(F.length(text), F.lit(1))


def issues(text: Column, min_han: float = 0.7, max_repeat: float = 0.3) -> Column:
    """Names of what is wrong with a cleaned text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    checks = {
        "text_too_short": F.length(text) < 50, "text_too_long": F.length(text) > 50000, "low_chinese_ratio": han_ratio(text) < min_han,
        "possible_gibberish": F.length(text) - F.length(drop_astral(text)) > F.length(text) * 0.05, "high_repetition": _let(words, lambda w: F.when(F.size(w) > 10, repeats_beyond(w, max_repeat)).otherwise(False)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def clean_quality(original: Column, cleaned: Column, found: Column) -> Column:
    """1 less the penalties of the issues, more for a cleaning that took little and less for one that took half."""
    cost = CLEAN_PENALTIES
    score = reduce(lambda a, b: a - b, [F.when(F.array_contains(found, n), F.lit(c)).otherwise(0.0) for n, c in cost.items()], F.lit(1.0))
    kept = ratio(F.length(cleaned).cast("double"), F.length(original))
    score = score + F.when(kept.between(0.7, 0.95), F.lit(0.1)).when(kept < 0.5, F.lit(-0.2)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
