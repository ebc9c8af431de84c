"""Text cleaning, tokens, n-grams and counts as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rules


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_words(c) -> Column:
    """Lowered runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def letter_words(c) -> Column:
    """Lowered runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\pL\pN]+"), F.lit(0))


def replace_all(c, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order; ``$1`` refers to a group.

    Word boundaries are Unicode ones: a letter of any script is part of a word.
    """
    out = _col(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, f"(?U){pattern}" if r"\b" in pattern else pattern, replacement)
    return out


def space_words(c) -> Column:
    """Tokens between whitespace; an empty text has none."""
    # without a lambda Spark generates code for it and computes equal calls of a row once
    return F.array_remove(F.split(_col(c), r"\s+"), "")


def regex_words(c) -> Column:
    """Lowered words of two or more word characters (letters and digits of any script, underscores)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\pL\pN_]{2,}"), F.lit(0))


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def strip_punctuation(c) -> Column:
    return F.regexp_replace(_col(c), PUNCTUATION, "")


def drop_words(tokens: Column, stop: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stop))) if stop else tokens


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def drop_non_ascii_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: w.rlike(r"^[\x00-\x7F]*$"))


def collapse_repeats(tokens: Column, limit: float = 0.06) -> Column:
    """Keep first occurrences only when distinct words are at most ``limit`` of all."""
    distinct = F.array_distinct(tokens)
    return F.when((F.size(tokens) > 0) & (F.size(distinct) <= F.size(tokens) * limit), distinct).otherwise(tokens)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when used inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _starts(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def word_ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """Consecutive word n-grams joined by ``sep``; none when the text is shorter."""
    if n == 1:
        return tokens
    return bound(tokens, lambda w: F.transform(
        _starts(F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), sep)
    ))


def char_ngrams(c, n: int) -> Column:
    """Character n-grams of a text."""
    return bound(_col(c), lambda text: F.transform(
        _starts(F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))
    ))


def token_char_ngrams(tokens: Column, n: int) -> Column:
    """Character n-grams inside each token."""
    return F.flatten(F.transform(tokens, lambda w: char_ngrams(w, n)))


def fill_missing(c, token: str, placeholders: Sequence[str] = ()) -> Column:
    """Replace null, blank and placeholder text by a token."""
    text = _col(c)
    gone = text.isNull() | (F.trim(text) == "")
    if placeholders:
        gone = gone | text.isin(list(placeholders))
    return F.when(gone, F.lit(token)).otherwise(text)


def normal_words(c, stop: Sequence[str]) -> Column:
    """Lower, everything but letters and digits to space, no stop words or single letters."""
    tokens = space_words(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", " "))
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(list(stop)))


def word_count(c, placeholder: str | None = None) -> Column:
    size = F.size(space_words(F.lower(_col(c))))
    return size if placeholder is None else F.when(_col(c) == placeholder, 0).otherwise(size)


def count_matches(c, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern))


def digit_tokens(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: w.rlike("^[0-9]+$")))


def contains_word(c, word: str) -> Column:
    return (F.instr(F.lower(_col(c)), word) > 0).cast("int")


def pad_sequence(ids: Column, length: int) -> Column:
    """Keep the last ``length`` ids and fill up with 0 on the left."""
    size = F.size(ids)
    tail = F.when(size > length, F.slice(ids, -length, length)).otherwise(ids)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(length) - size, F.lit(0))), tail)


def html_text(c) -> Column:
    """Visible text of an HTML page: scripts, styles, tags and entities removed."""
    return F.trim(replace_all(c, [
        ("(?is)<script[^>]*>.*?</script>", " "),
        ("(?is)<style[^>]*>.*?</style>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?s)<[^>]+>", " "),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&amp;", "&"),
        (r"\s+", " "),
    ]))


# Suffix rules of the light stemmer, tried in this order.
STEM_RULES = [
    ("ational$", "ate"), ("ization$", "ize"), ("fulness$", "ful"), ("ousness$", "ous"),
    ("sses$", "ss"), ("ies$", "i"), ("(?<=[aeiou][a-z]{1,20})ing$", ""), ("(?<=[aeiou][a-z]{1,20})ed$", ""),
    ("(?<=[a-z]{2})ly$", ""), ("(?<=[^s])s$", ""),
]


def stem(c) -> Column:
    """Suffix-rule stem of one English word: the first rule that fits."""
    word = _col(c)
    out = None
    for pattern, replacement in STEM_RULES:
        done = F.regexp_replace(word, pattern, replacement)
        out = F.when(word.rlike(pattern), done) if out is None else out.when(word.rlike(pattern), done)
    return out.otherwise(word)


def sentences(c) -> Column:
    """Parts of a text that end with a full stop, question or exclamation mark."""
    parts = F.split(_col(c), r"[.!?]+\s+")
    return F.filter(parts, lambda x: F.trim(x) != "")


def clean_question(c, stop: Sequence[str] = rules.QUESTION_STOP_WORDS) -> Column:
    cleaned = strip_punctuation(replace_all(c, rules.QUESTION_RULES))
    return join_words(drop_words(space_words(cleaned), stop))


def fix_spelling(tokens: Column, spelling: dict[str, str]) -> Column:
    """Replace listed words; the list is passed as a literal map, so keep it small."""
    if not spelling:
        return tokens
    table = F.create_map(*[F.lit(x) for kv in spelling.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(table[w], w))


def clean_comment(c, spelling: dict[str, str] | None = None) -> Column:
    """Rules, spelling, non-ASCII words, repeated spam, punctuation, lower case."""
    tokens = fix_spelling(space_words(replace_all(c, rules.COMMENT_RULES)), spelling or {})
    kept = F.filter(drop_non_ascii_words(tokens), lambda w: w != "")
    return F.lower(strip_punctuation(join_words(collapse_repeats(kept))))


def char_gram_text(c) -> Column:
    """Lower case, contractions expanded, no punctuation or digits, words between # marks."""
    text = F.replace(F.lower(_col(c)), F.lit("\x08"), F.lit(" "))  # other blanks go when words are split
    # of the word before a suffix its last letter is enough: a longer match would only put the others back
    rest = replace_all(text, [(p.replace(r"(\w+)", r"(\w)"), r) for p, r in rules.CHAR_GRAM_RULES])
    text = F.when(F.contains(_col(c), F.lit("'")), rest).otherwise(text)  # every rule needs an apostrophe
    spaced = F.regexp_replace(strip_punctuation(join_words(space_words(text))), r"[\d\s]+", " ")
    return F.replace(spaced, F.lit(" "), F.lit("# #"))


def fold_accents(c) -> Column:
    source = "".join(rules.ACCENTS.values())
    target = "".join(k * len(v) for k, v in rules.ACCENTS.items())
    return F.translate(_col(c), source, target)


def fold_symbols(c) -> Column:
    """Smileys, hearts, plus signs and ellipses to words, accents folded, odd characters to spaces."""
    marked = replace_all(c, [(r"\|", " "), (r":\)", " smile "), (r"\++", " plus "), ("&+", " "), ("\u2764", " xin ")])
    plain = F.regexp_replace(fold_accents(marked), rules.ODD_CHARACTER, " ")
    return F.regexp_replace(plain, r"\.{2,}", " ellipsis ")


def log_character_counts(c) -> dict[str, Column]:
    """log(1 + count), four digits: accented letters, and characters outside the usual set."""
    text = _col(c)
    accented = "[" + "".join(rules.ACCENTS.values()) + "]"
    log_count = lambda col, pattern: F.round(F.log1p(F.regexp_count(col, F.lit(pattern))), 4)
    return {"accents": log_count(text, accented), "odd": log_count(fold_accents(text), rules.ODD_CHARACTER)}


def marked_words(c) -> Column:
    """Numbers of two or more digits to ``numcus``; words and marks as separate tokens."""
    numbered = F.regexp_replace(_col(c), *rules.NUMBER_RULE)
    split = F.split(F.regexp_replace(numbered, rules.SPLIT_MARKS, " $1 "), " ")
    return F.filter(split, lambda w: ~w.isin("", "/"))


def listing_text(category, name, description, placeholder: str = "No description yet") -> Column:
    """One text of a listing: prefixed type, name and description; missing parts are named."""
    def part(prefix, c, end):
        words = F.array_join(marked_words(c), " ")
        gone = _col(c).isNull() | _col(c).isin("", placeholder)
        return F.when(gone, f"{prefix} missing{end}").otherwise(F.concat(F.lit(f"{prefix} "), words, F.lit(end)))

    return F.concat_ws(" ", part("type", category, ""), part("name", name, " ."), part("description", description, " ."))


ADDRESS = r"\S+\@\w+\.\w+"


def count_addresses(c) -> Column:
    """Matches of ``ADDRESS``: a run between blanks holds one or none, so only its start is tried."""
    found = count_matches(c, rf"(?<!\S){ADDRESS}")
    return F.when(~F.contains(_col(c), F.lit("@")), 0).otherwise(found)


def comment_counts(text: Column, clean: Column, terms: dict[str, str] | None = None) -> dict[str, Column]:
    """Pattern counts and length ratios of a raw comment and of its character-gram text.

    ``terms`` adds named patterns, for example of abusive words. Pass ``clean``
    as a column of its own so that it is built once.
    """
    words, clean_words = space_words(text), space_words(clean)
    patterns = {**rules.COUNT_PATTERNS, **(terms or {})}
    out = {k: count_addresses(text) if p == ADDRESS else count_matches(text, p) for k, p in patterns.items()}
    unique, clean_unique = F.size(F.array_distinct(words)), F.size(F.array_distinct(clean_words))
    letters = F.size(F.array_remove(F.array_distinct(F.split(clean, "")), ""))
    out.update({
        "raw_word_len": F.size(words),
        "raw_char_len": F.length(text),
        "unique_word_len": unique,
        "word_ratio": unique / (F.size(words) + 1),
        "clean_word_len": F.size(clean_words),
        "clean_char_len": F.length(clean),
        "clean_chars": letters,
        "clean_chars_ratio": letters / (1 + F.least(F.lit(99), F.length(clean))),
        "clean_unique_word_len": clean_unique,
        "clean_word_ratio": clean_unique / (F.size(clean_words) + 1),
    })
    return out
