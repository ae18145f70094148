"""Text expressions.  Row-local, no shuffle, no Python worker.

All functions take and return Columns, so they run unchanged inside any batch
or streaming projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.config import CONTRACTIONS, PlatformConfig

# Unicode white space plus the four separators Spark's regex class leaves out.
_SPACE = r"[\s\x1C-\x1F]"
_NON_SPACE = r"[^\s\x1C-\x1F]"
# A word boundary that means the same on every JDK: no letter, digit or _ beside it.
_WORD_CHAR = r"[\p{L}\p{N}_]"
_NOT_BEFORE_WORD = f"(?!{_WORD_CHAR})"

# Code points with the Unicode property Emoji (fixed values).
EMOJI_CLASS = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}-\x{21AA}"
    r"\x{231A}-\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}-\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}\x{2611}"
    r"\x{2614}-\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}-\x{2623}\x{2626}\x{262A}"
    r"\x{262E}-\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}-\x{2660}"
    r"\x{2663}\x{2665}-\x{2666}\x{2668}\x{267B}\x{267E}-\x{267F}\x{2692}-\x{2697}\x{2699}"
    r"\x{269B}-\x{269C}\x{26A0}-\x{26A1}\x{26A7}\x{26AA}-\x{26AB}\x{26B0}-\x{26B1}"
    r"\x{26BD}-\x{26BE}\x{26C4}-\x{26C5}\x{26C8}\x{26CE}-\x{26CF}\x{26D1}\x{26D3}-\x{26D4}"
    r"\x{26E9}-\x{26EA}\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}"
    r"\x{2708}-\x{270D}\x{270F}\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}"
    r"\x{2733}-\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}"
    r"\x{2763}-\x{2764}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}-\x{2935}"
    r"\x{2B05}-\x{2B07}\x{2B1B}-\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F004}\x{1F0CF}\x{1F170}-\x{1F171}\x{1F17E}-\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}"
    r"\x{1F1E6}-\x{1F1FF}\x{1F201}-\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
    r"\x{1F250}-\x{1F251}\x{1F300}-\x{1FAFF}"
)
# An emoji with its variation selectors, joiners and tags; or a keycap.
EMOJI_PATTERN = rf"[{EMOJI_CLASS}][\x{{FE0F}}\x{{200D}}\x{{E0020}}-\x{{E007F}}]*|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
# Cheap test in front of the long character class: letters of most scripts fail it at once.
_MAYBE_EMOJI = r"(?=[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}])"

URL_PATTERN = rf"(?U)(?:http|www){_NON_SPACE}+"


def lower_text(text: Column) -> Column:
    return F.lower(text.cast("string"))


def has_min_words(text: Column, min_words: int = 15) -> Column:
    """True when ``text`` has at least ``min_words`` white-space separated words.

    The anchored pattern stops at the word that decides, so a 20,000-word review
    costs no more than a 15-word one.
    """
    if min_words <= 0:
        return F.lit(True)
    words_before = rf"(?:{_NON_SPACE}++{_SPACE}++){{{min_words - 1}}}"
    pattern = rf"(?U)^{_SPACE}*+{words_before}{_NON_SPACE}"
    return F.coalesce(text.cast("string").rlike(pattern), F.lit(False))


def split_words(text: Column) -> Column:
    """White-space split without empty elements."""
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda word: word != "")


def normalize_brands(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Lower-case, then rewrite whole words to their brand, rule by rule.

    Neighbouring rules with one target become a single alternation: a rule's
    output is that very target, so a later rule of the group cannot change it. The word
    comes before the look at what is in front of it: most places fail at its first letter.
    """
    out = lower_text(text)
    groups: list[tuple[str, list[str]]] = []
    for word, target in rules:
        if groups and groups[-1][0] == target:
            groups[-1][1].append(word)
        else:
            groups.append((target, [word]))
    for target, words in groups:
        alternatives = "|".join(f"{re.escape(word)}(?<!{_WORD_CHAR}{re.escape(word)})" for word in words)
        out = F.regexp_replace(out, f"(?:{alternatives}){_NOT_BEFORE_WORD}", target)
    return out


def strip_emoji(text: Column) -> Column:
    """Remove emoji without leaving a gap: neighbours join."""
    return F.regexp_replace(text, _MAYBE_EMOJI + EMOJI_PATTERN, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_PATTERN, "")


def collapse_to_words(text: Column) -> Column:
    """Anything but ASCII letters and digits becomes one blank; ends trimmed.

    The pattern skips single blanks between words, which need no change. A named class
    is tested some ten times faster here than a negated list of ranges.
    """
    return F.trim(F.regexp_replace(text, r" \P{Alnum}++|[\P{Alnum}&&[^ ]]\P{Alnum}*+", " "))


def split_contractions(text: Column) -> Column:
    initials = "".join(sorted({head[0] for head, _ in CONTRACTIONS}))
    heads = "|".join(rf"{head}(?={tail}\b)" for head, tail in CONTRACTIONS)
    return F.regexp_replace(text, rf"\b(?=[{initials}])({heads})", "$1 ")


def word_tokens(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """Tokens of text that holds only ASCII letters, digits and blanks, without ``drop``."""
    return drop_words(F.split(split_contractions(text), " "), ("", *drop))


def drop_words(tokens: Column, words: tuple[str, ...]) -> Column:
    """Tokens not in ``words``; the literal list becomes a hash set in the plan."""
    if not words:
        return tokens
    return F.filter(tokens, lambda word: ~word.isin(*words))


def clean_tokens(text: Column, config: PlatformConfig) -> Column:
    """Brands, emoji, URLs, specials, tokens, stop words: one expression."""
    out = normalize_brands(text, config.brand_rules)
    out = collapse_to_words(strip_urls(strip_emoji(out)))
    stop = tuple(dict.fromkeys(config.stop_list() + config.custom_stop_words))
    return F.coalesce(word_tokens(out, stop), F.array().cast("array<string>"))


def clean_text(text: Column, config: PlatformConfig) -> Column:
    return F.array_join(clean_tokens(text, config), " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


# Letters with a diacritic and their plain form, one to one (fixed values).
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžơưǎǐǒǔ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzouaiou"


def topic_tokens(text: Column, min_len: int = 2, max_len: int = 15) -> Column:
    """Lower-case alphabetic tokens without accents, 2 to 15 characters, no leading _."""
    folded = F.regexp_replace(F.translate(lower_text(text), _ACCENTED, _PLAIN), r"\p{M}+", "")
    words = F.regexp_extract_all(folded, F.lit(r"((?:(?!\p{N})[\p{L}_])+)"), 1)
    kept = F.filter(
        words, lambda word: F.length(word).between(min_len, max_len) & ~word.startswith("_")
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def _runs_of(tokens: Column, size: int, joiner: str) -> Column:
    starts = F.when(
        F.size(tokens) >= size, F.sequence(F.lit(0), F.size(tokens) - size)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda start: F.concat_ws(joiner, *[F.get(tokens, start + i) for i in range(size)]))


def word_ngrams(tokens: Column, low: int, high: int, joiner: str = " ") -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens as strings.

    ``tokens`` should be a plain column, since it is read once per run.
    """
    parts = [tokens if size == 1 else _runs_of(tokens, size, joiner) for size in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def splice(tokens: Column, places: Column, values: Column, width: int) -> Column:
    """Put ``values`` in place of the ``width`` tokens at each of the sorted ``places``; linear in the text.

    What is computed goes into one zipped array, made once: inside a lambda it would be made anew for
    every place.
    """
    begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda i: i + width))
    zipped = F.arrays_zip(begins.alias("begin"), places.alias("at"), values.alias("value"))

    def piece(p: Column) -> Column:
        end = F.coalesce(p["at"], F.size(tokens))
        kept = F.slice(tokens, p["begin"] + 1, end - p["begin"])
        return F.when(p["at"].isNull(), kept).otherwise(F.concat(kept, F.array(p["value"])))

    return F.flatten(F.transform(zipped, piece))
