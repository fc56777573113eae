"""Text columns: tokens, sentences, character statistics, scripts, small talk and importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memtide.functions.rules import SCRIPT_BLOCKS, RulePack, default_packs

#: White space as Python's ``str.strip`` sees it.
SPACE = r"[\s\x1c-\x1f]"
#: Sentence and phrase punctuation. The ASCII apostrophe counts, the ASCII double quote does not.
PUNCTUATION = ".,;:!?。，；：！？·•・、'«»„“”‘’"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends; Spark's ``trim`` only knows the blank."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


#: What :func:`tokenize` takes of a lower-cased text.
TOKEN = r"[a-z0-9]+|[^\x00-\x7f]"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; any other non-ASCII character is a token of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """CJK full stops end a sentence anywhere, Latin ones before white space or the end."""
    parts = F.split(strip(text), r"(?U)(?<=[。！？])\s*|(?<=[.!?])(?:\s+|\z)")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def has_content(text: Column) -> Column:
    return text.rlike(r"(?U)[\p{L}\p{N}]")


def _kinds(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def distinct_chars(text: Column) -> Column:
    return F.size(_kinds(text))


def _entropy(text: Column, kinds: Column) -> Column:
    def bits(n: Column) -> Column:
        plus = lambda a, c: let((n - F.length(F.replace(text, c, F.lit("")))) / n, lambda p: a - p * F.log2(p))
        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(kinds, F.lit(0.0), plus))

    return let(F.length(text), bits)


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    return _entropy(text, _kinds(text))


def information_density(text: Column) -> Column:
    """Entropy over its largest value for as many distinct characters; 0 for one or none."""
    return let(_kinds(text), lambda k: F.when(F.size(k) <= 1, F.lit(0.0)).otherwise(_entropy(text, k) / F.log2(F.size(k).cast("double"))))


def repetition_ratio(text: Column) -> Column:
    """Share of characters that equal the one before."""
    n = F.length(text)
    return F.when(n < 2, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(text, r"(?s)(.)\1+", "$1"))) / (n - 1))


def punctuation_ratio(text: Column) -> Column:
    """Share of characters that are white space or phrase punctuation."""
    n = F.length(text)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(F.regexp_replace(text, rf"(?U)[\s\x1c-\x1f{PUNCTUATION}]", ""))) / n)


def gibberish_reason(text: Column, min_density: float = 0.3, max_repetition: float = 0.5, max_punctuation: float = 0.7) -> Column:
    """Why a text is gibberish, or null."""
    return (
        F.when(F.length(text) < 2, "too_short")
        .when(information_density(text) < min_density, "low_density")
        .when(repetition_ratio(text) > max_repetition, "high_repetition")
        .when(punctuation_ratio(text) > max_punctuation, "high_punctuation")
        .when(F.regexp_replace(text, rf"(?U){SPACE}", "").rlike(r"\A[\p{Nd}²³¹]*\z"), "pure_digits")
    )


def script_count(text: Column, script: str) -> Column:
    low, high = SCRIPT_BLOCKS[script]
    return F.length(text) - F.length(F.regexp_replace(text, rf"[\x{{{low:X}}}-\x{{{high:X}}}]", ""))


def detect_scripts(text: Column, threshold: float = 0.15) -> Column:
    """Scripts that hold ``threshold`` of the characters in known blocks; ``Unknown`` when there are none."""
    names = F.array(*map(F.lit, SCRIPT_BLOCKS))
    counts = let(strip(text), lambda bare: F.array(*(script_count(bare, s) for s in SCRIPT_BLOCKS)))

    def shares(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, x: a + x)
        return let(total, lambda t: F.when(t == 0, F.array(F.lit("Unknown"))).otherwise(F.filter(names, lambda _, i: (F.get(c, i) > 0) & (F.get(c, i) / t >= threshold))))

    return let(counts, shares)


def is_cjk(scripts: Column) -> Column:
    return F.arrays_overlap(scripts, F.array(*map(F.lit, ("CJK", "Hiragana", "Katakana", "Hangul"))))


def script_groups(scripts: Column) -> Column:
    """East Asian scripts become the one group ``CJK``."""
    east = F.array(*map(F.lit, ("CJK", "Hiragana", "Katakana", "Hangul")))
    return let(scripts, lambda s: F.when(is_cjk(s), F.array_union(F.array_except(s, east), F.array(F.lit("CJK")))).otherwise(s))


def _in(value: Column, words: Sequence[str]) -> Column:
    return value.isin(*words) if words else F.lit(False)


def _applies(pack: RulePack, groups: Column) -> Column:
    return F.arrays_overlap(groups, F.array(*map(F.lit, pack.scripts)))


def is_small_talk(sentence: Column, groups: Column, packs: Sequence[RulePack] | None = None) -> Column:
    """Whether an applicable pack lists the sentence; its closing punctuation and case don't count."""
    bare = F.regexp_replace(F.lower(strip(sentence)), r"[。.!?！？]+\z", "")
    out = F.lit(False)
    for pack in packs if packs is not None else default_packs():
        out = out | (_applies(pack, groups) & _in(bare, pack.small_talk))
    return out


def pack_importance(text: Column, pack: RulePack) -> Column:
    """0.5, up for each high signal within the text, down for each low signal that it is or begins with; 0 to 1."""
    low = F.lower(text)
    up = F.aggregate(F.array(*map(F.lit, pack.high)), F.lit(0.5), lambda a, w: a + F.when(F.contains(low, w), 0.08).otherwise(0.0)) if pack.high else F.lit(0.5)
    down = F.aggregate(F.array(*map(F.lit, pack.low)), up, lambda a, w: a - F.when((low == w) | F.startswith(low, F.concat(w, F.lit(" "))), 0.1).otherwise(0.0)) if pack.low else up
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), down))


def importance(text: Column, groups: Column, packs: Sequence[RulePack] | None = None) -> Column:
    """The best score of the applicable packs; 0.5 when none applies."""
    packs = packs if packs is not None else default_packs()
    scores = [F.when(_applies(p, groups), pack_importance(text, p)) for p in packs]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(None)
    return F.coalesce(best, F.lit(0.5))


def _any_pack(groups: Column, packs: Sequence[RulePack]) -> Column:
    out = F.lit(False)
    for pack in packs:
        out = out | _applies(pack, groups)
    return out


def telling_sentences(every: Column, groups: Column, packs: Sequence[RulePack] | None = None) -> Column:
    """Of an array of sentences those that are not small talk."""
    return F.filter(every, lambda s: ~is_small_talk(s, groups, packs))


def small_talk_ratio(every: Column, telling: Column, groups: Column, packs: Sequence[RulePack] | None = None) -> Column:
    """Share of small-talk sentences; 1 without a sentence, 0 when no pack applies."""
    packs = packs if packs is not None else default_packs()
    share = (F.size(every) - F.size(telling)) / F.size(every)
    return F.when(F.size(every) == 0, F.lit(1.0)).when(~_any_pack(groups, packs), F.lit(0.0)).otherwise(share)


def clean_small_talk(text: Column, packs: Sequence[RulePack] | None = None) -> Column:
    return let(script_groups(detect_scripts(text)), lambda groups: F.array_join(telling_sentences(sentences(text), groups, packs), " "))


def chunks(text: Column, size: int = 4096) -> Column:
    """Consecutive pieces of ``size`` characters; one empty piece for an empty text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
