"""Lexical and readability features of an argument text, as native column expressions.

Patterns follow Python ``re`` semantics; Java needs ``(?U)`` for Unicode
``\\b \\w \\d \\s``.  Binary cue flags are case-insensitive, cue counters
are case-sensitive, and counts/denominators are clipped at 1 where the
study clips them.

``pattern_features`` gives the twelve features of the pattern tables without a Java pattern
per feature: texts are folded to ASCII and counted in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

# Cue vocabularies of the study's feature table, in its order.
NUMBER_WORDS = (r"\d+(?:[\.,]\d+)?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|"
                r"fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|"
                r"seventy|eighty|ninety|hundred|thousand|million|billion|trillion")
PERCENT = r"%|percent|percentage|pct\."
SOURCE_CUES = (r"according to|study|report|data|survey|research|trial|meta-analysis|systematic review|paper|"
               r"journal|evidence shows|findings?")
UNCERTAINTY = (r"may|might|could|possibly|potentially|likely|unlikely|suggests?|appears?|estimate|"
               r"approximately|about|roughly")
CAUSAL = (r"because|therefore|thus|hence|leads? to|causes?|results? in|due to|drives?|contributes? to|"
          r"as a result")
NORMATIVE = (r"should|must|ought|need to|ethical|ethically|moral|morally|responsible|responsibly|"
             r"responsibility|fair|unfair|fairness|justice|rights?|wrong")
POLICY_LEGAL = (r"policy|law|legal|illegal|regulation|regulatory|ban|constitution|amendment|court|rights?")
HEALTH_SAFETY = (r"health|safety|disease|cancer|mortality|injury|risk|harm|harmful|toxic|public health")
ECONOMIC = (r"cost|price|tax|jobs?|wages?|income|market|economic|productivity|gdp|affordability")
COMPARATIVE = (r"more|less|better|worse|higher|lower|increase|decrease|greater|smaller|than")
NEGATION = r"no|not|never|none|without|cannot|can't|won't|doesn't|isn't|aren't"
CITATION_MARKER = r"\[\d+\]|\(\d{4}\)|doi|https?://"
STATS_TERMS = (r"statistically|odds ratio|risk ratio|p-value|confidence interval|sample size|rate|prevalence|"
               r"incidence|median|mean|average")
STRICT_STATS = r"p-value|confidence interval|odds ratio|risk ratio"

# flag name -> (alternation, word-bounded)
FLAGS = {
    "has_number": (NUMBER_WORDS, True),
    "has_percent": (PERCENT, False),
    "has_source_cue": (SOURCE_CUES, True),
    "has_uncertainty": (UNCERTAINTY, True),
    "has_causal_language": (CAUSAL, True),
    "has_normative_language": (NORMATIVE, True),
    "has_policy_legal_terms": (POLICY_LEGAL, True),
    "has_health_safety_terms": (HEALTH_SAFETY, True),
    "has_economic_terms": (ECONOMIC, True),
    "has_comparative_language": (COMPARATIVE, True),
    "has_negation": (NEGATION, True),
    "has_citation_marker": (CITATION_MARKER, False),
}


def _bounded(alts: str, bounded: bool) -> str:
    return rf"\b(?:{alts})\b" if bounded else f"(?:{alts})"


def _has(text: Column, alts: str, bounded: bool) -> Column:
    return text.rlike("(?iU)" + _bounded(alts, bounded))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit("(?U)" + pattern))


def cue_flags(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    flags = {k: _has(t, a, b) for k, (a, b) in FLAGS.items()}
    flags["has_question_mark"] = F.instr(t, "?") > 0
    flags["has_quote_mark"] = t.rlike("[\"']")
    flags["has_statistics"] = flags["has_number"] | flags["has_percent"] | _has(t, STATS_TERMS, True)
    flags["has_source"] = flags["has_source_cue"] | flags["has_citation_marker"]
    flags["has_strict_source"] = flags["has_citation_marker"]
    # same pattern as the percent counter, so both share one evaluation
    flags["has_strict_statistics"] = (_count(t, f"({PERCENT})") > 0) | _has(t, STRICT_STATS, True)
    return [v.alias(k) for k, v in flags.items()]


def _rates(words: Column, sentences: Column, solid: Column, syll: Column, pct_c: Column, src_c: Column, norm_c: Column, cit_c: Column,
           digits: Column, stat_c: Column) -> dict[str, Column]:
    """Lengths, readability estimate and rates from a text's counts."""
    w1 = F.greatest(words, F.lit(1))
    avg_sent = words / sentences
    return {
        "avg_word_length": solid / w1, "avg_sentence_length_words": avg_sent,
        "flesch_kincaid_grade_est": 0.39 * avg_sent + 11.8 * (syll / w1) - 15.59,
        "percent_count_per_100_words": 100 * pct_c / w1, "source_cue_count_per_100_words": 100 * src_c / w1,
        "normative_cue_count_per_100_words": 100 * norm_c / w1, "citation_count_per_100_words": 100 * cit_c / w1,
        "stats_cue_count_per_100_words": 100 * (digits + stat_c) / w1,
    }


def _syllables(text: Column) -> Column:
    """Vowel runs (other characters only part them)."""
    return F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))


def text_features(text: Column) -> list[Column]:
    """The full feature set (counts, densities, readability estimate, flags, rates)."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = _count(t, r"\S+")  # maximal non-whitespace runs = whitespace-split tokens
    sentences = F.greatest(_count(t, r"[.!?]+"), F.lit(1))
    digits = _count(t, r"\d")
    syll = F.greatest(_syllables(t), F.lit(1))
    pct_c = _count(t, f"({PERCENT})")
    src_c = _count(t, rf"\b({SOURCE_CUES})\b")
    norm_c = _count(t, rf"\b({NORMATIVE})\b")
    stat_c = _count(t, rf"\b(?:{STATS_TERMS})\b")
    cit_c = _count(t, r"\[\d+\]")
    rates = _rates(words, sentences, F.length(F.regexp_replace(t, r"(?U)\s+", "")), syll, pct_c, src_c, norm_c, cit_c, digits, stat_c)
    cols = [
        chars.alias("char_count"), words.alias("word_count"), sentences.alias("sentence_count"),
        digits.alias("digit_count"), (digits / F.greatest(chars, F.lit(1))).alias("number_density"),
        rates["avg_word_length"].alias("avg_word_length"),
        rates["avg_sentence_length_words"].alias("avg_sentence_length_words"), syll.alias("syllable_count_est"),
        rates["flesch_kincaid_grade_est"].alias("flesch_kincaid_grade_est"),
    ]
    cols += cue_flags(t)
    cols += [
        pct_c.alias("percent_count"), src_c.alias("source_cue_count"), norm_c.alias("normative_cue_count"),
        stat_c.alias("stats_term_count"), cit_c.alias("citation_count"),
    ]
    cols += [rates[k].alias(k) for k in ("percent_count_per_100_words", "source_cue_count_per_100_words", "normative_cue_count_per_100_words",
                                         "citation_count_per_100_words", "stats_cue_count_per_100_words")]
    return cols


def ascii_folded(text: Column) -> Column:
    """A text with an ASCII character of the same class for every other one: letters whose case variants are ASCII letters become
    these in upper case (cues are lower case, so only case-insensitive patterns see them), digits 0, white space a space,
    word characters _ and the rest ~.  ASCII texts stay as they are."""
    t = text
    for plain, variants in (("I", "\u0130\u0131"), ("S", "\u017f"), ("K", "\u212a")):
        for v in variants:
            t = F.replace(t, F.lit(v), F.lit(plain))
    for kind, plain in (("&&\\d", "0"), ("&&\\s", " "), ("&&\\w", "_"), ("", "~")):
        t = F.regexp_replace(t, rf"(?U)[[^\x00-\x7F]{kind}]", plain)
    return F.when(_is_ascii(text), text).otherwise(t)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


_KINDS = {"words": "\t\n\x0b\x0c\r ", "sentences": ".!?", "digits": "0123456789", "syllables": "aeiouyAEIOUY"}
_PATTERNS = {  # name -> (pattern, case ignored); those without a case are counted
    "pct": (PERCENT, False), "src": (rf"\b(?:{SOURCE_CUES})\b", False), "norm": (rf"\b(?:{NORMATIVE})\b", False),
    "stat": (rf"\b(?:{STATS_TERMS})\b", False), "cit": (r"\[\d+\]", False),
    "has_percent": (PERCENT, True), "has_source_cue": (_bounded(SOURCE_CUES, True), True),
    "has_normative_language": (_bounded(NORMATIVE, True), True), "has_strict_source": (CITATION_MARKER, True),
    "has_strict_stats": (_bounded(STRICT_STATS, True), True),
}
#: Bytes of text whose characters are classed at a time.
CLASSED = 1 << 22


def _class_counts(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per text (``ends``: its first byte and the byte after each): words, sentence marks, digits, syllables and characters of words."""
    table = np.zeros(256, np.uint8)
    for bit, chars in enumerate(_KINDS.values()):
        table[list(chars.encode())] |= 1 << bit
    table ^= 1  # words: what isn't white space
    kinds = table[data[ends[0]:ends[-1]]]
    at = ends - ends[0]
    before = np.concatenate([[0], kinds[:-1]]).astype(np.uint8) if len(kinds) else kinds
    before[at[:-1][at[:-1] < len(kinds)]] = 0
    starts = kinds & ~before

    def per_text(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])

    return [per_text(starts & 1), per_text((starts >> 1) & 1), per_text((kinds >> 2) & 1), per_text((starts >> 3) & 1), per_text(kinds & 1)]


_COUNTED = StructType([StructField(k, LongType()) for k in (*_KINDS, "solid")]
                      + [StructField(k, BooleanType() if ignored else LongType()) for k, (_, ignored) in _PATTERNS.items()])


@F.arrow_udf(_COUNTED)
def ascii_counts(text: pa.Array) -> pa.Array:
    """Counts and flags of ASCII texts.  In these Java's Unicode classes are RE2's ASCII ones."""
    text = text.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    parts, first = [], 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CLASSED, "right")) - 1)
        parts.append(_class_counts(data, ends[first:last + 1]))
        first = last
    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)] if parts else [pa.array([], pa.int64())] * 5
    for pattern, ignored in _PATTERNS.values():
        columns.append(pc.match_substring_regex(text, pattern, ignore_case=True) if ignored else pc.count_substring_regex(text, pattern).cast(pa.int64()))
    return pa.StructArray.from_arrays(columns, names=_COUNTED.names)


def pattern_features(text: Column) -> list[Column]:
    """The features of the pattern tables, equal to those of ``text_features``."""
    t = F.coalesce(text, F.lit(""))
    c = ascii_counts(ascii_folded(t))
    # lower-casing can turn other characters into vowels
    syll = F.greatest(F.when(_is_ascii(t), c["syllables"]).otherwise(_syllables(t)), F.lit(1))
    rates = _rates(c["words"], F.greatest(c["sentences"], F.lit(1)), c["solid"], syll, c["pct"], c["src"], c["norm"], c["cit"], c["digits"], c["stat"])
    flags = {k: c[k] for k in ("has_percent", "has_normative_language", "has_source_cue", "has_strict_source")}
    flags["has_strict_statistics"] = (c["pct"] > 0) | c["has_strict_stats"]
    return [v.alias(k) for k, v in (flags | rates).items()]


# Unicode punctuation folded to ASCII (1:1 replacements and deletions).
QUOTE_MAP = {
    # double quotes
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u00ab": '"', "\u00bb": '"',
    "\u2033": '"', "\u2036": '"', "\u275d": '"', "\u275e": '"', "\u301d": '"', "\u301e": '"',
    "\u301f": '"',
    # single quotes / apostrophes
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u2032": "'", "\u2035": "'",
    "\u00b4": "'", "\u0060": "'", "\u02b9": "'", "\u02bb": "'", "\u02bc": "'", "\u02bd": "'",
    "\u02be": "'", "\u02bf": "'", "\u275b": "'", "\u275c": "'",
    # dashes
    "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-", "\u2043": "-", "\u00ad": "-",
    "\u058a": "-", "\u1806": "-", "\u2010": "-", "\u2011": "-", "\u2e3a": "-", "\u2e3b": "-",
    # spaces and zero-width characters (deleted)
    "\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "",
}
# Multi-character expansions.
QUOTE_EXPAND = {"\u2026": "...", "\u22ef": "...", "\u2025": ".."}


def normalize_quotes(text: Column) -> Column:
    """Fold typographic quotes, dashes, spaces and ellipses to ASCII.

    One ``translate`` does the 1:1 folds and the deletions (characters past
    the end of the replacement string are removed)."""
    t = text
    for k, v in QUOTE_EXPAND.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    keep = [(k, v) for k, v in QUOTE_MAP.items() if v]
    drop = [k for k, v in QUOTE_MAP.items() if not v]
    return F.translate(t, "".join(k for k, _ in keep) + "".join(drop), "".join(v for _, v in keep))
