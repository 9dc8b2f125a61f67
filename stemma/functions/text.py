"""Text, array and number functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

Col = str | Column


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, work) -> Column:
    """``work`` of a value that is computed once, however often ``work`` names it."""
    return F.get(F.transform(F.array(value), lambda v: work(v)), 0)


def normalize_ws(text: Col) -> Column:
    """Soft hyphens go, runs of ASCII space become one space, ends are trimmed."""
    bare = F.replace(col(text), F.lit("­"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "))


def fold_variants(text: Col, variants: dict[str, str]) -> Column:
    """One character for another, by a map of single characters."""
    return F.translate(col(text), "".join(variants), "".join(variants.values()))


def normalize_key(text: Col, variants: dict[str, str]) -> Column:
    """Folded text without spaces and ASCII punctuation, for keys of equal spelling."""
    return F.regexp_replace(fold_variants(text, variants), r"[\x20\x09-\x0D.,;:!?]+", "")


def split_on(text: Col, pattern: str) -> Column:
    """Non-empty trimmed parts between matches of ``pattern``."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), pattern, -1), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_sentences(text: Col) -> Column:
    return split_on(text, r"[.!?。！？\n]+")


def split_clauses(text: Col) -> Column:
    return split_on(text, r"[.,;:!?。，；：！？\n]+")


def tokens(text: Col, least: int = 3) -> Column:
    """Lower-case runs of a-z and 0-9 of at least ``least`` characters, in order."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", -1), lambda x: F.length(x) >= least)


def char_ngrams(text: Col, n: int) -> Column:
    def grams(chars):
        some = F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
        return F.when(F.size(chars) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(F.coalesce(col(text), F.lit("")), ""), lambda c: c != ""), grams)


def word_ngrams(words: Col, n: int) -> Column:
    def grams(w):
        some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(col(words), grams)


def suffix_phrases(words: Col, suffixes: Sequence[str], least: int = 2, most: int = 6) -> Column:
    """Word sequences of ``least`` to ``most`` words whose last word is one of ``suffixes``."""
    grams = F.flatten(F.array(*[word_ngrams(words, n) for n in range(least, most + 1)]))
    return F.filter(grams, lambda g: F.element_at(F.split(g, " "), -1).isin(*suffixes))


def extract_numbers(text: Col) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))


def bracket_pairs(text: Col) -> Column:
    """(outside, inside) of every ``word (inside)``."""
    t = F.coalesce(col(text), F.lit(""))
    pattern = F.lit(r"([^\s()]+) ?\(([^()]*)\)")
    return F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("outside"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("inside"))


def first_match(text: Col, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule (label, pattern) that matches."""
    out = F.lit(default).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(col(text).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def template(clause: Col, rules: Sequence[tuple[str, str]]) -> Column:
    """Numbers become [NUM], then every rule (placeholder, pattern) in order takes its matches."""
    out = F.regexp_replace(col(clause), "[0-9]+", "[NUM]")
    for placeholder, pattern in rules:
        out = F.regexp_replace(out, pattern, placeholder)
    return out


def placeholders(t: Col) -> Column:
    return F.regexp_count(col(t), F.lit(r"\[[A-Z]+\]"))


def specificity(t: Col) -> Column:
    """Letters outside placeholders, less half a point for each placeholder."""
    letters = F.length(F.regexp_replace(F.regexp_replace(col(t), r"\[[A-Z]+\]", ""), r"[^a-z]", ""))
    return letters - F.lit(0.5) * placeholders(t)


def specificity_share(t: Col) -> Column:
    letters = F.length(F.regexp_replace(F.regexp_replace(col(t), r"\[[A-Z]+\]", ""), r"[^a-z]", ""))
    return clamp((letters - F.lit(1.8) * placeholders(t)) / 22, 0.0, 1.0)


def detect_labels(text: Col, rules: dict[str, Sequence[str]]) -> Column:
    """Labels of the rules of which some term occurs in the text, in the rules' order."""
    found = [F.when(F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(col(text), x)), F.lit(label)) for label, terms in rules.items()]
    return F.array_compact(F.array(*found))


def ordered_subsequence(seq: Col, motif: Sequence[str]) -> Column:
    """Whether the motif's items occur in this order, with gaps."""
    m = F.array(*map(F.lit, motif))
    return F.aggregate(col(seq), F.lit(0), lambda i, x: F.when(x == F.get(m, i), i + 1).otherwise(i)) == len(motif)


@F.pandas_udf(IntegerType())
def _lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """The table's row as bits of one number: a step costs one addition, not a row of cells."""
    out = []
    for x, y in zip(a, b, strict=True):
        where: dict = {}
        for i, v in enumerate(x if x is not None else ()):
            where[v] = where.get(v, 0) | 1 << i
        n = 0 if x is None else len(x)
        full = (1 << n) - 1
        row = full
        for v in y if y is not None else ():
            hit = row & where.get(v, 0)
            row = ((row + hit) | (row - hit)) & full
        out.append(n - row.bit_count())
    return pd.Series(out, dtype="int32")


def lcs_length(a: Col, b: Col) -> Column:
    """Length of a longest common subsequence of two arrays; null arrays are empty."""
    return _lcs_length(col(a), col(b))


@F.pandas_udf(ArrayType(StructType([StructField("left", IntegerType()), StructField("right", IntegerType())])))
def _lcs_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = ([] if v is None else list(v) for v in (x, y))
        table = [[0] * (len(y) + 1)]
        for v in x:
            row = [0]
            for j, w in enumerate(y):
                row.append(table[-1][j] + 1 if v == w else max(row[-1], table[-1][j + 1]))
            table.append(row)
        i, j, pairs = len(x), len(y), []
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                pairs.append({"left": i, "right": j})
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        out.append(pairs[::-1])
    return pd.Series(out)


def lcs_pairs(a: Col, b: Col) -> Column:
    """Places (left, right) of one longest common subsequence of two short arrays."""
    return _lcs_pairs(col(a), col(b))


def overlap_ratio(a: Col, b: Col) -> Column:
    """Shared distinct values over all distinct values, 0 for two empty arrays."""
    return F.size(F.array_intersect(col(a), col(b))) / F.greatest(F.size(F.array_union(col(a), col(b))), F.lit(1))


def is_number(s: Col) -> Column:
    return F.coalesce(col(s).rlike("^[0-9]+$"), F.lit(False))


def clean_role(s: Col) -> Column:
    """A role without leading articles and outer punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(col(s))), r"^(the|a|an) +", "")
    return F.regexp_replace(bare, r"^[.,;:]+|[.,;:]+$", "")


def useful_term(s: Col, stop: Sequence[str]) -> Column:
    return (F.length(col(s)) >= 2) & ~is_number(s) & ~col(s).isin(*stop)


@F.pandas_udf(ArrayType(IntegerType()))
def _occurrences(text: pd.Series, needle: pd.Series) -> pd.Series:
    out = []
    for t, n in zip(text, needle, strict=True):
        places, at = [], t.find(n) if t and n else -1
        while at >= 0:
            places.append(at)
            at = t.find(n, at + 1)
        out.append(places)
    return pd.Series(out)


def all_occurrences(text: Col, needle: Col) -> Column:
    """Positions from 0 of every occurrence, overlaps included, by one pass over the text."""
    return _occurrences(F.coalesce(col(text), F.lit("")), col(needle))


@F.pandas_udf(ArrayType(IntegerType()))
def _apart(positions: pd.Series, length: pd.Series) -> pd.Series:
    out = []
    for places, n in zip(positions, length, strict=True):
        kept = []
        for p in places if places is not None else ():
            if not kept or p >= kept[-1] + n:
                kept.append(int(p))
        out.append(kept)
    return pd.Series(out)


def apart(positions: Col, length: Col) -> Column:
    """Of ascending positions those that do not overlap one taken before."""
    return _apart(col(positions), col(length) if isinstance(length, (str, Column)) else F.lit(length))


def year_in_range(year: Col, start: Col, end: Col) -> Column:
    return F.coalesce(col(start), F.lit(-9999)).__le__(col(year)) & (col(year) <= F.coalesce(col(end), F.lit(9999)))


def clamp(x: Col, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def axis_level(matched: Col, possible: Col) -> Column:
    share = F.when(col(possible) > 0, col(matched) / col(possible)).otherwise(0.0)
    return F.when(share >= 0.67, "strong").when(share >= 0.34, "partial").when(share > 0, "weak").otherwise("none")


def operation_signature(op: Col, inputs: Col, output: Col) -> Column:
    return F.concat(col(op), F.lit("("), F.array_join(F.transform(col(inputs), lambda x: F.lower(F.trim(x))), ","), F.lit(")->"), F.coalesce(col(output), F.lit("?")))


def floor_div(a: Col, b: Col) -> Column:
    """Quotient rounded down; null for a zero divisor."""
    return F.floor(col(a) / F.nullif(col(b), F.lit(0))).cast("long")


def floor_mod(a: Col, b: Col) -> Column:
    return col(a) - col(b) * floor_div(a, b)


def ratio_compare(an: Col, ad: Col, bn: Col, bd: Col) -> Column:
    """-1, 0 or 1 by cross-multiplication of ratios with positive denominators."""
    d = "decimal(19,0)"
    return F.sign(col(an).cast(d) * col(bd).cast(d) - col(bn).cast(d) * col(ad).cast(d)).cast("int")


def ratio_rescale(n: Col, d: Col, target: Col) -> Column:
    """Numerator of n/d over the denominator ``target``, rounded down."""
    return F.floor(col(n) * col(target) / col(d)).cast("long")


def json_field(payload: Col, path: str) -> Column:
    return F.get_json_object(col(payload), path)


def mark_refs(text: Col, numbers: Col) -> Column:
    """Accepted note numbers right after a word become ``[^n]``."""
    return F.aggregate(col(numbers), col(text), lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?<=[A-Za-z])"), n, F.lit("(?![0-9])")), F.concat(F.lit("[^"), n, F.lit("]"))))


def parameter_fields(text: Col) -> Column:
    """(name, value) of every ``name: value`` or ``name=value``."""
    pattern = F.lit(r"([a-z_]+)[:=] ?([0-9]+)")
    t = F.coalesce(col(text), F.lit(""))
    return F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("value"))


def variants(term: Col, most: int = 12) -> Column:
    """The term and its bigrams (its characters too when it is one), longest first, then by text."""
    t = col(term)
    every = F.array_distinct(F.concat(F.array(t), char_ngrams(t, 2)))
    keyed = F.array_sort(F.transform(every, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.slice(F.transform(keyed, lambda s: s["x"]), 1, most)


def best_name(*fields: Col) -> Column:
    """First of the fields that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(col(f)), F.lit("")) for f in fields])
