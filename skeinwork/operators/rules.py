"""Term rules as data: lexicons, flags, scores and ordered gates."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import col


def haystack(title: Column | str, preview: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", col(title), F.coalesce(col(preview), F.lit(""))))


def term_pattern(terms: Sequence[str]) -> str:
    """One alternation for a whole set: terms as words, between which any blanks may stand."""
    body = "|".join(r"\s+".join(map(re.escape, t.lower().split())) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return f"(?<![a-z0-9])(?:{body})(?![a-z0-9])"


def sql_term_pattern(terms: Sequence[str]) -> str:
    """The same for engines without look-around; equal as long as only a hit is asked for."""
    return term_pattern(terms).replace("(?<![a-z0-9])", "(^|[^a-z0-9])").replace("(?![a-z0-9])", "($|[^a-z0-9])")


#: Set around every run of letters and digits in a marked text, so that a substring is a whole word.
MARK = "\x01"


def marked(text: Column) -> Column:
    """text with blanks collapsed and words marked: what terms are looked up in, made once a row."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "([a-z0-9]+)", f"{MARK}$1{MARK}")


def term_in(text: Column, marked_text: Column, term: str) -> Column:
    """Whether a term occurs as words: a substring search where the term begins and ends with a word, else a pattern."""
    plain = " ".join(term.lower().split())
    found = F.contains(marked_text, F.lit(re.sub("[a-z0-9]+", f"{MARK}\\g<0>{MARK}", plain)))
    whole = plain[:1].isascii() and plain[:1].isalnum() and plain[-1:].isascii() and plain[-1:].isalnum()
    return found if whole else text.rlike(term_pattern([term]))


def _matcher(lexicons: Mapping[str, Sequence[str]], whole: bool) -> Callable[[str], set[int]]:
    """Which lexicons (by place) have a term in a text; all terms are looked for in one pass."""
    listed: dict[str, set[int]] = {}
    for i, terms in enumerate(lexicons.values()):
        for t in terms:
            listed.setdefault(" ".join(t.lower().split()) if whole else t, set()).add(i)
    part_of_word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def stands_alone(text: str, a: int, z: int) -> bool:
        return not whole or ((a == 0 or text[a - 1] not in part_of_word) and (z == len(text) or text[z] not in part_of_word))

    try:
        import ahocorasick
    except ImportError:  # slower, but the same

        def found(text: str) -> set[int]:
            out: set[int] = set()
            for term, places in listed.items():
                at = text.find(term)
                while at >= 0 and not stands_alone(text, at, at + len(term)):
                    at = text.find(term, at + 1)
                out |= places if at >= 0 else set()
            return out

        return found
    tree = ahocorasick.Automaton()
    for term, places in listed.items():
        tree.add_word(term, (len(term), places))
    tree.make_automaton()

    def searched(text: str) -> set[int]:
        out: set[int] = set()
        for last, (size, places) in tree.iter(text):
            if not places <= out and stands_alone(text, last + 1 - size, last + 1):
                out |= places
        return out

    return searched


def lexicons_in(text: Column, lexicons: Mapping[str, Sequence[str]], whole: bool = True) -> Column:
    """struct of booleans: whether a term of each lexicon occurs in a lower-cased text; whole: as words, between which any blanks may stand.

    No built-in looks for a thousand terms in one pass; this is one Arrow-batched pass with an
    automaton of all terms. It isn't deterministic to the planner, so that no filter or sort runs it again.
    """
    names, lists = list(lexicons), {k: tuple(v) for k, v in lexicons.items()}
    made: list[Callable[[str], set[int]]] = []

    def rows(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(_matcher(lists, whole))
        hits = np.zeros((len(texts), len(names)), bool)
        for i, t in enumerate(texts):
            if t:
                hits[i, list(made[0](re.sub(r"[ \t\n\x0b\f\r]+", " ", t) if whole else t))] = True
        return pd.DataFrame(hits, columns=names)

    return F.pandas_udf(rows, "struct<" + ",".join(f"{n}:boolean" for n in names) + ">").asNondeterministic()(text)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whatever is filtered, sorted and derived by them.

    A predicate isn't pushed below a projection that isn't deterministic, nor is such a projection
    merged with what uses it; the row number here is only that mark, it changes no value.
    """
    return df.withColumns({k: F.when(F.monotonically_increasing_id() >= 0, c) for k, c in columns.items()})


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike(term_pattern(terms)) if terms else F.lit(False)


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """Distinct terms of the set that occur."""
    return reduce(lambda a, b: a + b, [contains_any(text, [t]).cast("int") for t in dict.fromkeys(terms)], F.lit(0))


def term_counts(df: DataFrame, text: Column, lexicons: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with a column per lexicon: how many of its distinct terms occur."""
    looked = once(df.withColumn("_text", text), _marked=marked(F.col("_text")))
    count = lambda terms: reduce(lambda a, b: a + b, [term_in(F.col("_text"), F.col("_marked"), t).cast("int") for t in dict.fromkeys(terms)], F.lit(0))
    return looked.withColumns({name: count(terms) for name, terms in lexicons.items()}).drop("_text", "_marked")


def contains_plain(text: Column, terms: Sequence[str]) -> Column:
    """Any of the terms as a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


@dataclass(frozen=True)
class Flag:
    """A flag: every set of `all_of` has a term in the text, none of `none_of` has; weight adds to the score."""

    name: str
    all_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()
    at_least: int = 1
    weight: int = 0


@dataclass(frozen=True)
class RuleBook:
    lexicons: Mapping[str, Sequence[str]]
    flags: Sequence[Flag]

    def column(self, flag: Flag, text: Column) -> Column:
        hits = [count_terms(text, self.lexicons[s]) >= flag.at_least if flag.at_least > 1 else contains_any(text, self.lexicons[s]) for s in flag.all_of]
        out = reduce(lambda a, b: a & b, hits, F.lit(True))
        return reduce(lambda a, b: a & b, [~contains_any(text, self.lexicons[s]) for s in flag.none_of], out)

    def sql(self, flag: Flag, text: str) -> str:
        one = lambda terms: f"regexp_matches({text}, '{sql_term_pattern(terms)}')"
        hits = [f"({' + '.join(f'CAST({one([t])} AS INT)' for t in dict.fromkeys(self.lexicons[s]))}) >= {flag.at_least}" if flag.at_least > 1 else one(self.lexicons[s]) for s in flag.all_of]
        return " AND ".join([*hits, *(f"NOT {one(self.lexicons[s])}" for s in flag.none_of)])

    def counts(self, text: Column, marked_text: Column) -> Column:
        """struct of the flags' lexicons: how many distinct terms occur, as far as a flag asks (1 if any will do)."""
        asked: dict[str, int] = {}
        for f in self.flags:
            for s in f.all_of:
                asked[s] = max(asked.get(s, 1), f.at_least)
            for s in f.none_of:
                asked.setdefault(s, 1)
        return F.struct(*[self._count(s, most, text, marked_text).alias(s) for s, most in asked.items()])

    def _count(self, lexicon: str, most: int, text: Column, marked_text: Column) -> Column:
        hits = [term_in(text, marked_text, t) for t in dict.fromkeys(self.lexicons[lexicon])]
        if most == 1:
            return reduce(lambda a, b: a | b, hits, F.lit(False)).cast("int")
        return reduce(lambda a, b: a + b, [h.cast("int") for h in hits], F.lit(0))

    def flagged(self, df: DataFrame, text: Column) -> DataFrame:
        """df with a boolean column per flag. Text is marked and searched once a row."""
        looked = once(once(df.withColumn("_text", text), _marked=marked(F.col("_text"))), _hits=self.counts(F.col("_text"), F.col("_marked")))
        hit = lambda s, n=1: F.coalesce(F.col(f"_hits.{s}") >= n, F.lit(False))
        flags = {f.name: reduce(lambda a, b: a & b, [*(hit(s, f.at_least) for s in f.all_of), *(~hit(s) for s in f.none_of)], F.lit(True)) for f in self.flags}
        return looked.withColumns(flags).drop("_text", "_marked", "_hits")

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.col(f.name), f.weight).otherwise(0) for f in self.flags if f.weight], F.lit(0))

    def applied(self) -> Column:
        """The weights that a row's score is made of."""
        return F.map_filter(F.create_map(*[x for f in self.flags if f.weight for x in (F.lit(f.name), F.when(F.col(f.name), f.weight).otherwise(0))]), lambda _, w: w != 0)


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Ordered rules: the name of the first that holds."""
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for condition, name in cases[1:]:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def notes(cases: Sequence[tuple[Column, str]]) -> Column:
    """The notes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))


def gate(cases: Sequence[tuple[Column, str]]) -> Column:
    """struct(status, reason): dropped by the first rule that holds, else kept."""
    reason = first_match(cases)
    return F.struct(F.when(reason.isNull(), "keep").otherwise("drop").alias("status"), reason.alias("reason"))


def any_flag(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) for n in names], F.lit(False))
