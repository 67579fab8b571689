"""Findings in a text, as one array column: no shuffle, no Python, one pass for each rule that a guard lets through."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.functions import text as tx
from graysift.functions.checks import CHECKS, digits
from graysift.functions.text import let, matches, quoted
from graysift.functions.rules import GENERIC, HIGH, MAX_NAMES, MAX_PER_TYPE, MAX_TERMS, NAME, RULES, SAID, SPECIAL, SPECIAL_NOTE, Rule

FINDING = (
    "struct<type:string,label:string,severity:string,category:string,note:string,value:string,masked:string,line:int,context:string,"
    "source:string,n:int,in_filename:boolean,is_signal:boolean,terms:array<string>,rationale:string,confidence:string>"
)
FINDINGS = f"array<{FINDING}>"
HITS = "array<struct<no:int,start:int,value:string,terms:array<string>>>"


#: Hits, or matches that need words near them, from which on a text is taken apart into blocks first.
MANY = 64


def rule_matches(text: str, rule: Rule, every: bool = False) -> Column:
    """The matches of a rule that pass its check and have its context words near; of names the first MAX_NAMES unless every."""
    found = matches(text, rule.pattern)
    if rule.type in CHECKS:
        found = F.filter(found, lambda m: CHECKS[rule.type](m["value"]))
    if rule.context:
        before, after = (100, 40) if rule is NAME else (120, 120)
        near = lambda m, held: tx.around(F.col(text), m["start"], F.length(m["value"]), before, after, held).rlike(rule.context)
        few = lambda all_: F.filter(all_, lambda m: near(m, None))
        many = lambda all_: let(tx.blocks(F.col(text)), lambda held: F.filter(all_, lambda m: near(m, held)))
        found = let(found, lambda all_: F.when(F.size(all_) <= MANY, few(all_)).otherwise(many(all_)))
    return F.slice(found, 1, MAX_NAMES) if rule is NAME and not every else found


def spellings(pattern: str) -> list[str]:
    """All strings that a pattern of letters, choices and optional parts stands for, in lower case."""

    def of(parts) -> list[str]:
        found = [""]
        for kind, x in parts:
            if kind.name == "LITERAL":
                some = [chr(x)]
            elif kind.name == "IN":
                some = [chr(c) for _, c in x]
            elif kind.name == "BRANCH":
                some = [w for branch in x[1] for w in of(branch)]
            elif kind.name == "SUBPATTERN":
                some = of(x[3])
            elif kind.name == "MAX_REPEAT" and x[:2] == (0, 1):
                some = ["", *of(x[2])]
            else:
                some = [""]
            found = [f + w for f in found for w in some]
        return found

    return [w.lower() for w in of(re._parser.parse(re.sub(r"^\(\?\w+\)", "", pattern)))]


def _pieces(pattern: str) -> list[str]:
    """Strings of which any text that the pattern matches holds one in lower case; none that holds another."""
    found: list[str] = []
    for w in sorted(set(spellings(pattern)), key=len):
        if not any(f in w for f in found):
            found.append(w)
    return found


def _first_words(pattern: str) -> set[str]:
    return {re.split(r"\W+", w)[0] for w in spellings(pattern)}


SECRET_WORDS = _first_words(r"wachtwoord|password|passwd|pwd|geheim|secret|api[_-]?key|token|bearer")
#: Words that begin what the rules of keywords look for.
KEYWORDS = sorted(SECRET_WORDS | {"digid"}.union(*(_first_words(s[2]) for s in SPECIAL)))
#: Characters that a rule takes for a letter whatever its case, though lower() does not make them that letter.
ODD_CASE = ("\u017f\u0131\u0130\u212a", "siik")


def _prepared(text: Column) -> Column:
    return F.lower(F.translate(text, *ODD_CASE))


def _keywords(low: Column) -> Column:
    """The KEYWORDS among the words of a lower-cased text."""
    return F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*map(F.lit, KEYWORDS)))


def _near(rule: Rule, text: Column, low: Column, words: Column, digit: Column, six: Column) -> Column:
    """True for every text with a match of the rule, and for few others. low: _prepared(text); words: its _keywords;
    digit, six: it holds a digit; six of them with at most a separator between."""
    held = lambda pieces: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in pieces])
    if rule.type == "geheim":
        named = F.arrays_overlap(words, F.array(*map(F.lit, sorted(SECRET_WORDS)))) & text.rlike("[:=]")
        return named | held(("sk-", "ghp_", "atk_", "akia"))
    if rule.type == "digid":
        return F.array_contains(words, "digid")
    if rule.type == "email":
        return F.contains(text, F.lit("@"))
    context = held(_pieces(rule.context)) if rule.context and len(_pieces(rule.context)) <= 24 else None
    if rule is NAME:
        return context & text.rlike(rule.guard)
    near = (six if rule.type in ("bsn", "betaalkaart", "telefoon", "big", "leerlingnummer") else digit) & text.rlike(rule.guard)
    if rule.context:  # a slice of the text can begin or end within a word, so boundaries do not count here
        near = near & (text.rlike(rule.context.replace(r"\b", "")) if context is None else context)
    return near


def rule_hits(text: str, rule: Rule, no: int, every: bool = False, near: Column | None = None) -> Column:
    """struct<found, over>: the first match of each value (letter case aside), MAX_PER_TYPE at most, and how many
    different values there are beyond these; every: all values, none beyond. near: false for texts to pass over."""

    def capped(found: Column, keys: Column, different: Column) -> Column:
        hit = lambda m: F.struct(F.lit(no).alias("no"), m["start"].alias("start"), m["value"].alias("value"), F.lit(None).cast("array<string>").alias("terms"))
        if every:
            firsts = F.transform(tx.first_places(keys), lambda i: hit(F.get(found, i)))
        else:
            firsts = F.transform(F.slice(different, 1, MAX_PER_TYPE), lambda k: hit(F.get(found, F.array_position(keys, k).cast("int") - 1)))
        return F.struct(firsts.alias("found"), (F.lit(0) if every else F.greatest(F.size(different) - MAX_PER_TYPE, F.lit(0))).alias("over"))

    found = lambda m: let(F.transform(m, lambda x: F.lower(x["value"])), lambda keys: let(F.array_distinct(keys), lambda d: capped(m, keys, d)))
    none = F.struct(F.array().cast(HITS).alias("found"), F.lit(0).alias("over"))
    if near is None:
        near = F.col(text).rlike(rule.guard)
        if rule.context:  # a slice of the text can begin or end within a word, so boundaries do not count here
            near = near & F.col(text).rlike(rule.context.replace(r"\b", ""))
    return F.when(near, let(rule_matches(text, rule, every), found)).otherwise(none)


def special_hits(text: str, pattern: str, no: int, near: Column | None = None) -> Column:
    """One hit that lists the first MAX_TERMS different words of a special category, or none. near: see rule_hits."""
    terms = lambda found: F.slice(F.array_distinct(F.transform(found, lambda m: F.lower(m["value"]))), 1, MAX_TERMS)
    one = lambda found, t: F.struct(F.lit(no).alias("no"), F.get(found, F.lit(0))["start"].alias("start"), F.array_join(t, ", ").alias("value"), t.alias("terms"))
    found = let(matches(text, pattern), lambda found: let(terms(found), lambda t: one(found, t)))
    here = F.col(text).rlike(pattern) if near is None else near & F.col(text).rlike(pattern)
    return F.when(here, F.array(found)).otherwise(F.array().cast(HITS))


def _table() -> Column:
    """What the catalogue says of each rule, special category and the name rule, by number."""
    rows = [(r.type, r.label, r.severity, r.category, r.note) for r in RULES] + [(t, label, HIGH, "bijzonder", SPECIAL_NOTE) for t, label, _ in SPECIAL]
    rows.append((NAME.type, NAME.label, NAME.severity, NAME.category, NAME.note))
    names = ("type", "label", "severity", "category", "note")
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {quoted(x)}" for n, x in zip(names, r, strict=True)) + ")" for r in rows) + ")")


def _findings(text: Column, hits: Column, in_filename: bool, context: Column | None) -> Column:

    def one(h: Column, rule: Column, known: Column | None) -> Column:
        length = F.length(F.coalesce(F.get(h["terms"], F.lit(0)), h["value"]))
        masked = F.when(h["terms"].isNotNull(), h["value"]).when(rule["category"] == "geheim", tx.mask_secret(h["value"])).otherwise(tx.mask(h["value"]))
        return F.struct(
            *[rule[c].alias(c) for c in ("type", "label", "severity", "category", "note")], h["value"].alias("value"), masked.alias("masked"),
            line(h["start"], known).alias("line"), (around(h["start"], length, known) if context is None else context).alias("context"),
            F.lit("patroon").alias("source"), F.coalesce(F.size(h["terms"]), F.lit(1)).alias("n"), F.lit(in_filename).alias("in_filename"),
            (h["no"] >= len(RULES)).alias("is_signal"), h["terms"].alias("terms"), F.lit(None).cast("string").alias("rationale"), F.lit(None).cast("string").alias("confidence"),
        ).cast(FINDING)

    def line(start: Column, known: Column | None) -> Column:
        if in_filename:
            return F.lit(0)
        return tx.line_number(text, start) if known is None else tx.count_below(known["newlines"], start) + 1

    def around(start: Column, length: Column, known: Column | None) -> Column:
        return tx.snippet(text, start, length) if known is None else tx.snippet(text, start, length, n=known["n"], held=known["blocks"])

    listed = lambda known: let(_table(), lambda table: F.transform(hits, lambda h: let(F.get(table, h["no"]), lambda rule: one(h, rule, known))))
    if in_filename:
        return listed(None)
    return F.when(F.size(hits) <= MANY, listed(None)).otherwise(let(tx.index(text), listed))


def without_generic(findings: Column) -> Column:
    """Drops plain-number findings whose digits equal, hold or lie within six or more digits of another type."""
    specific = F.filter(F.transform(F.filter(findings, lambda f: ~f["type"].isin(*GENERIC)), lambda f: digits(f["value"])), lambda d: F.length(d) >= 6)
    covered = lambda f, known: let(digits(f["value"]), lambda own: F.exists(known, lambda d: F.contains(own, d) | F.contains(d, own)))
    return let(specific, lambda known: F.filter(findings, lambda f: ~(f["type"].isin(*GENERIC) & covered(f, known))))


@lru_cache(maxsize=8)
def _columns(every: bool, gateway: int) -> tuple[dict[str, Column], Column, Column]:
    """For with_findings: a column of hits for each rule, all hits, and the warnings. They name columns only, so they are
    made once for a driver (gateway)."""
    text, low, words, digit, six = (F.col(f"__{c}") for c in ("text", "low", "words", "digit", "six"))
    rules = [*enumerate(RULES), (len(RULES) + len(SPECIAL), NAME)]
    hits = {f"__{no}": rule_hits("__text", r, no, every, _near(r, text, low, words, digit, six)) for no, r in rules}
    listed = lambda s: F.arrays_overlap(words, F.array(*map(F.lit, sorted(_first_words(s[2])))))
    special = F.when(F.size(words) > 0, F.concat(*[special_hits("__text", s[2], len(RULES) + k, listed(s)) for k, s in enumerate(SPECIAL)])).otherwise(F.array().cast(HITS))
    found = F.concat(*[F.col(f"__{no}.found") for no, _ in rules[:-1]], special, F.col(f"__{rules[-1][0]}.found"))
    over = F.array(*[F.struct(F.lit(r.label).alias("label"), F.col(f"__{no}.over").alias("n")) for no, r in rules])
    told = lambda x: F.format_string(SAID["more"], x["label"], x["n"], F.lit(MAX_PER_TYPE))
    return hits, found, F.transform(F.filter(over, lambda x: x["n"] > 0), told)


def with_findings(docs: DataFrame, text: Column, into: str, warnings: str, in_filename: bool = False, context: Column | None = None, every: bool = False) -> DataFrame:
    """docs with the findings of a text and the warnings about it as array columns. Null counts as empty; an empty
    text has none of either. context: what to show instead of what stands around a finding.

    Up to MAX_PER_TYPE different values of a type are listed and the others counted in a warning; every: all are listed. The
    columns are made in layers: the text in lower case and its keywords, whether it has digits, the hits of each rule
    that these let through, the findings. Each pattern is run once; no rows are shuffled or exploded.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    hits, found, told = _columns(every, id(SparkContext._gateway))
    docs = docs.select(*names, F.coalesce(text, F.lit("")).alias("__text"))
    docs = docs.select("*", _prepared(F.col("__text")).alias("__low"), F.col("__text").rlike(r"(?U)\d").alias("__digit"))
    six = F.col("__digit") & F.col("__text").rlike(r"(?U)\d(?:[ .\-]?\d){5}")
    docs = docs.select("*", _keywords(F.col("__low")).alias("__words"), six.alias("__six"))
    docs = docs.select("*", *[c.alias(n) for n, c in hits.items()])
    docs = docs.select(*names, "__text", found.alias("__hits"), told.alias("__told"))
    all_ = F.when(F.size("__hits") > 0, _findings(F.col("__text"), F.col("__hits"), in_filename, context)).otherwise(F.array().cast(FINDINGS))
    docs = docs.select(*names, all_.alias("__all"), "__told")
    return docs.select(*names, F.when(F.size("__all") < 2, F.col("__all")).otherwise(without_generic(F.col("__all"))).alias(into), F.col("__told").alias(warnings))

