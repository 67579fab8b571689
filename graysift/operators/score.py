"""From findings to verdicts: merging, weighing, ordering, advice and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graysift.functions import text as tx
from graysift.functions.rules import ADVICE, HIGH, IDENTIFYING, LOW, MEDIUM, NONE, RANK, SAID, TOPIC_NOTE, TOPIC_SUFFIX, UNKNOWN
from graysift.operators.detect import FINDING, let


def rank(severity: Column) -> Column:
    return F.when(severity == HIGH, 3).when(severity == MEDIUM, 2).when(severity == LOW, 1).otherwise(0)


def severity_of(rank_: Column) -> Column:
    return F.when(rank_ == 3, HIGH).when(rank_ == 2, MEDIUM).when(rank_ == 1, LOW).otherwise(NONE)


def _key(f: Column) -> Column:
    listed = F.coalesce(F.size(f["terms"]) > 0, F.lit(False))
    return F.when(listed, F.concat(F.lit("\x01"), f["type"])).otherwise(F.concat(f["type"], F.lit("\x00"), tx.strip(F.lower(f["value"]))))


def merge_findings(findings: Column) -> Column:
    """One finding for each type and value (for each special category, whatever its words).

    Of the same value a pattern's finding counts before a model's, otherwise the first; n is the number of
    findings and the severity the highest. Words of a category are joined in order and counted. Findings are
    ordered by severity, then type, then where they came first.
    """

    def merged(same: Column, chosen: Column, terms: Column, text: Column) -> Column:
        listed = F.size(terms) > 0
        value = F.when(listed, F.array_join(terms, ", ")).otherwise(chosen["value"])
        return F.struct(
            chosen["type"].alias("type"), chosen["label"].alias("label"), severity_of(F.array_max(F.transform(same, lambda f: rank(f["severity"])))).alias("severity"),
            chosen["category"].alias("category"), chosen["note"].alias("note"), value.alias("value"), F.when(listed, value).otherwise(chosen["masked"]).alias("masked"),
            F.when(listed & text.isNotNull(), text["line"]).otherwise(chosen["line"]).alias("line"), chosen["context"].alias("context"), chosen["source"].alias("source"),
            F.when(listed, F.size(terms)).otherwise(F.size(same)).alias("n"), F.when(listed, text.isNull()).otherwise(chosen["in_filename"]).alias("in_filename"),
            chosen["is_signal"].alias("is_signal"), F.when(listed, terms).alias("terms"), chosen["rationale"].alias("rationale"), chosen["confidence"].alias("confidence"),
        ).cast(FINDING)

    def one(same: Column) -> Column:
        first = lambda found: F.get(found, F.lit(0))
        chosen = F.coalesce(first(F.filter(same, lambda f: f["source"] == "patroon")), first(same))
        terms = F.array_distinct(F.flatten(F.transform(same, lambda f: F.coalesce(f["terms"], F.array().cast("array<string>")))))
        text = first(F.filter(same, lambda f: ~f["in_filename"]))
        return let(chosen, lambda c: let(terms, lambda t: let(text, lambda x: merged(same, c, t, x))))

    def ordered(keys: Column) -> Column:
        """keys sorted with their places: each run of equal ones is one group, whose first place is its own."""
        rows = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j - 1)["k"] != F.get(s, j)["k"]))
        run = lambda s, at, j: tx.items(s, F.get(at, j), F.coalesce(F.get(at, j + 1), F.size(s)) - 1)
        runs = let(rows, lambda s: let(starts(s), lambda at: F.transform(at, lambda _, j: F.transform(run(s, at, j), lambda x: x["i"]))))
        groups = F.transform(runs, lambda places: let(one(F.transform(places, lambda i: F.get(findings, i))), lambda f: F.struct((-rank(f["severity"])).alias("o"), f["type"].alias("t"), F.get(places, F.lit(0)).alias("i"), f.alias("f"))))
        return F.transform(F.array_sort(groups), lambda x: x["f"])

    return let(F.transform(findings, _key), ordered)


def weigh_topics(findings: Column) -> Column:
    """Special categories become light topics where nothing points at a person. The order stays."""
    person = F.exists(findings, lambda f: f["type"].isin(*IDENTIFYING))
    topic = lambda f: f["is_signal"] & (f["category"] == "bijzonder")
    light = lambda f: f.withField("severity", F.lit(LOW)).withField("label", F.concat(f["label"], F.lit(TOPIC_SUFFIX))).withField("note", F.lit(TOPIC_NOTE))
    return F.when(person, findings).otherwise(F.transform(findings, lambda f: F.when(topic(f), light(f)).otherwise(f)))


def verdict(findings: Column, readable: Column) -> Column:
    return F.when(~readable, UNKNOWN).otherwise(severity_of(F.coalesce(F.array_max(F.transform(findings, lambda f: rank(f["severity"]))), F.lit(0))))


def advice(verdict_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair]), verdict_)


def summarise(results: DataFrame, threshold: str = MEDIUM, names: bool = False) -> DataFrame:
    """One row over results (name, verdict): files, a count for each verdict, the highest verdict, how many reach the
    threshold, how many could not be read, the advice; with names also the sorted names of both.

    The name lists are one row for reports of a run of few files; over a large corpus blocked() is a table. No rows: zero
    counts and verdict geen.
    """
    r = rank(F.col("verdict"))
    reached = (F.col("verdict") != UNKNOWN) & (r >= RANK[threshold])
    lists = [F.array_sort(F.collect_list(F.when(reached, F.col("name")))).alias("blocked"), F.array_sort(F.collect_list(F.when(F.col("verdict") == UNKNOWN, F.col("name")))).alias("unreadable")]
    out = results.agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ADVICE], severity_of(F.coalesce(F.max(r), F.lit(0))).alias("highest"),
        F.count_if(reached).alias("n_blocked"), *(lists if names else []),
    )
    text = F.when(F.col("n_blocked") == 0, SAID["clean"]).otherwise(F.format_string(SAID["blocked"], "n_blocked", "files", F.lit(threshold)))
    unread = F.when(F.col(f"n_{UNKNOWN}") > 0, F.format_string(SAID["unread"], f"n_{UNKNOWN}")).otherwise("")
    return out.withColumn("threshold", F.lit(threshold)).withColumn("advice", F.concat(text, unread))


def blocked(results: DataFrame, threshold: str = MEDIUM) -> DataFrame:
    """The results that reach the threshold."""
    return results.filter((F.col("verdict") != UNKNOWN) & (rank(F.col("verdict")) >= RANK[threshold]))


def exit_code(highest: str, threshold: str = MEDIUM) -> int:
    """2 if the highest verdict reaches the threshold, else 0."""
    return 2 if RANK[highest] >= RANK[threshold] else 0
