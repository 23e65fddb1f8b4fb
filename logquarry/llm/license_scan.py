"""License statements in texts: ordered signature rules over normalised words.

A text becomes its words, lower-cased and divided by single blanks, and rules are regular expressions
over that (license_rules.py).  Rules share keywords: only texts that hold one are searched, once for
each priority, by all its rules as ordered alternatives; the match then tells which rule it was.
Detections overlap (a version's statement holds the license's name): one that lies inside another of
the same or a higher priority is dropped.  All of it is column expressions inside one row; texts are
neither shuffled nor exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.license_rules import Signature, gate, signatures

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What divides words: all ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are counted in any case, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def lowered(text: Column) -> Column:
    """A text with A-Z lowered, null as empty.  lower() does that and more; two letters beyond ASCII would
    become ASCII ones, so texts that hold them are translated letter by letter."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _places(rules: Sequence[Signature]) -> str:
    """SQL for the places in norm where rules, all of one keyword and priority, match: s, ne (the end,
    negative), np (the priority, negative), label, c."""
    every = f"r'(?<= )(?:{'|'.join(r.pattern for r in rules)})(?= )'"
    which = " ".join(f"when m.t rlike r'^(?:{r.pattern})$' then named_struct('label', '{r.label}', 'c', {r.confidence}D)" for r in rules)
    pieces = f"zip_with(slice(split(norm, {every}, -1), 1, size(regexp_extract_all(norm, {every}, 0))), regexp_extract_all(norm, {every}, 0), (a, b) -> named_struct('skip', length(a), 't', b))"
    runs = _let("z", pieces, f"transform(sequence(0, size(z) - 1, {_RUN}), i -> slice(z, i + 1, {_RUN}))")
    heads = "aggregate(runs, array(0), (h, run) -> array_append(h, element_at(h, -1) + aggregate(run, 0, (n, x) -> n + x.skip + length(x.t))))"
    placed = """flatten(transform(runs, (run, i) -> aggregate(run, named_struct('at', heads[i], 'out', cast(array() as array<struct<s:int,e:int,t:string>>)),
        (acc, x) -> named_struct('at', acc.at + x.skip + length(x.t), 'out', array_append(acc.out, named_struct('s', acc.at + x.skip, 'e', acc.at + x.skip + length(x.t), 't', x.t))),
        acc -> acc.out)))"""
    return f"""if(norm rlike {every}, transform(transform({_let("runs", runs, _let("heads", heads, placed))},
        m -> named_struct('m', m, 'r', case {which} end)),
        x -> named_struct('s', x.m.s, 'ne', -x.m.e, 'np', -{rules[0].priority}, 'label', x.r.label, 'c', x.r.c)), {_NONE})"""


#: Matches whose places are summed up in one run.  Appending copies a list, so long ones are made of runs.
_RUN = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL for body, where name stands for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_NONE = "cast(array() as array<struct<s:int,ne:int,np:int,label:string,c:double>>)"


def _found(rules: Sequence[Signature]) -> str:
    """SQL for all places of all rules, keyword by keyword."""
    by: dict[str, dict[int, list[Signature]]] = {}
    for r in rules:
        by.setdefault(r.keyword, {}).setdefault(r.priority, []).append(r)
    each = (f"if(contains(norm, '{keyword}'), concat({', '.join(map(_places, of.values()))}), {_NONE})" for keyword, of in by.items())
    return f"concat({', '.join(each)})"


def scan_licenses(docs: DataFrame, rules: list[Signature] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_found.

    Words are runs of a-z, 0-9 and all beyond ASCII, after A-Z are lowered.  n_base counts the places
    of BASE phrases, first_word and last_word their least and greatest first word, from 0.  labels adds
    those of detections that no other suppresses; n_found counts these, score is the confidence of the
    surest.  Of equal intervals of equal priority the lesser label stays; of rules with one keyword and
    priority the first that matches at a place is the one detected.  A null text is empty;
    null ids and repeated rows are passed on; further columns are ignored.  Narrow: no shuffle.
    """
    rules = signatures() if rules is None else rules
    words = F.trim(F.regexp_replace(lowered(F.col("text")), _BETWEEN, " "))
    norm = docs.select("doc_id", words.alias("norm")).select(
        "doc_id", F.concat(F.lit(" "), "norm", F.lit(" ")).alias("norm"), (F.col("norm") == "").alias("empty")
    )
    # Base phrases and rules are looked for only where a word begins one of the keywords.
    keywords = [*(r.keyword for r in rules), *(phrase for phrase, _ in BASE)]
    norm = norm.select("*", F.col("norm").rlike(gate(keywords)).alias("gate"))
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    has = {phrase: F.contains("norm", F.lit(f" {phrase} ")) for phrase, _ in BASE}

    def base(phrase: str, column) -> F.Column:
        return F.when(F.col("gate") & has[phrase], column)

    columns = {"n_words": F.when(F.col("empty"), 0).otherwise(blanks(F.col("norm")) - 1).cast("long")}
    columns["n_base"] = sum((F.coalesce(base(p, F.regexp_count("norm", F.lit(f"(?<= ){p}(?= )"))), F.lit(0)) for p, _ in BASE), F.lit(0)).cast("long")
    start = lambda p: blanks(F.substr("norm", F.lit(1), F.instr(F.col("norm"), f" {p} "))) - 1
    end = lambda p: blanks(F.regexp_extract("norm", f"(?s)^(.* ){p} ", 1)) - 1
    columns["first_word"] = F.least(*(base(p, start(p)) for p, _ in BASE)).cast("long")
    columns["last_word"] = F.greatest(*(base(p, end(p)) for p, _ in BASE)).cast("long")
    columns["base_list"] = F.array_compact(F.array(*(base(p, F.lit(label)) for p, label in BASE)))

    kept = F.expr(
        """aggregate(array_sort(found),
            named_struct('ends', array(0, 0, 0, 0), 'labels', cast(array() as array<string>), 'score', 0D, 'n', 0L),
            (acc, d) -> named_struct(
                'ends', transform(acc.ends, (v, i) -> if(i < -d.np, greatest(v, -d.ne), v)),
                'labels', if(acc.ends[-d.np - 1] >= -d.ne, acc.labels, array_union(acc.labels, array(d.label))),
                'score', if(acc.ends[-d.np - 1] >= -d.ne, acc.score, greatest(acc.score, d.c)),
                'n', if(acc.ends[-d.np - 1] >= -d.ne, acc.n, acc.n + 1)))"""
    )
    empty = F.expr("cast(array() as array<string>)")
    return (
        norm.select("doc_id", "norm", "gate", *(c.alias(n) for n, c in columns.items()))
        .withColumn("found", F.when(F.col("gate"), F.expr(_found(rules))))
        .drop("norm")
        .withColumn("kept", kept)
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.concat_ws(",", F.array_sort(F.array_distinct("base_list"))).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.array_union("base_list", F.coalesce("kept.labels", empty)))).alias("labels"),
            F.coalesce("kept.score", F.lit(0.0)).alias("score"),
            F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_found"),
        )
    )
