"""Operator 6: quality rules as a short-circuit cascade, all in built-in Spark functions.

``cascade`` measures on a sample over the whole table how long each rule takes (repeated in one job, less
an empty one) and how often it rejects what the rules before it let pass, then nests the rules in one CASE
expression by rejections per second, so that most bad texts are decided by a cheap rule and the dear ones
run on what is left. The order changes the cost alone, never the verdict: a text is kept if no rule
rejects it.

Null and empty texts have no words and are rejected (fewer than 50 words). An empty table gives an
empty result. Repeated rows are judged one by one. Extra columns pass through ``filter_documents``
and play no part, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, unused, words_of

MIN_WORDS = 50
#: Rows of the sample on which cost and selectivity are measured; the verdict does not depend on it.
SAMPLE_ROWS = 256
#: How often a rule is applied to each row of the sample while it is timed.
REPEATS = 8
POSITION_BITS = 20
TEXT, WORDS, TURN = "__text", "__words", "__turn"


def n_symbols_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines_of(text: Column) -> Column:
    return let(lines_of(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _covered(positions: Column) -> Column:
    """Words under 3-word windows that start at these ascending positions."""
    return F.aggregate(
        F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3)).cast("int"))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )


def n_repeat_words_of(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only texts with a repeat are sorted: by hash and position
    packed into one long where the shortened hashes tell as many windows apart as the full ones,
    else by pairs.
    """
    low = (1 << POSITION_BITS) - 1

    def packed(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        starts = lambda x: F.shiftright(x, POSITION_BITS)
        return let(
            keys,
            lambda k: let(
                F.sort_array(
                    F.transform(
                        F.filter(k, lambda x, i: F.coalesce(starts(x) == starts(F.get(k, i - 1)), F.lit(False)) | F.coalesce(starts(x) == starts(F.get(k, i + 1)), F.lit(False))),
                        lambda x: x.bitwiseAND(F.lit(low)),
                    )
                ),
                _covered,
            ),
        )

    def paired(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        return let(
            pairs,
            lambda k: let(
                F.sort_array(
                    F.transform(
                        F.filter(k, lambda x, i: F.coalesce(x["h"] == F.get(k, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(k, i + 1)["h"], F.lit(False))),
                        lambda x: x["i"],
                    )
                ),
                _covered,
            ),
        )

    def counted(hashes: Column) -> Column:
        short = F.transform(hashes, lambda h: h.bitwiseAND(F.lit(~low)))
        return let(
            F.size(F.array_distinct(hashes)),
            lambda distinct: F.when(distinct == F.size(hashes), F.lit(0).cast("long"))
            .when((F.size(hashes) <= low) & (F.size(F.array_distinct(short)) == distinct), packed(hashes))
            .otherwise(paired(hashes)),
        )

    return let(
        words,
        lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
            let(F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2])), counted)
        ),
    )


def word_chars_of(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a text to reject; it must not be null."""

    name: str
    rejects: object


RULES = (
    Rule("too_few_words", lambda t, w: F.size(w) < MIN_WORDS),
    Rule("symbols", lambda t, w: n_symbols_of(t) * 4 > F.size(w)),
    Rule("shouting", lambda t, w: F.regexp_count(t, F.lit(r"!!")) * 10 > F.size(w) * 3),
    Rule("capitals", lambda t, w: F.regexp_count(t, F.lit(r"\p{Lu}")) * 10 > F.length(t) * 5),
    Rule("word_length", lambda t, w: (word_chars_of(w) < F.size(w) * 2) | (word_chars_of(w) > F.size(w) * 15)),
    Rule("repeated_lines", lambda t, w: n_dup_lines_of(t) * 10 > F.size(lines_of(t)) * 4),
    Rule("repeated_words", lambda t, w: n_repeat_words_of(w) * 100 > F.size(w) * 50),
)


def order_rules(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = REPEATS) -> list[Rule]:
    """Rules by rejections per second on the sample (columns TEXT, WORDS), best first; ties: as given.

    Each rule is timed in a job that applies it ``repeats`` times to each row, less the time of such a job
    without a rule. After a rule is placed, the next is chosen by what it rejects among the rows that are left.
    """
    text, words = F.col(TEXT), F.col(WORDS)
    held = sample.cache()
    try:
        n = held.count()
        many = held.withColumn(TURN, F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def seconds(rejects: Column) -> float:
            began = time.perf_counter()
            many.agg(F.count_if(rejects)).first()
            return time.perf_counter() - began

        # the copy's number is part of the text, so that no copy's result can stand in for another's
        turned = F.concat(text, F.when(F.col(TURN) < 0, F.col(TURN).cast("string")).otherwise(""))
        nothing = seconds(F.length(turned) < 0) if n else 0.0
        cost = {r.name: max(1e-4, seconds(r.rejects(turned, words)) - nothing) if n else 1.0 for r in rules}
        order, left = [], list(rules)
        passed = F.lit(True)
        while left:
            counts = held.agg(*[F.count_if(passed & r.rejects(text, words)).alias(f"r{k}") for k, r in enumerate(left)]).first() if n else [0] * len(left)
            best = max(range(len(left)), key=lambda k: (counts[k] / cost[left[k].name], -k))
            order.append(left.pop(best))
            passed = passed & ~order[-1].rejects(text, words)
    finally:
        held.unpersist()
    return order


def prepared(df: DataFrame, text: str, names: tuple[str, str]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumns({names[0]: body, names[1]: words_of(body)})


def _sample(df: DataFrame, text: str, rows: int) -> DataFrame:
    """Rows of an even sample over the whole table, at most about ``rows`` of them."""
    body = df.select(F.col(f"`{text}`").alias(TEXT))
    return prepared(body.orderBy(F.rand(7)).limit(rows), TEXT, (TEXT, WORDS))


def cascade(df: DataFrame, text: str, names: tuple[str, str], rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Column:
    """A boolean column over ``prepared(df, text, names)``: true where no rule rejects."""
    kept = F
    for rule in order_rules(_sample(df, text, sample_rows), rules):
        kept = kept.when(rule.rejects(F.col(names[0]), F.col(names[1])), F.lit(False))
    return kept.otherwise(F.lit(True))


def filter_documents(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that every rule accepts, with df's columns."""
    names = tuple(unused(df, TEXT, WORDS))
    return prepared(df, text, names).filter(cascade(df, text, names, rules)).select(*[F.col(f"`{c}`") for c in df.columns])


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Base measures and verdict of each row."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__raw"))
    t, w = F.col(TEXT), F.col(WORDS)
    rows = prepared(own, "__raw", (TEXT, WORDS)).select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        word_chars_of(w).alias("word_chars"),
        n_symbols_of(t).alias("n_symbols"),
        n_dup_lines_of(t).alias("n_dup_lines"),
        n_repeat_words_of(w).alias("n_repeat_words"),
        cascade(own, "__raw", (TEXT, WORDS), rules).alias("__verdict"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("__verdict")).alias("kept")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
tri as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1),
rep as (select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
m as (
  select doc_id, t, l, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols * 4 > n_words
            or len(regexp_extract_all(t, '!!')) * 10 > n_words * 3
            or len(regexp_extract_all(t, '\p{Lu}')) * 10 > length(t) * 5
            or word_chars < n_words * 2 or word_chars > n_words * 15
            or n_dup_lines * 10 > len(l) * 4) as kept
from m
"""
