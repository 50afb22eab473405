"""Re-Pair of all strings of a table at once: long ones in rounds without Python, others in their rows.

A token is named by the place of its first symbol and knows the next one's place, so joining tokens changes only the rows of
those joined and nothing is numbered anew. A round picks for each text the neighbours whose joined text saves most (the
earliest on ties), takes their places apart from the left, and joins them. Texts that nothing more saves leave the rounds.
Neighbours are dealt by text and joined text, so a long text is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from joinery.functions.scalars import canonical_text, code_points
from joinery.plans.options import StringOptions
from joinery.plans.solve import assembly_of_strings
from joinery.runtime import materialise

#: Symbols of a text that is repaired in its row.
IN_ROW = 1 << 17


def tokens_of(strings: DataFrame) -> DataFrame:
    """id, at, next, piece: a token for each symbol of strings (id, text); next is null at the end."""
    at = strings.select("id", F.posexplode(code_points(F.col("text"))).alias("at", "piece"), F.length("text").alias("n"))
    return at.select("id", "at", F.when(F.col("at") + 1 < F.col("n"), F.col("at") + 1).alias("next"), "piece")


def neighbours(tokens: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, at, next, key, taken: each two neighbouring tokens, their joined text, and whether a choice from the left takes them."""
    right = tokens.select("id", F.col("at").alias("next"), F.col("piece").alias("_piece"))
    pairs = tokens.join(right, ["id", "next"]).select("id", "at", "next", canonical_text(F.concat("piece", "_piece"), accept_reversed).alias("key"))
    # of one key, a pair shares a token with another only if it begins where that one's second token does
    w = Window.partitionBy("id", "key").orderBy("at")
    starts = ~F.coalesce(F.lag("next").over(w) == F.col("at"), F.lit(False))
    runs = pairs.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordinal = F.row_number().over(Window.partitionBy("id", "key", "_run").orderBy("at"))
    return runs.withColumn("taken", ordinal % 2 == 1).drop("_run")


def best_keys(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """id, key, new of each text's best joined text, if it saves anything; known (id, key) are built already and cost nothing more."""
    groups = pairs.groupBy("id", "key").agg(F.sum(F.col("taken").cast("long")).alias("n"), F.min("at").alias("first"))
    met = groups.join(known.withColumn("_known", F.lit(1)), ["id", "key"], "left")
    new = F.col("_known").isNull()
    gain = (F.col("n") - new.cast("long")).alias("gain")
    rated = met.select("id", "key", "first", new.alias("new"), gain).where("gain > 0")
    best = F.max(F.struct("gain", (-F.col("first")).alias("_early"), "key", "new")).alias("b")
    return rated.groupBy("id").agg(best).select("id", "b.key", "b.new")


def joined(tokens: DataFrame, pairs: DataFrame, best: DataFrame) -> DataFrame:
    """tokens after the best key's pairs are joined."""
    taken = pairs.where("taken").join(best, ["id", "key"]).select("id", "at", F.col("next").alias("_gone"))
    gone = taken.select("id", F.col("_gone").alias("at"))
    right = tokens.select("id", F.col("at").alias("_gone"), F.col("next").alias("_next"), F.col("piece").alias("_piece")).join(taken, ["id", "_gone"])
    left = tokens.join(gone, ["id", "at"], "left_anti").join(right.drop("_gone"), ["id", "at"], "left")
    whole = F.col("_piece").isNotNull()
    return left.select("id", "at", F.when(whole, F.col("_next")).otherwise(F.col("next")).alias("next"), F.when(whole, F.concat("piece", "_piece")).otherwise(F.col("piece")).alias("piece"))


def repaired(strings: DataFrame, accept_reversed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tokens that are left, rules in the order built) of strings (id, text): id, at, next, piece and id, round, key.

    Null and empty texts have no tokens; ids are unique. A round joins one key of each text, so there are as many rounds as the
    longest grammar has steps; each round is written to the shared folder, and the driver sees only whether any text has a step.
    """
    tokens = materialise(tokens_of(strings), "tokens")
    # single symbols are no joined text, so only rules count as known
    rules = strings.select("id", F.lit(0).alias("round"), F.lit("").alias("key")).limit(0)
    done, round_ = None, 0
    while True:
        round_ += 1
        pairs = materialise(neighbours(tokens, accept_reversed), "neighbours")
        best = materialise(best_keys(pairs, rules.select("id", "key")), "best")
        ended = tokens.join(best, "id", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        if best.isEmpty():
            return done, rules
        rules = rules.unionByName(best.where("new").select("id", F.lit(round_).alias("round"), "key"))
        tokens = materialise(joined(tokens.join(best.select("id"), "id", "left_semi"), pairs, best), "tokens")


def repair_bounds(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """id, upper_bound, rule_count, remaining_fragments: -1, 0 and 0 for an empty text, nulls for a null one.

    Texts of up to IN_ROW symbols are repaired in their rows, dealt over tasks by cost; so none of their tokens is shuffled. Longer ones go in rounds.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    solved = assembly_of_strings(strings.where(n <= IN_ROW), "text", StringOptions(algorithm="repair", accept_reversed=accept_reversed))
    out = solved.select("id", F.col("assembly_index").alias("upper_bound"), "rule_count", "remaining_fragments")
    long = strings.where(n > IN_ROW)
    return out if long.isEmpty() else out.unionByName(bounds_in_rounds(long, accept_reversed))


def bounds_in_rounds(strings: DataFrame, accept_reversed: bool = False) -> DataFrame:
    """repair_bounds() of texts of any size, by repaired()."""
    tokens, rules = repaired(strings, accept_reversed)
    left = tokens.groupBy("id").agg(F.count("*").alias("_left"))
    built = rules.groupBy("id").agg(F.count("*").alias("_rules"))
    out = strings.join(left, "id", "left").join(built, "id", "left")
    rule, rest = F.coalesce("_rules", F.lit(0)), F.coalesce("_left", F.lit(0))
    there = lambda c, name: F.when(F.col("text").isNotNull(), c).cast("int").alias(name)
    return out.select("id", there(rule + rest - 1, "upper_bound"), there(rule, "rule_count"), there(rest, "remaining_fragments"))
