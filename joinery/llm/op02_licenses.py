"""Query op2: base phrases and license detections in all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinery.llm.licenses import BASE, rules, scanned
from joinery.runtime import table

NAME = "op2_licenses"
PHRASE = f"(?<= )(?:{'|'.join(BASE)})(?= )"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents"))
    line = F.col("line")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    rows = rows.withColumn("places", F.when(line.isNotNull(), F.regexp_extract_all(line, F.lit(PHRASE), F.lit(0))))
    rows = rows.withColumn("pieces", F.when(F.size("places") > 0, F.split(line, PHRASE)))
    first, last = F.col("pieces")[0], F.element_at("pieces", -1)
    # what follows the last place begins with a space, so it has one space more than words
    behind = spaces(last) - 1 + F.size(F.split(F.element_at("places", -1), " "))
    base = F.transform(F.coalesce(F.array_distinct("places"), F.array().cast("array<string>")), lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), p))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    weight = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("places").isNotNull(), F.size("places")).otherwise(0).cast("long").alias("n_base"),
        (spaces(first) - 1).cast("long").alias("first_word"),
        (F.col("n_words") - behind).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        weight.alias("score"),
    )


def _doubled(pattern: str) -> str:
    """The pattern for a line with two spaces between words, so that each match has spaces of its own and needs no look-around."""
    return f" (?:{pattern.replace(' ?', '(?: )?').replace(' ', '  ')}) "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ",\n    ".join(f"({r['number']}, {_quoted(r['label'])}, {r['priority']}, {r['weight']}::DOUBLE, [{', '.join(_quoted(k.replace(' ', '  ')) for k in r['keyword'].split('|'))}], {_quoted(_doubled(r['pattern']))})" for r in rules())
_BASE = _quoted(_doubled("|".join(BASE)))
_LABEL = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in BASE.items())
_COUNT = "len(list_filter(string_split({}, ' '), lambda x: x <> ''))"

SQL = rf"""
WITH rules(number, label, priority, weight, keywords, pattern) AS (VALUES
    {_RULES}
), lines AS (
    SELECT rid, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS line
    FROM (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)
), found AS (
    SELECT rid, number, label, priority, weight, string_split_regex(line, pattern) AS p, regexp_extract_all(line, pattern) AS h
    FROM lines JOIN rules ON len(list_filter(keywords, lambda k: contains(line, k))) > 0 WHERE regexp_matches(line, pattern)
), places AS (
    SELECT rid, number, label, priority, weight,
        list_sum(list_transform(p[1:i], lambda s: {_COUNT.format("s")})) + coalesce(list_sum(list_transform(h[1:i - 1], lambda s: {_COUNT.format("s")})), 0) AS start, {_COUNT.format("h[i]")} AS size
    FROM found, unnest(range(1, len(h) + 1)) t(i)
), kept AS (
    SELECT rid, list(label) AS labels, max(weight) AS weight FROM places b WHERE NOT EXISTS (
        SELECT 1 FROM places a WHERE a.rid = b.rid AND a.start <= b.start AND a.start + a.size >= b.start + b.size
            AND (a.priority > b.priority OR (a.priority = b.priority AND (a.size > b.size OR (a.size = b.size AND a.number < b.number)))))
    GROUP BY rid
), based AS (
    SELECT rid, doc_id, n_words, string_split_regex(line, {_BASE}) AS p, list_transform(regexp_extract_all(line, {_BASE}), lambda s: replace(trim(s), '  ', ' ')) AS h FROM lines
)
SELECT doc_id, n_words, len(h) AS n_base, CASE WHEN len(h) > 0 THEN {_COUNT.format("p[1]")} END AS first_word,
    CASE WHEN len(h) > 0 THEN n_words - {_COUNT.format("p[-1]")} - {_COUNT.format("h[-1]")} END AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(h, lambda s: CASE s {_LABEL} END))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_transform(h, lambda s: CASE s {_LABEL} END) || coalesce(labels, []))), ',') AS labels,
    greatest(coalesce(weight, 0), CASE WHEN len(h) > 0 THEN 1 ELSE 0 END) AS score
FROM based LEFT JOIN kept USING (rid)
"""
