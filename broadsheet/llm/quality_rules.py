"""Rule bitmask ledger: every rule is evaluated once and stored as a bit beside its measurements; policies are masks.

``ledger`` adds the measurements and ``fail_bits`` (bit k is set when rule k fails).  ``apply_policy`` reads only the bits,
so another version of a policy costs a scan of the ledger, not of the texts.  ``ablation`` counts, by bitwise aggregation
over the ledger, what each rule removes in all and what it alone removes.

Everything is a DataFrame expression: no rows move except the single row of counts of ``ablation``.

Defined results: a null text has no words and no lines; it fails ``few_words``.  An empty text likewise.  Repeated rows
are judged each for itself.  An empty table gives an empty ledger.  Other columns pass through; an input column that has
the name of a measurement is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals"]

#: name -> condition of failure over the measurements, in whole numbers; the position is the bit
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "5 * n_bangs > n_words",
    "capitals": "100 * n_capitals > 60 * word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
#: policies by version: the rules that reject a document
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "shouting"],
    "v2": list(RULES),
}


def mask(policy: str, without: str | None = None) -> int:
    """The bits of a policy, one rule left out on request."""
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy] and rule != without)


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated_starts(windows: Column) -> Column:
    """Positions of the windows that have an equal neighbour in the sorted array."""
    def hit(x: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.get(windows, k)["g"] == x["g"], F.lit(False))
        return same(j - 1) | same(j + 1)

    return F.transform(F.filter(windows, hit), lambda x: x["i"])


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every measurement; texts are read once."""
    keep = [c for c in df.columns if c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"))
    w, n = F.col("_words"), F.size("_words")
    starts = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.expr("array(0)"))
    grams = F.transform(
        starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))
    )
    rows = rows.select(*keep, n.cast("long").alias("n_words"), F.sort_array(grams).alias("_grams"))
    rows = rows.select(*keep, "n_words", _repeated_starts(F.col("_grams")).alias("_starts"))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    covered = F.array_distinct(F.flatten(F.transform(F.col("_starts"), lambda i: F.array(i, i + 1, i + 2))))
    rows = rows.select(
        *keep,
        "n_words",
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        _count_of(body, SYMBOLS).alias("n_symbols"),
        lines.alias("_lines"),
        F.size(covered).cast("long").alias("n_repeat_words"),
        _count_of(body, "!").alias("n_bangs"),
        _count_of(body, CAPITALS).alias("n_capitals"),
    )
    distinct = F.size(F.array_distinct("_lines"))
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", (F.size("_lines") - distinct).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.size("_lines").cast("long").alias("n_lines"), "n_bangs", "n_capitals",
    )


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and failure bits of every row."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, rule in enumerate(RULES.values()))
    return measure(df.drop("fail_bits"), text).withColumn("fail_bits", F.expr(bits))


def passes(policy: str) -> Column:
    """Whether none of the policy's rules failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with the policy's verdict in ``kept``."""
    return rows.withColumn("kept", passes(policy))


def keep_passing(df: DataFrame, policy: str) -> DataFrame:
    """The rows that the policy accepts, all their columns as they were."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col("text"))
    # the row number keeps the filter above the measurements; pushed below, it would repeat them once per mention
    judged = ledger(rows).withColumn("_n", F.monotonically_increasing_id())
    return judged.filter(passes(policy) & (F.col("_n") >= 0)).select("_row.*")


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows it fails, rows only it fails (kept if it were dropped), and the bits ever seen."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    counts = rows.groupBy(bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    per_rule = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("_n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("_bits") == (1 << k), F.col("_n"))), F.lit(0)).alias("n_only"),
        )
        for k, rule in enumerate(RULES)
        if rule in POLICIES[policy]
    ]
    seen = F.coalesce(F.bit_or("_bits"), F.lit(0)).alias("seen_bits")
    return counts.agg(F.array(*per_rule).alias("_rules"), seen).select(F.explode("_rules").alias("_r"), "seen_bits").select("_r.*", "seen_bits")


def verdicts(documents: DataFrame, policy: str = "v2") -> DataFrame:
    """The digest of op8: measurements, whether the base rules failed, and the verdict of the policy."""
    rows = apply_policy(ledger(documents.select("doc_id", "text")), policy)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
        "kept", "fail_bits",
    )


def sql(policy: str = "v2") -> str:
    """DuckDB SQL of ``verdicts``."""
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
    p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
    c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w),
    m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
                 length(text) - length(replace(text, '!', '')) AS n_bangs, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
          FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, {bits} AS fail_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base")} <> 0 AS base_failed,
           fail_bits & {mask(policy)} = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits FROM b"""
