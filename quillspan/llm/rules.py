"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

A text has counts (words, symbols, repeated lines, words in repeated windows) and, made of them, a signal for each rule:
a whole number that is higher for worse texts. A rule rejects a text whose signal reaches its cutoff. Cutoffs are chosen
in each stratum from labelled texts, of which equal ones count once, in two halves told apart by a digest of the text:

* Clean texts of the first half order the candidates. The first levels put each rule's cutoff well above the greatest
  signal of a clean text; from then on, for l from 0 to BUDGETS, a level gives each rule the lowest cutoff that rejects no
  more than its part of l/BUDGETS of the allowed share. So levels are nested, from the laxest to the strictest.
* Clean texts of the second half, the holdout, test them: of n texts level l rejects k. P(Bin(n, share) <= k), the exact
  binomial tail, is the chance to see so few if the level's false rejections were above the share. Levels are tested in
  their order up to the first that fails, so a stratum needs no correction for its levels; over strata the error is
  divided by their number (Bonferroni). With a chance of 1 - error, no chosen level of any stratum rejects more than the
  share of clean texts.
* Of the levels that pass, the one is taken that parts labelled junk from the holdout best; of equal ones the laxest.
  Where none passes, the stratum's rules reject nothing.

Strata with few clean holdout texts are pooled into one. Nothing is sampled: all labelled rows take part in histograms
that tasks pre-aggregate, and cutoffs go to rows by a join that keeps the rows of frequent strata where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.llm.shared import joined_spread, written

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SYMBOLS = "[#*$%&|<>]"
CAPITAL = r"\p{Lu}"
MARK = rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}]"
WINDOW = 5
RULES = ("symbols", "marks", "capitals", "repeats", "lines", "long", "short")
TOP = 1000  # greatest signal
MARGINS = ((4, 5), (3, 2))  # the first levels' cutoffs: halves of the greatest clean signal, and what is added
BUDGETS = 8
LEVELS = len(MARGINS) + BUDGETS + 1
SHARE = 30  # false rejections allowed, in a thousand clean texts
ERROR = 0.05  # chance that the allowed share is passed in any stratum
LEAST = 200  # clean holdout texts of a stratum of its own
POOL = "*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(hashes: Column) -> Column:
    """How many words stand in windows of WINDOW words that occur twice or more; hashes holds a hash of each word.

    Windows are told apart by 64-bit hashes. They are sorted with their places, so a text of n words costs n log n.
    """
    window = lambda i: F.struct(F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))).alias("h"), i.alias("i"))
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window))

    def covered(s: Column) -> Column:
        hash_at = lambda j: F.get(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (hash_at(j) == hash_at(j - 1)) | (hash_at(j) == hash_at(j + 1)))
        places = F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return F.when(F.size(hashes) >= WINDOW, let(ordered, covered)).otherwise(F.lit(0))


def counted(text: Column) -> Column:
    """A struct of a text's counts, as longs; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    of_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words).alias("n_repeat_words"),
        ),
    )
    marks = F.struct(*(F.regexp_count(text, F.lit(p)).alias(n) for n, p in (("n_symbols", SYMBOLS), ("n_capitals", CAPITAL), ("n_marks", MARK))))
    parts = F.struct(of_words.alias("w"), of_lines.alias("l"), marks.alias("m"))
    places = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_symbols": "m", "n_capitals": "m", "n_marks": "m"}
    return let(parts, lambda x: F.struct(*(x[p][n].cast("long").alias(n) for n, p in places.items())))


def base_failed(c: Column) -> Column:
    """Too short, or too much of it repeated."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def signals(c: Column) -> Column:
    """The rules' signals, in the order of RULES: whole numbers from 0 to TOP."""
    per = lambda scale, n, of: F.least(F.floor(F.try_divide(scale * c[n], c[of])), F.lit(TOP))
    found = (per(100, "n_symbols", "n_words"), per(100, "n_marks", "n_words"), per(100, "n_capitals", "word_chars"), per(100, "n_repeat_words", "n_words"),
             per(100, "n_dup_lines", "n_lines"), per(10, "word_chars", "n_words"), per(1000, "n_words", "word_chars"))
    return F.array(*(F.coalesce(x, F.lit(0)).cast("int") for x in found))


def log_factorial(n: Column) -> Column:
    """ln n!, from the factorial where it is a long, else by Stirling's series, whose error is below a double's there."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term; 1 where k is the mean or more.

    Terms more than 40 roots of n below k are left out: together they are under exp(-3200), which a double doesn't hold.
    """
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.log(F.lit(p)) + (n - i) * F.log1p(F.lit(-p)))
    first = F.greatest(F.lit(0).cast("long"), k - 40 * F.ceil(F.sqrt(n)))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(first, k), F.lit(0.0), lambda a, i: a + term(i)))


def measured(docs: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """(id, counts, signals, base_failed, stratum, digest) of each row; nothing of the text is kept."""
    one = docs.select(F.col(id_col).alias("id"), counted(F.col(text_col)).alias("c"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"))
    return one.select("id", "c", signals(F.col("c")).alias("signals"), base_failed(F.col("c")).alias("base_failed"), "stratum", "digest")


def observed(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(stratum, signals, clean, holdout): labelled texts that pass the base rules, equal ones of a stratum once.

    Of several labels the greatest counts, for a document as for equal texts.
    """
    told = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).alias("clean"))
    met = rows.where("not base_failed").select("id", "stratum", "digest", "signals").join(told, "id")
    once = met.groupBy("stratum", "digest").agg(F.max("clean").alias("clean"), F.first("signals").alias("signals"))
    return once.select("stratum", "signals", "clean", (F.substr("digest", F.lit(1), F.lit(1)) >= "8").alias("holdout"))


def _paths(seen: DataFrame, share: int) -> DataFrame:
    """(pool, cuts): of each rule an array of its cutoffs, a cutoff a level."""
    one = seen.where("clean and not holdout").select("pool", F.posexplode("signals").alias("rule", "value"))
    counts = one.groupBy("pool", "rule", "value").agg(F.count("*").alias("n"))  # TOP + 1 rows a rule and pool at most
    along = W.partitionBy("pool", "rule")
    counts = counts.withColumns({"above": F.sum("n").over(along.orderBy(F.desc("value"))), "all": F.sum("n").over(along)})
    allowed = lambda part: F.floor(F.col("all") * (share * part) / (1000 * BUDGETS * len(RULES)))
    wide = [(F.floor(F.max("value") * halves / 2) + more + 1).cast("int") for halves, more in MARGINS]
    cut = F.array(*wide, *(F.max(F.when(F.col("above") > allowed(part), F.col("value"))) + 1 for part in range(BUDGETS + 1)))
    cuts = counts.groupBy("pool", "rule").agg(cut.alias("cut"))
    return cuts.groupBy("pool").agg(F.array_sort(F.collect_list(F.struct("rule", "cut"))).alias("cuts")).select("pool", F.col("cuts.cut").alias("cuts"))


def _reached(cuts: Column, marks: Column, level: Column) -> Column:
    """Whether a signal reaches its rule's cutoff of a level."""
    return F.exists(F.arrays_zip(cuts.alias("cut"), marks.alias("mark")), lambda x: x["mark"] >= F.get(x["cut"], level))


def chosen_cutoffs(observations: DataFrame, share: int = SHARE, error: float = ERROR, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(pools, levels): the pool of each observed stratum, and each pool's chosen level.

    pools: stratum, pool, n. levels: pool, cutoffs (by rule; null where no level passes), level, n_clean (holdout texts),
    n_rejected (of them), p_value, certified (levels that passed).
    """
    is_held = F.col("clean") & F.col("holdout")
    pools = observations.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(is_held).alias("held"))
    pools = written(pools.select("stratum", F.when(F.col("held") >= least, F.concat(F.lit("="), "stratum")).otherwise(F.lit(POOL)).alias("pool"), "n"), "pools")
    total = pools.agg(F.sum("n")).first()[0] or 0  # one number
    seen = written(joined_spread(observations, pools, ["stratum"], total).drop("stratum"), "observations")
    # A pool whose texts are all of the holdout has no cutoffs, and rejects nothing.
    paths = pools.groupBy("pool").agg(F.sum("n").alias("n")).join(_paths(seen, share), "pool", "left")
    met = joined_spread(seen, paths, ["pool"], total)
    hit = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda x: _reached(F.col("cuts"), F.col("signals"), x))), F.lit(LEVELS))
    met = met.select("pool", "clean", "holdout", "cuts", hit.alias("hit"))
    by_level = lambda which: F.array(*(F.count_if(which & (F.col("hit") <= level)) for level in range(LEVELS)))
    met = met.groupBy("pool").agg(
        F.first("cuts", ignorenulls=True).alias("cuts"), F.count_if(is_held).alias("n_clean"), F.count_if(~F.col("clean")).alias("n_junk"),
        by_level(is_held).alias("wrong"), by_level(~F.col("clean")).alias("right"),
    )
    met = written(met, "levels")
    strata = met.count()
    tails = F.transform("wrong", lambda k: binomial_tail(k, F.col("n_clean"), share / 1000))
    one = met.withColumn("p", tails)
    failed = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda x: F.get("p", x) > error / max(strata, 1)))
    one = one.withColumn("certified", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.coalesce(failed, F.lit(LEVELS))))
    # The gain in whole numbers: junk rejected x clean texts - clean rejected x junk texts. Of equal gains the least level.
    gain = lambda x: F.struct((F.get("right", x) * F.col("n_clean") - F.get("wrong", x) * F.col("n_junk")).alias("gain"), (-x).alias("level"))
    best = F.when(F.col("certified") > 0, -F.array_max(F.transform(F.sequence(F.lit(0), F.col("certified") - 1), gain))["level"])
    one = one.withColumn("level", best)
    cutoffs = F.when(F.col("level").isNotNull(), F.transform("cuts", lambda c: F.get(c, F.col("level"))))
    return pools, one.select("pool", cutoffs.alias("cutoffs"), "level", "n_clean", F.get("wrong", "level").alias("n_rejected"), F.get("p", "level").alias("p_value"), "certified")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None, label_col: str = "quality", share: int = SHARE, error: float = ERROR, least: int = LEAST) -> DataFrame:
    """A row for each of docs: id_col, COUNTS, base_failed, kept, failed (names of the rules that reject it), stratum.

    docs needs id_col, text_col and what `stratum` names (the column lang, if none is given); other columns, whatever
    their names, are not read. labels has id_col and label_col, above 0 for clean texts; null labels and ids without a
    text tell nothing. Null and empty texts have no words and fail the base rules; a null stratum is one of its own;
    strata without labels are judged by the pool's cutoffs; rows of one id or text are rows of their own, and repeated
    rows fare alike. Without labels only the base rules reject. Texts are counted whole, in one row each. An empty table
    stays empty.
    """
    rows = written(measured(docs, id_col, text_col, F.col("lang") if stratum is None else stratum), "signals")
    pools, levels = chosen_cutoffs(written(observed(rows, labels, id_col, label_col), "labelled"), share, error, least)
    strata = rows.groupBy("stratum").agg(F.count("*").alias("n")).join(pools.drop("n"), "stratum", "left")
    strata = strata.withColumn("pool", F.coalesce("pool", F.lit(POOL))).join(levels.select("pool", "cutoffs"), "pool", "left")
    strata = written(strata.select("stratum", "cutoffs", "n"), "cutoffs")
    total = strata.agg(F.sum("n")).first()[0] or 0  # one number
    found = joined_spread(rows, strata, ["stratum"], total)
    names = F.array(*(F.lit(r) for r in RULES))
    failed = F.filter(names, lambda name, i: F.coalesce(F.get("signals", i) >= F.get("cutoffs", i), F.lit(False)))
    found = found.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return found.select(F.col("id").alias(id_col), *(F.col(f"c.{n}").alias(n) for n in COUNTS), "base_failed", kept.alias("kept"), "failed", "stratum")


def rules_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document, with the registered settings."""
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept")


def rules_sql(share: int = SHARE, error: float = ERROR, least: int = LEAST) -> str:
    """The report's rows in DuckDB SQL."""
    rules, first = len(RULES), len(MARGINS)
    wide = " UNION ALL ".join(f"SELECT pool, rule, {i} AS level, (max(v) * {halves}) // 2 + {more + 1} AS cut FROM summed GROUP BY pool, rule" for i, (halves, more) in enumerate(MARGINS))
    return rf"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS stratum, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs),
windows AS (SELECT r, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS g FROM tokens WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS d FROM windows),
covered AS (SELECT r, i, max(d) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS d FROM twice),
repeats AS MATERIALIZED (SELECT r, count(*) FILTER (d) AS n_repeat_words FROM covered GROUP BY r),
counts AS MATERIALIZED (
    SELECT docs.r, doc_id, stratum, md5(t) AS digest, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
        len(regexp_extract_all(t, '{CAPITAL}')) AS n_capitals, len(regexp_extract_all(t, '{MARK}')) AS n_marks, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) AS n_lines,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')))) AS n_dup_lines
    FROM docs LEFT JOIN repeats USING (r)),
measured AS MATERIALIZED (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN [(100 * n_symbols) // n_words, (100 * n_marks) // n_words, (100 * n_capitals) // word_chars, (100 * n_repeat_words) // n_words, (100 * n_dup_lines) // n_lines, (10 * word_chars) // n_words, (1000 * n_words) // word_chars] END AS raw
    FROM counts),
rows AS MATERIALIZED (SELECT *, list_transform(raw, lambda x: least(x, {TOP})) AS signals FROM measured),
told AS (SELECT doc_id, max(quality) > 0 AS clean FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
observed AS MATERIALIZED (
    SELECT stratum, digest, max(clean) AS clean, any_value(signals) AS signals, substr(digest, 1, 1) >= '8' AS holdout
    FROM rows JOIN told USING (doc_id) WHERE NOT base_failed GROUP BY stratum, digest),
pools AS MATERIALIZED (SELECT stratum, CASE WHEN count(*) FILTER (clean AND holdout) >= {least} THEN '=' || stratum ELSE '{POOL}' END AS pool FROM observed GROUP BY stratum),
seen AS MATERIALIZED (SELECT pool, clean, holdout, signals FROM observed JOIN pools USING (stratum)),
valued AS (SELECT pool, unnest(signals) AS v, unnest(range({rules})) AS rule FROM seen WHERE clean AND NOT holdout),
summed AS (SELECT pool, rule, v, sum(count(*)) OVER (PARTITION BY pool, rule ORDER BY v DESC) AS above, sum(count(*)) OVER (PARTITION BY pool, rule) AS n FROM valued GROUP BY pool, rule, v),
cuts AS MATERIALIZED (
    SELECT pool, rule, part + {first} AS level, max(v) + 1 AS cut FROM summed, range({BUDGETS + 1}) AS l(part) WHERE above > (n * {share} * part) // {1000 * BUDGETS * rules} GROUP BY pool, rule, part
    UNION ALL {wide}),
hits AS (SELECT pool, clean, holdout, level, (SELECT bool_or(signals[rule + 1] >= cut) FROM cuts WHERE cuts.pool = seen.pool AND cuts.level = l.level) AS hit FROM seen, range({LEVELS}) AS l(level)),
tested AS MATERIALIZED (
    SELECT pool, level, count(*) FILTER (clean AND holdout) AS n, count(*) FILTER (clean AND holdout AND hit) AS k, count(*) FILTER (NOT clean) AS j, count(*) FILTER (NOT clean AND hit) AS caught
    FROM hits GROUP BY pool, level),
valued_p AS MATERIALIZED (
    SELECT *, CASE WHEN k >= n * {share / 1000} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({share / 1000}) + (n - i) * ln(1 - {share / 1000})))) END AS p
    FROM tested WHERE n > 0),
failing AS (SELECT pool, min(level) AS level FROM valued_p WHERE p > {error} / (SELECT count(DISTINCT pool) FROM tested) GROUP BY pool),
best AS (
    SELECT v.pool, max_by(v.level, [caught * n - k * j, -v.level]) AS level FROM valued_p AS v LEFT JOIN failing AS f ON v.pool = f.pool
    WHERE v.level < coalesce(f.level, {LEVELS}) AND v.pool IN (SELECT pool FROM cuts) GROUP BY v.pool),
final AS MATERIALIZED (SELECT pool, rule, cut FROM cuts JOIN best USING (pool, level)),
judged AS (
    SELECT r, bool_or(signals[rule + 1] >= cut) AS hit
    FROM (SELECT r, signals, coalesce(pool, '{POOL}') AS pool FROM rows LEFT JOIN pools USING (stratum)) JOIN final USING (pool) GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, NOT base_failed AND NOT coalesce(hit, FALSE) AS kept
FROM rows LEFT JOIN judged USING (r)
"""


RULES_SQL = rules_sql()
