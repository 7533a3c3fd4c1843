"""Quality by weak supervision: rules vote, expectation-maximisation weighs them (operator 3). DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The model: a document is good with a prior probability; a rule
that votes has one accuracy on good documents and one on bad ones (most rules pass most bad documents, so one number for both
would let five passes outvote a clear failure). Each kind of junk has two rules: one bad vote can be outvoted, how far follows from the
accuracies found, two seldom. Votes are counted by pattern first (at most 3 ** rules rows, whatever the corpus),
so each of the ROUNDS of expectation-maximisation is one aggregate over that small table. A document is kept if it passes the
base conditions and its posterior probability of being good is at least a half.

A null or empty text has no words, fails the base and is not kept. Documents on which all rules abstain have the prior as posterior.
Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editwarden.llm.frames import ready, stored, words

ROUNDS = 15
PRIOR, ON_GOOD, ON_BAD = 0.5, 0.98, 0.2  # where the rounds begin
# bounds for the logarithms only: what a rule is worth is estimated
PRIOR_RANGE, GOOD_RANGE, BAD_RANGE = (0.05, 0.95), (0.5, 0.999), (0.05, 0.95)
SMOOTH = 1.0
# name: (good if, bad if), over the counts below; whole numbers, so that no rounding decides
RULES = {
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    "lines": ("20 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    "repeats": ("50 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "length": ("n_words >= 50", "n_words < 10"),
    "shouting": ("100 * n_shouts <= n_words", "5 * n_shouts > n_words"),
    # a second view on each kind of junk, so that junk fails two rules where a good document may fail one
    "symbol_chars": ("500 * n_symbols <= word_chars", "40 * n_symbols > word_chars"),
    "long_words": ("word_chars BETWEEN 2 * n_words AND 11 * n_words", "word_chars < 2 * n_words OR 2 * word_chars > 23 * n_words"),
    "same_lines": ("n_dup_lines = 0", "5 * n_dup_lines > 2 * n_lines"),
    "same_words": ("n_repeat_words = 0", "10 * n_repeat_words > 3 * n_words"),
    "short": ("n_words >= 40", "n_words < 15"),
    "shouts": ("50 * n_shouts <= n_words", "10 * n_shouts > n_words"),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
WINDOW = 5


def repeated_words(hashes: Column, positions: Column) -> Column:
    """Words in the windows at ``positions`` (ordered, from 1)."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct(
        (s["words"] + p + WINDOW - F.greatest(p, s["end"])).alias("words"), (p + WINDOW).alias("end"))
    return F.aggregate(positions, start, step, lambda s: s["words"])


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts), all whole numbers."""
    ready(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "doc_id", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.size(F.regexp_extract_all("text", F.lit("[#*$%&|<>]"), F.lit(0))).alias("n_symbols"),
        F.size(F.regexp_extract_all("text", F.lit("!"), F.lit(0))).alias("n_shouts"),
        lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    window = F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    rows = rows.select(
        "doc_id", "n", "word_chars", "n_symbols", "n_shouts", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.when(F.col("n") >= WINDOW, window).alias("v"))
    # most texts repeat nothing: only the others order their windows
    repeats = F.size(F.array_distinct("v")) < F.size("v")
    rows = rows.withColumn("s", F.when(repeats, F.sort_array(F.transform("v", lambda v, i: F.struct(v.alias("v"), (i + 1).alias("i"))))))
    met = F.filter("s", lambda x, k: (x["v"] == F.get("s", k - 1)["v"]) | (x["v"] == F.get("s", k + 1)["v"]))
    rows = rows.withColumn("p", F.sort_array(F.transform(met, lambda x: x["i"])))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(repeated_words(F.col("s"), F.col("p")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("n_lines").cast("long").alias("n_lines"), F.col("n_shouts").cast("long").alias("n_shouts"))


def votes(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"vote_{name}": F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for name, (good, bad) in RULES.items()})


def _posterior(prior: float, accuracies: dict[str, tuple[float, float]]) -> Column:
    odds = F.log(F.lit(prior / (1 - prior)))
    for name, (on_good, on_bad) in accuracies.items():
        vote = F.col(f"vote_{name}")
        odds = odds + F.when(vote == 1, F.log(F.lit(on_good / (1 - on_bad)))).when(vote == -1, F.log(F.lit((1 - on_good) / on_bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _within(value: float, bounds) -> float:
    return min(max(value, bounds[0]), bounds[1])


def learn_rules(voted: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """(prior, accuracies of each rule on good and on bad documents) by expectation-maximisation over the vote patterns."""
    names = [f"vote_{name}" for name in RULES]
    patterns = stored(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    prior, accuracies = PRIOR, dict.fromkeys(RULES, (ON_GOOD, ON_BAD))
    for _ in range(ROUNDS):
        rows = patterns.withColumn("q", F.col("n") * _posterior(prior, accuracies))
        sums = [F.sum("n").alias("all"), F.sum("q").alias("good")]
        for name in RULES:
            vote = F.col(f"vote_{name}")
            # how many good and bad documents it voted on, and on how many of them rightly
            sums += [F.sum(F.when(vote != 0, F.col("q")).otherwise(0.0)).alias(f"good_{name}"), F.sum(F.when(vote == 1, F.col("q")).otherwise(0.0)).alias(f"pass_{name}"),
                     F.sum(F.when(vote != 0, F.col("n") - F.col("q")).otherwise(0.0)).alias(f"bad_{name}"),
                     F.sum(F.when(vote == -1, F.col("n") - F.col("q")).otherwise(0.0)).alias(f"catch_{name}")]
        got = rows.agg(*sums).first()
        if not got["all"]:
            break
        share = lambda part, whole, bounds: _within((got[part] + SMOOTH) / (got[whole] + 2 * SMOOTH), bounds)
        prior = share("good", "all", PRIOR_RANGE)
        accuracies = {name: (share(f"pass_{name}", f"good_{name}", GOOD_RANGE), share(f"catch_{name}", f"bad_{name}", BAD_RANGE)) for name in RULES}
    return prior, accuracies


def judged(docs: DataFrame) -> DataFrame:
    """The counts, the votes, base_failed, the posterior ``p_good`` and ``kept`` for each document."""
    voted = votes(stored(base_counts(docs), "counts"))
    out = voted.withColumn("p_good", _posterior(*learn_rules(voted))).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def judged_sql() -> str:
    """The same in SQL: the rounds are written out, one small table each."""
    def within(value, bounds):
        return f"least(greatest({value}, {bounds[0]}::DOUBLE), {bounds[1]}::DOUBLE)"

    odds = "ln(t.prior / (1 - t.prior))" + "".join(
        f" + CASE vote_{n} WHEN 1 THEN ln(t.g_{n} / (1 - t.b_{n})) WHEN -1 THEN ln((1 - t.g_{n}) / t.b_{n}) ELSE 0 END" for n in RULES)

    def share(part, whole, bounds):
        return within(f"(sum({part}) + {SMOOTH}) / (sum({whole}) + 2 * {SMOOTH})", bounds)

    learnt = ", ".join(
        share(f"CASE WHEN vote_{n} = 1 THEN q ELSE 0 END", f"CASE WHEN vote_{n} <> 0 THEN q ELSE 0 END", GOOD_RANGE) + f" AS g_{n}, "
        + share(f"CASE WHEN vote_{n} = -1 THEN n - q ELSE 0 END", f"CASE WHEN vote_{n} <> 0 THEN n - q ELSE 0 END", BAD_RANGE) + f" AS b_{n}" for n in RULES)
    rounds = ", ".join(
        f"t{k + 1} AS MATERIALIZED (SELECT {share('q', 'n', PRIOR_RANGE)} AS prior, {learnt} "
        f"FROM (SELECT p.*, n / (1 + exp(-({odds}))) AS q FROM patterns p, t{k} t))" for k in range(ROUNDS))
    begin = ", ".join(f"{ON_GOOD}::DOUBLE AS g_{n}, {ON_BAD}::DOUBLE AS b_{n}" for n in RULES)
    voted = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS vote_{n}" for n, (good, bad) in RULES.items())
    names = ", ".join(f"vote_{n}" for n in RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, hash_of FROM (SELECT doc_id, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
  LATERAL (SELECT array_to_string(w[i:i + {WINDOW - 1}], ' ') AS hash_of)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash_of) AS c FROM g) WHERE c > 1),
s AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
counts AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(s.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts FROM w LEFT JOIN s USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {voted} FROM counts),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM voted GROUP BY ALL),
t0 AS (SELECT {PRIOR}::DOUBLE AS prior, {begin}), {rounds}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept
FROM (SELECT v.*, ({BASE_FAILED}) AS base_failed, 1 / (1 + exp(-({odds}))) AS q FROM voted v, t{ROUNDS} t)"""
