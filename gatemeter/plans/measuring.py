"""Queries: bounds, lanes, concentration, quantiles, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gatemeter.functions import stats
from gatemeter.operators import admission, measure
from gatemeter.plans.matching import LABELS, ORACLES as MATCH, matched, rule_stratum_hits
from gatemeter.plans.rulebook import IDS, RUNNABLE, quote, sql_findings, sql_predicate
from gatemeter.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


_hits = f"SELECT * FROM ({MATCH['rule_stratum_hits']})"
#: the exact bound in SQL: bisection on the CDF, summed term by term
_exact = """CASE WHEN trials <= 0 OR hits >= trials THEN 1.0::DOUBLE ELSE list_reduce(
  list_prepend({'lo': (hits / trials)::DOUBLE, 'hi': 1.0::DOUBLE}, list_transform(range(60), lambda i: {'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE})),
  lambda s, _: CASE WHEN list_sum(list_transform(range(hits + 1), lambda j: exp(lgamma(trials + 1) - lgamma(j + 1) - lgamma(trials - j + 1) + j * ln((s.lo + s.hi) / 2) + (trials - j) * ln(1 - (s.lo + s.hi) / 2)))) > 0.05
    THEN {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} ELSE {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} END).hi END"""


@query("u95_zero_hits", f"SELECT rule_id, stratum, trials, round(CASE WHEN trials > 0 THEN 1 - power(0.05, 1.0 / trials) ELSE 1.0 END, 9) AS u95 FROM ({_hits}) WHERE hits = 0")
def u95_zero_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of rules without hits, in closed form."""
    return rule_stratum_hits(spark, sf_dir).where("hits = 0").select("rule_id", "stratum", "trials", F.round(stats.u95_zero(F.col("trials")), 9).alias("u95"))


@query("u95_exact", f"SELECT rule_id, stratum, trials, hits, round({_exact}, 6) AS u95 FROM ({_hits})")
def u95_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact bound of every (rule, stratum)."""
    return measure.with_bounds(rule_stratum_hits(spark, sf_dir)).withColumn("u95", F.round("u95", 6))


_grid = "(VALUES (10, 1), (20, 9), (100, 3), (842, 497), (1743, 1), (3000, 0), (5, 5), (0, 0)) AS v(trials, hits)"


@query("u95_native", f"SELECT trials::BIGINT AS trials, hits::BIGINT AS hits, round({_exact}, 6) AS u95 FROM {_grid}")
def u95_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact bound by higher-order functions alone."""
    rows = spark.sql(f"SELECT CAST(trials AS BIGINT) trials, CAST(hits AS BIGINT) hits FROM {_grid.replace('AS v', 'AS v')}")
    return rows.withColumn("u95", F.round(stats.log_gamma_free_u95(F.col("trials"), F.col("hits"), 50), 6))


@query("bound_within", """SELECT trials::BIGINT AS trials, CASE WHEN trials = 0 THEN false ELSE trials >= ln(0.05) / ln(1 - 0.005) END AS advise, CASE WHEN trials = 0 THEN false ELSE trials >= ln(0.05) / ln(1 - 0.001) END AS deny
FROM (VALUES (0), (100), (597), (598), (2994), (2995)) AS v(trials)""")
def bound_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which counts without hits are within the ceilings."""
    rows = spark.sql("SELECT CAST(trials AS BIGINT) trials, 0L AS hits FROM VALUES (0), (100), (597), (598), (2994), (2995) AS v(trials)")
    return rows.select("trials", stats.bound_within(stats.ADVISE)("trials", "hits").alias("advise"), stats.bound_within(stats.DENY)("trials", "hits").alias("deny"))


@query("trials_needed", "SELECT t, ceil(ln(0.05) / ln(1 - t))::BIGINT AS trials FROM (VALUES (0.005::DOUBLE), (0.001::DOUBLE), (0.05::DOUBLE), (0.01::DOUBLE)) AS v(t)")
def trials_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT CAST(t AS DOUBLE) t FROM VALUES (0.005), (0.001), (0.05), (0.01) AS v(t)")
    return rows.select("t", stats.trials_needed(F.col("t")).alias("trials"))


_bounded = f"SELECT *, {_exact} AS u95 FROM ({_hits})"
_worst_sql = f"SELECT rule_id, stratum, trials, hits, u95 FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY round(u95, 9) DESC, stratum) AS k FROM ({_bounded})) WHERE k = 1"


@query("worst_stratum", f"SELECT rule_id, stratum, trials, hits, round(u95, 6) AS u95 FROM ({_worst_sql})")
def worst_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule the stratum of the largest bound."""
    rows = measure.with_bounds(rule_stratum_hits(spark, sf_dir)).withColumn("u95", F.round("u95", 9))
    return measure.worst(rows, ["rule_id"]).withColumn("u95", F.round("u95", 6))


@query("lane_per_rule", f"""SELECT rule_id, CASE WHEN u95 > 0.005 THEN 'RECORD' WHEN u95 <= 0.001 THEN 'DENY' ELSE 'ADVISE' END AS lane FROM
(SELECT rule_id, {_exact} AS u95 FROM (SELECT r.rule_id, (SELECT count(*) FROM documents) AS trials, count(f.doc_id) AS hits FROM (SELECT unnest([{", ".join(map(quote, IDS))}]) AS rule_id) r LEFT JOIN ({sql_findings()}) f USING (rule_id) GROUP BY 1))""")
def lane_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane of each rule by its bound over the whole corpus."""
    rows = measure.rule_hits(matched(spark, sf_dir), list(IDS), {})
    return measure.lanes(rows, True).select("rule_id", "lane")


_gate = f"""SELECT CASE WHEN (SELECT count(*) - count(DISTINCT sha256(text)) FROM documents) > 0 THEN 'duplicate material units' END AS duplicates,
(SELECT {_exact} > 0.005 FROM (SELECT count(*) AS trials, count(*) FILTER ({" OR ".join(sql_predicate(r) for r in RUNNABLE)}) AS hits FROM documents)) AS exceeds"""


@query("bundle_gate", f"SELECT duplicates, exceeds, duplicates IS NULL AND NOT exceeds AS ok FROM ({_gate})")
def bundle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bundle as a whole may act on this corpus."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg((F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("d"))
    union = measure.with_bounds(measure.bundle_hits(matched(spark, sf_dir), {}))
    one = union.crossJoin(n)  # one row each
    exceeds = ~F.coalesce(stats.bound_within(stats.ADVISE)("trials", "hits"), F.lit(False))
    return one.select(F.when(F.col("d") > 0, "duplicate material units").alias("duplicates"), exceeds.alias("exceeds")).withColumn("ok", F.col("duplicates").isNull() & ~F.col("exceeds"))


@query("duplicate_material", "SELECT lang, count(*) AS units, count(DISTINCT sha256(text)) AS distinct_units, count(*) - count(DISTINCT sha256(text)) AS duplicate_units FROM documents GROUP BY lang")
def duplicate_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.duplicates(table(spark, sf_dir, "documents"), ["lang"])


@query("dedup_occurrences", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS occurrences FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text once, by its first document, with its occurrences."""
    return measure.first_occurrences(table(spark, sf_dir, "documents").where("text IS NOT NULL"))


@query("salted_split", "SELECT doc_id, CAST(('0x' || substr(sha256('s1:' || sha256(text)), 1, 2))::INTEGER % 2 AS INTEGER) AS part FROM documents WHERE text IS NOT NULL")
def salted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", measure.salted_split(F.sha2("text", 256), "s1").alias("part"))


@query("salted_sample", "SELECT doc_id, sha256('s2:' || doc_id::VARCHAR) AS rank_digest FROM documents ORDER BY 2 LIMIT 50")
def salted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 that any machine draws alike."""
    return measure.salted_sample(table(spark, sf_dir, "documents").select("doc_id"), "s2", 50)


@query("missing_strata", "SELECT 'lang=' || r AS stratum FROM (VALUES ('en'), ('de'), ('xx'), ('yy')) AS v(r) WHERE r NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def missing_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required strata that no unit has."""
    wanted = spark.sql("SELECT * FROM VALUES ('lang=en'), ('lang=de'), ('lang=xx'), ('lang=yy') AS v(stratum)")
    return wanted.join(measure.trials(table(spark, sf_dir, "documents"), LABELS), "stratum", "left_anti")


@query("unmeasured_surfaces", "SELECT surface FROM (VALUES ('CFG'), ('IN'), ('OUT'), ('PROMPT'), ('PIN')) AS v(surface) EXCEPT SELECT DISTINCT CASE role WHEN 'user' THEN 'PROMPT' WHEN 'assistant' THEN 'OUT' ELSE 'CFG' END FROM conversations")
def unmeasured_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of which the traffic has no unit."""
    seen = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "PROMPT").when(F.col("role") == "assistant", "OUT").otherwise("CFG").alias("surface")).distinct()
    return spark.sql("SELECT * FROM VALUES ('CFG'), ('IN'), ('OUT'), ('PROMPT'), ('PIN') AS v(surface)").join(seen, "surface", "left_anti")


_total = f"SELECT rule_id, trials, hits FROM ({_hits}) WHERE stratum = 'all'"


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.rule_hits(matched(spark, sf_dir), list(IDS), {}).select("rule_id", "trials", "hits")


@query("loud_rules", f"SELECT rule_id, trials, hits, 20 * hits > trials AS over_five FROM ({_total}) WHERE 100 * hits > trials")
def loud_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on more than 1 % of units, and whether on more than 5 %."""
    return _all(spark, sf_dir).where("100 * hits > trials").withColumn("over_five", F.expr("20 * hits > trials"))


@query("quiet_rules", f"SELECT rule_id FROM ({_total}) WHERE hits = 0")
def quiet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("hits = 0").select("rule_id")


@query("top_rules", f"SELECT rule_id, hits FROM ({_total}) ORDER BY hits DESC, rule_id LIMIT 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("rule_id", "hits").orderBy(F.desc("hits"), "rule_id").limit(10)


@query("concentration", f"""SELECT rule_id, hits, row_number() OVER w AS rank, round(sum(hits) OVER w / nullif(sum(hits) OVER (), 0)::DOUBLE, 9) AS cumulative_share, coalesce(sum(hits) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.807 * sum(hits) OVER () AS needed
FROM ({_total}) WINDOW w AS (ORDER BY hits DESC, rule_id)""".replace("(w ROWS", "(ORDER BY hits DESC, rule_id ROWS"))
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by hits with the running share, and which are needed for 80.7 % of findings."""
    out = measure.concentration(_all(spark, sf_dir), 0.807)
    return out.select("rule_id", "hits", F.col("rank").cast("long").alias("rank"), F.round("cumulative_share", 9).alias("cumulative_share"), "needed")


@query("summary_block", f"""SELECT count(*) AS rules_run, max(trials) AS trials, CAST(sum(hits) AS BIGINT) AS findings, round(sum(hits) / max(trials)::DOUBLE, 9) AS findings_per_unit, count(*) FILTER (hits = 0) AS quiet_rules,
count(*) FILTER (100 * hits > trials) AS over_one_percent, count(*) FILTER (20 * hits > trials) AS over_five_percent, round(coalesce(sum(hits) FILTER (20 * hits > trials), 0) / nullif(sum(hits), 0)::DOUBLE, 9) AS over_five_share, round(max(hits) / nullif(sum(hits), 0)::DOUBLE, 9) AS top_rule_share FROM ({_total})""")
def summary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("hits")
    loud = F.coalesce(F.sum(F.when(F.expr("20 * hits > trials"), F.col("hits"))), F.lit(0))
    return _all(spark, sf_dir).agg(
        F.count("*").alias("rules_run"), F.max("trials").alias("trials"), total.alias("findings"), F.round(total / F.max("trials"), 9).alias("findings_per_unit"), F.count_if(F.col("hits") == 0).alias("quiet_rules"),
        F.count_if(F.expr("100 * hits > trials")).alias("over_one_percent"), F.count_if(F.expr("20 * hits > trials")).alias("over_five_percent"),
        F.round(F.try_divide(loud.cast("double"), total), 9).alias("over_five_share"), F.round(F.try_divide(F.max("hits").cast("double"), total), 9).alias("top_rule_share"),
    )


_flagged = "(" + " OR ".join(sql_predicate(r) for r in RUNNABLE if r.id in ("own:both", "own:either", "own:token")) + ")"


@query("confusion_matrix", f"""WITH c AS (SELECT coalesce({_flagged}, false) AS fired, l.quality = 0 AS bad FROM documents d JOIN labels l USING (doc_id)),
n AS (SELECT count(*) FILTER (fired AND bad) AS tp, count(*) FILTER (fired AND NOT bad) AS fp, count(*) FILTER (NOT fired AND bad) AS fn, count(*) FILTER (NOT fired AND NOT bad) AS tn FROM c)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS precision, round(fp / nullif(fp + tn, 0)::DOUBLE, 9) AS fpr FROM n""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any-hit verdicts against labels."""
    fired = matched(spark, sf_dir).select("doc_id", F.arrays_overlap("rule_ids", F.array(*map(F.lit, ("own:both", "own:either", "own:token")))).alias("fired"))
    met = fired.join(table(spark, sf_dir, "labels"), "doc_id")
    out = measure.confusion(met, F.col("fired"), F.col("quality") == 0)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "fpr")])


@query("nearest_index_quantiles", """WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL), q AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])::DOUBLE AS q)
SELECT q.q, s.n_chars AS value FROM q JOIN s ON s.i = round_even((s.n - 1) * q.q, 0)""")
def nearest_index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements at round((n - 1) q), ties to even."""
    return measure.nearest_index_quantiles(table(spark, sf_dir, "documents"), "n_chars", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])


@query("nearest_rank", "SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS most, count(*) FILTER (n_chars > 5000) AS long_ones FROM documents GROUP BY lang")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: the latency summary over any measure."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_rank_docs")
    return spark.sql("""SELECT lang, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p50, CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY n_chars) AS BIGINT) AS p99,
        max(n_chars) AS most, count_if(n_chars > 5000) AS long_ones FROM _rank_docs GROUP BY lang""")


@query("corpus_digest", """SELECT sha256(string_agg(h || chr(10), '' ORDER BY h)) AS digest, count(*) AS samples FROM (SELECT sha256(l.doc_id::VARCHAR || chr(0) || d.text || chr(0) || l.toxic::INTEGER::VARCHAR) AS h FROM labels l JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL)""")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as one pinned corpus."""
    texts = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return measure.corpus_digest(table(spark, sf_dir, "labels").join(texts, "doc_id"), "doc_id", "text", "toxic")


@query("corpus_tree_digest", """WITH f AS (SELECT substr(h, 1, 4) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY 1),
c AS (SELECT substr(g, 1, 2) AS b, sha256(string_agg(d, chr(10) ORDER BY g)) AS d, sum(n) AS n FROM f GROUP BY 1) SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS units FROM c""")
def corpus_tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one digest, made in three levels."""
    return measure.corpus_tree_digest(table(spark, sf_dir, "documents").where("text IS NOT NULL"))


@query("report_combine", f"SELECT rule_id, stratum, trials, hits, round({_exact}, 6) AS u95 FROM ({_total.replace('rule_id, trials', 'rule_id, stratum, trials')})")
def report_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two disjoint halves added up: equal to the report of the whole."""
    docs = matched(spark, sf_dir)
    halves = [measure.rule_hits(docs.where(F.pmod(F.xxhash64("source"), F.lit(2)) == k), list(IDS), {}) for k in (0, 1)]
    return measure.with_bounds(measure.combine(*halves)).withColumn("u95", F.round("u95", 6))


@query("hypothetical_lanes", f"SELECT lane, count(*) AS rules FROM ({ORACLES['lane_per_rule']}) GROUP BY lane")
def hypothetical_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules each lane would hold."""
    return lane_per_rule(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("rules"))


@query("evidence_check", """SELECT id, trials > 0 AND hits BETWEEN 0 AND trials AND good AS ok FROM (VALUES ('a', 10, 1, true), ('b', 10, 11, true), ('c', 0, 0, true), ('d', 10, 1, false), ('e', 3000, 0, true)) AS v(id, trials, hits, good)""")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evidence whose counts, bound and date are sound."""
    rows = [("a", 10, 1, stats.upper_bound(10, 1), "2026-01-01"), ("b", 10, 11, 1.0, "2026-01-01"), ("c", 0, 0, 1.0, "2026-01-01"), ("d", 10, 1, 0.5, "2026-01-01"), ("e", 3000, 0, stats.upper_bound(3000, 0), "2026-01-02T00:00:00")]
    df = spark.createDataFrame(rows, "id string, trials long, hits long, u95 double, at string")
    return df.select("id", admission.evidence_ok(F.col("trials"), F.col("hits"), F.col("u95"), F.col("at")).alias("ok"))
