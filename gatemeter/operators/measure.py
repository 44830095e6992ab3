"""Firing measurements: strata, trials and hits, bundle union, worst rows, lanes, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gatemeter.functions import stats


def strata(labels: dict[str, str]) -> Column:
    """The strata keys of a unit: all, each name=value by name, and the intersection of all."""
    one = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(c), F.lit("none"))) for name, c in sorted(labels.items())]
    both = [F.concat_ws("&", *one)] if len(one) > 1 else []
    return F.array(F.lit("all"), *one, *both)


def trials(units: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(stratum, trials). Each unit counts once in each of its strata."""
    return units.select(F.explode(strata(labels)).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("trials"))


#: Up to so many rules are counted as columns of one aggregate; a wider one leaves generated code.
WIDE_RULES = 64


def rule_hits(matched: DataFrame, rule_ids: list[str], labels: dict[str, str]) -> DataFrame:
    """(rule_id, stratum, trials, hits) with rows of no hits.

    `matched` has rule_ids, at most one entry a rule. For a set of usual size one aggregate
    makes trials and a count for each rule of each stratum, so the units are read once. A
    larger set counts (stratum, rule) rows, trials among them under a null rule, and fills
    the grid of strata and rules afterwards. Partial sums do the shuffling in both.
    """
    at = matched.select("rule_ids", F.explode(strata(labels)).alias("stratum"))
    if len(rule_ids) <= WIDE_RULES:
        named = [F.count_if(F.array_contains("rule_ids", r)).alias(f"r{i}") for i, r in enumerate(rule_ids)]
        wide = at.groupBy("stratum").agg(F.count("*").alias("trials"), *named)
        rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(f"r{i}").alias("hits")) for i, r in enumerate(rule_ids)])
        return wide.select("stratum", "trials", F.explode(rows).alias("x")).select("x.rule_id", "stratum", "trials", "x.hits")
    own = F.concat(F.array(F.lit(None).cast("string")), F.array_intersect("rule_ids", F.array(*map(F.lit, rule_ids))))
    counts = at.select("stratum", F.explode(own).alias("rule_id")).groupBy("stratum", "rule_id").agg(F.count("*").alias("n"))
    by_stratum = counts.groupBy("stratum").agg(
        F.max(F.when(F.col("rule_id").isNull(), F.col("n"))).alias("trials"), F.map_from_entries(F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", "n")))).alias("hits")
    )  # at most one entry a rule
    grid = by_stratum.select("stratum", "trials", "hits", F.explode(F.array(*map(F.lit, rule_ids))).alias("rule_id"))
    return grid.select("rule_id", "stratum", "trials", F.coalesce(F.try_element_at("hits", "rule_id"), F.lit(0)).cast("long").alias("hits"))


def bundle_hits(matched: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(stratum, trials, hits): a unit is hit once if any rule matches it."""
    fired = (F.size("rule_ids") > 0).alias("fired")
    return matched.select(fired, F.explode(strata(labels)).alias("stratum")).groupBy("stratum").agg(F.count("*").alias("trials"), F.count_if("fired").alias("hits"))


def with_bounds(rows: DataFrame) -> DataFrame:
    """The rows with u95, the exact bound of (trials, hits)."""
    return rows.withColumn("u95", stats.u95("trials", "hits"))


def worst(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the row of the largest bound (then the first stratum by name)."""
    w = Window.partitionBy(*by).orderBy(F.desc("u95"), "stratum") if by else Window.orderBy(F.desc("u95"), "stratum")
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def lanes(rows: DataFrame, bundle_ok: bool) -> DataFrame:
    """(rule_id, lane, reason) of each rule's worst stratum."""
    own = worst(rows if "u95" in rows.columns else with_bounds(rows), ["rule_id"])
    told = own.withColumn("_a", stats.bound_within(stats.ADVISE)("trials", "hits")).withColumn("_d", stats.bound_within(stats.DENY)("trials", "hits"))
    lane, reason = stats.lane(F.lit(True), F.col("trials"), F.lit(bundle_ok), F.col("_a"), F.col("_d"))
    return told.select("rule_id", "stratum", "trials", "hits", "u95", lane.alias("lane"), reason.alias("reason"))


def bundle_failures(bundle: DataFrame, required: list[str], duplicates: int, mixed: bool = False) -> list[str]:
    """Why a bundle may not act; empty if it may. `bundle` has a row for each stratum, a bounded set."""
    rows = {r["stratum"]: r for r in with_bounds(bundle).collect()}
    out = [f"missing strata: {s}" for s in required if s not in rows]
    if duplicates:
        out.append(f"duplicate material units: {duplicates}")
    if mixed:
        out.append("whole and leaf material are mixed")
    if rows:
        top = max(rows.values(), key=lambda r: (r["u95"], r["stratum"]))
        told = stats.within(top["trials"], top["hits"], stats.ADVISE)
        if told is None:
            out.append(f"worst bundle stratum is not resolvable against {stats.ADVISE}")
        elif not told:
            out.append(f"worst bundle stratum u95={top['u95']:.6f} exceeds {stats.ADVISE}")
    else:
        out.append("no runnable rules")
    return out


def duplicates(units: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(by, units, distinct_units, duplicate_units) by content digest."""
    return units.groupBy(*by).agg(F.count("*").alias("units"), F.countDistinct(F.sha2(text_col, 256)).alias("distinct_units")).withColumn("duplicate_units", F.col("units") - F.col("distinct_units"))


def first_occurrences(units: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sha256, first id, occurrences) of each distinct text."""
    return units.groupBy(F.sha2(text_col, 256).alias("sha256")).agg(F.min(id_col).alias(id_col), F.count("*").alias("occurrences"))


def salted_split(digest: Column, salt: str, ways: int = 2) -> Column:
    """A part from 0 that depends on salt and digest alone."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), digest), 256), 1, 2), 16, 10).cast("int") % ways).cast("int")


def salted_sample(units: DataFrame, salt: str, n: int, id_col: str = "doc_id") -> DataFrame:
    """The n units of least salted digest: a sample that any machine draws alike."""
    return units.withColumn("rank_digest", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256)).orderBy("rank_digest").limit(n)


def concentration(hits: DataFrame, share: float) -> DataFrame:
    """(rule_id, hits, rank, cumulative_share, needed): rules by hits, needed up to the share."""
    w = Window.orderBy(F.desc("hits"), "rule_id")  # one row a rule: bounded by the rule limit
    total = F.sum("hits").over(Window.partitionBy())
    before = F.coalesce(F.sum("hits").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.select("rule_id", "hits", F.row_number().over(w).alias("rank"), F.try_divide(before + F.col("hits"), total).alias("cumulative_share"), (before < share * total).alias("needed"))


def confusion(rows: DataFrame, fired: Column, label: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, recall, precision, fpr; null where a ratio has no base."""
    c = rows.agg(F.count_if(fired & label).alias("tp"), F.count_if(fired & ~label).alias("fp"), F.count_if(~fired & label).alias("fn"), F.count_if(~fired & ~label).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return c.select("*", ratio("tp", "fn").alias("recall"), ratio("tp", "fp").alias("precision"), ratio("fp", "tn").alias("fpr"))


def nearest_index_quantiles(rows: DataFrame, value: str, cuts: list[float], buckets: int = 64) -> DataFrame:
    """(q, value) where value is the element round((n - 1) * q) of the sorted values.

    Values are counted in buckets between approximate quantiles (64 cut points whatever the
    size); only the buckets that hold a wanted rank are put in order, each on its own.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    edges = sorted(set(own.select(F.col("value").cast("double").alias("v")).approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.01))) or [0.0]
    low = F.array(*map(F.lit, edges))
    counts = own.groupBy("value").agg(F.count("*").alias("n")).withColumn("b", F.size(F.filter(low, lambda c: F.col("value").cast("double") >= c)))
    sizes = counts.groupBy("b").agg(F.sum("n").alias("size"))  # a row for each bucket
    before = sizes.select("b", (F.sum("size").over(Window.orderBy("b")) - F.col("size")).alias("before"), "size", F.sum("size").over(Window.partitionBy()).alias("total"))
    wanted = before.select("*", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("q")).withColumn("at", F.bround((F.col("total") - 1) * F.col("q")).cast("long")).where("at >= before AND at < before + size")
    w = Window.partitionBy("b").orderBy("value")
    placed = counts.join(F.broadcast(wanted.select("b").distinct()), "b", "left_semi").select("b", "value", F.sum("n").over(w).alias("upto"), "n")  # a row for each cut at most
    return placed.join(F.broadcast(wanted), "b").where("at < before + upto AND at >= before + upto - n").select("q", "value")


#: Samples that a pinned corpus may have; its digest is one hash over all, one after another.
MOST_PINNED = 5_000_000


def corpus_digest(samples: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(digest, samples) of a labelled corpus whatever its order: the form that pins are published in.

    Each sample's digest is over id, text and 0 or 1 with zero bytes between; the corpus's is
    over those in order, a newline after each. One task hashes them all, so a corpus beyond
    MOST_PINNED samples is refused; ``corpus_tree_digest`` holds at any size.
    """
    label = F.when(F.coalesce(F.col(label_col).cast("boolean"), F.lit(False)), "1").otherwise("0")
    own = samples.select(F.sha2(F.concat(F.col(id_col).cast("string"), F.lit("\0"), F.col(text_col), F.lit("\0"), label), 256).alias("h"))
    made = own.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("h"))
    fits = F.when(F.col("n") > MOST_PINNED, F.raise_error(F.lit("too many samples for one digest"))).otherwise(F.col("n"))
    return made.select(F.sha2(F.array_join(F.transform("h", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("digest"), fits.cast("long").alias("samples"))


def corpus_tree_digest(units: DataFrame, text_col: str = "text") -> DataFrame:
    """One digest of all texts whatever their order, at any size; not the form of pins.

    Texts' digests are put in order within their first four hex digits (65,536 groups), then
    the groups' digests within the first two, then those: no step holds more than a small
    part of the corpus, and the definition is the same at every size.
    """
    joined = lambda c: F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("b", c))), lambda x: x[c])), 256)
    own = units.select(F.sha2(F.col(text_col), 256).alias("h")).select("h", F.substring("h", 1, 4).alias("g"))
    fine = own.groupBy("g").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("d"), F.count("*").alias("n"))
    coarse = fine.withColumn("b", F.col("g")).groupBy(F.substring("g", 1, 2).alias("top")).agg(joined("d").alias("d"), F.sum("n").alias("n"))
    return coarse.withColumn("b", F.col("top")).agg(joined("d").alias("digest"), F.sum("n").alias("units"))


def drift(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): added, removed, changed or same."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def combine(*reports: DataFrame) -> DataFrame:
    """Reports of disjoint corpora as one: counts add up, bounds are made anew."""
    both = reports[0]
    for r in reports[1:]:
        both = both.unionByName(r)
    return both.groupBy("rule_id", "stratum").agg(F.sum("trials").alias("trials"), F.sum("hits").alias("hits"))


def pairs_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, user_turn, assistant_turn): each user turn with the assistant's next turn."""
    call = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("user_turn"), (F.col("turn") + 1).alias("turn"))
    return call.join(turns.where("role = 'assistant'").select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", "user_turn", F.col("turn").alias("assistant_turn"))
