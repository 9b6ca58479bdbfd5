"""Aggregates over serving traces and feedback. Each is one scan of the columns that it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Percentiles, spans and thresholds of the report.
PERCENTS = (10, 25, 50, 75, 90, 99)
SPANS = ("query_embed", "qdrant_search", "rerank", "sibling_expand", "context_truncate", "llm_generate", "verify", "total")
BINS, BIN = 10, 0.1
RETRY_BELOW = 0.3
SIGNALS = ("up", "down", "reformulated")


def _octave(value: Column) -> Column:
    """Bucket of a number, a few hundred for usual ranges; its order is that of the values."""
    size = F.floor(F.log2(F.abs(value)) * 32) + 100_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("int")


def grouped_percentiles(df: DataFrame, groups: list[str], value: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Exact percentiles of a column per group: n and p<percent>, rounded to 4 places.

    Groups of 100 values or more interpolate between ranks; smaller ones take
    the value at place int(n * p / 100), counted from 0. Null and NaN do not
    count. Equal values are counted first; ranks are found in the running
    counts of coarse buckets, then inside the buckets that hold them, so no
    task holds the values of a group.
    """
    v = F.col(value).cast("double")
    keys = groups or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if not groups else df
    counts = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c")).withColumn("_b", _octave(F.col("_v")))
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    upto = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_below", upto - F.col("_s")).withColumn("_n", F.sum("_s").over(Window.partitionBy(*keys)))
    n, wanted = F.col("_n"), []
    for p in percents:
        exact = F.lit(p / 100) * (n - 1)
        small = F.least(n - 1, F.floor(n * p / 100))
        for side, rank in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            wanted.append(F.struct(F.lit(f"{side}{p}").alias("name"), F.when(n < 100, small).otherwise(rank).alias("rank")))
    here = lambda low, size: F.filter(F.array(*wanted), lambda w: (w["rank"] >= low) & (w["rank"] < low + size))
    held = sums.withColumn("_wanted", here(F.col("_below"), F.col("_s"))).where("size(_wanted) > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_at"), "_below", "_n", "_wanted")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = counts.join(held, [*same, F.col("_b") == F.col("_at")])
    run = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_low", F.col("_below") + run - F.col("_c"))
    found = inside.select(*keys, "_n", "_v", F.explode(F.filter("_wanted", lambda w: (w["rank"] >= F.col("_low")) & (w["rank"] < F.col("_low") + F.col("_c")))).alias("_w"))
    pick = lambda name: F.max(F.when(F.col("_w.name") == name, F.col("_v")))
    picked = found.groupBy(*keys, "_n").agg(*[pick(f"{side}{p}").alias(f"_{side}{p}") for p in percents for side in ("lo", "hi")])
    part = lambda p: F.when(n < 100, 0.0).otherwise(F.lit(p / 100) * (n - 1) - F.floor(F.lit(p / 100) * (n - 1)))
    out = [F.round(F.col(f"_lo{p}") + (F.col(f"_hi{p}") - F.col(f"_lo{p}")) * part(p), 4).alias(f"p{p}") for p in percents]
    return picked.select(*groups, n.alias("n"), *out)


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts of values in ten bins of 0.1 from 0 to 1: bin, n; values beyond go to the end bins, empty bins have 0."""
    place = F.least(F.greatest(F.floor(F.col(value) / F.lit(BIN)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate(part: Column, whole: Column, places: int) -> Column:
    """part / whole, rounded; null where there is no whole."""
    return F.round(part / F.nullif(whole.cast("double"), F.lit(0.0)), places)


def volume(traces: DataFrame) -> DataFrame:
    """Requests and errors per endpoint as logged ("?" for none)."""
    return traces.groupBy(F.coalesce("endpoint", F.lit("?")).alias("endpoint")).agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def routes(traces: DataFrame) -> DataFrame:
    """Routed requests per strategy and per query type, in one pass."""
    r = traces.where("route is not null").select(F.coalesce("route.strategy", F.lit("?")).alias("strategy"), F.coalesce("route.query_type", F.lit("?")).alias("query_type"))
    sets = r.groupingSets([["strategy"], ["query_type"]], "strategy", "query_type").agg(F.count("*").alias("n"))
    return sets.select(F.when(F.col("strategy").isNotNull(), "strategy").otherwise("query_type").alias("dimension"), F.coalesce("strategy", "query_type").alias("name"), "n")


def decomposition(traces: DataFrame) -> DataFrame:
    """Comparison requests per method of decomposition."""
    return traces.where("route.query_type = 'comparison'").groupBy(F.coalesce("decomposition.method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


def top_scores(traces: DataFrame) -> DataFrame:
    """First rerank score of each request that has one: score."""
    return traces.select(F.get("retrieval.rerank_scores", F.lit(0)).alias("score")).where("score is not null")


def retries(traces: DataFrame) -> DataFrame:
    """Effect of query rewriting in answers: triggered, improved, mean change, finally below the threshold."""
    a = traces.where("endpoint = 'answer' and crag is not null").select("crag.*")
    on, both = F.col("retries") > 0, F.col("score_before").isNotNull() & F.col("score_after").isNotNull()
    change = F.col("score_after") - F.col("score_before")
    return a.agg(
        F.count("*").alias("answers"), F.count_if(on).alias("triggered"), F.count_if(on & both & (change > 0)).alias("improved"),
        F.round(F.avg(F.when(on & both, change)), 4).alias("mean_change"),
        F.count_if(on & (F.coalesce("score_after", F.lit(0.0)) < RETRY_BELOW)).alias("still_below"),
    )


def risks(traces: DataFrame) -> DataFrame:
    """Verified answers per risk level: n, claims and mean groundedness."""
    v = traces.where("verification is not null").select("verification.*")
    return v.groupBy(F.coalesce("risk_level", F.lit("?")).alias("risk_level")).agg(F.count("*").alias("n"), F.sum("claims_count").alias("claims"), F.round(F.avg("groundedness"), 3).alias("groundedness"))


def groundedness(traces: DataFrame) -> DataFrame:
    """Spread of groundedness where it is known: n, mean, p50, p95 by rank, least."""
    v = traces.select(F.round("verification.groundedness", 4).alias("g")).where("g is not null")  # at most 10,001 values
    n = v.agg(F.count("*").alias("n"), F.round(F.avg("g"), 3).alias("mean"), F.min("g").alias("least"))
    counts = v.groupBy("g").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("g")))
    both = upto.crossJoin(F.broadcast(n))
    return both.groupBy("n", "mean", "least").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n")))).alias("p95"))


def latencies(traces: DataFrame) -> DataFrame:
    """p50 and p95 of each named span over all lines."""
    spans = traces.select(F.explode("timing_ms").alias("span", "ms")).where(F.col("span").isin(*SPANS))
    return grouped_percentiles(spans, ["span"], "ms", (50, 95))


def daily_latencies(traces: DataFrame) -> DataFrame:
    """p50 and p95 of each named span per directory day."""
    spans = traces.select("dt", F.explode("timing_ms").alias("span", "ms")).where(F.col("span").isin(*SPANS))
    return grouped_percentiles(spans, ["dt", "span"], "ms", (50, 95))


def errors(traces: DataFrame) -> DataFrame:
    """Requests per error type."""
    return traces.where("error is not null").groupBy(F.coalesce("error.type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"))


def critic(traces: DataFrame) -> DataFrame:
    """Second opinions per failure type and action taken: n."""
    c = traces.where("critic.invoked").select("critic.*")
    return c.groupBy(F.coalesce("failure_type", F.lit("none")).alias("failure_type"), F.coalesce("action_taken", F.lit("none")).alias("action_taken")).agg(F.count("*").alias("n"))


def critic_rate(traces: DataFrame) -> DataFrame:
    """Verified answers, second opinions and their rate."""
    return traces.agg(F.count_if(F.col("verification").isNotNull()).alias("verified"), F.count_if(F.coalesce("critic.invoked", F.lit(False))).alias("invoked")).withColumn("rate", rate(F.col("invoked"), F.col("verified"), 4))


def rerank_stats(traces: DataFrame) -> DataFrame:
    """Per request with hits: least, greatest and mean of its rounded rerank scores."""
    rows = traces.select("dt", "line_no", F.filter(F.transform("retrieval.rerank_scores", lambda s: F.round(s, 4)), lambda s: s.isNotNull()).alias("s")).where("size(s) > 0")
    mean = F.aggregate("s", F.lit(0.0), lambda a, s: a + s) / F.size("s")
    return rows.select("dt", "line_no", F.array_min("s").alias("least"), F.array_max("s").alias("most"), F.round(mean, 4).alias("mean"))


def claim_coverage(traces: DataFrame) -> DataFrame:
    """Over answers with claims: answers, mean number of claims, and percent of the claims with facts that a source supports.

    Traces that do not log verifiable_claims_count and supported_claims_count
    have no percentage.
    """
    has = traces.schema["verification"].dataType.names
    count = lambda c: F.sum(F.coalesce(f"verification.{c}", F.lit(0))) if c in has else F.lit(None).cast("long")
    v = traces.where("verification.claims_count > 0")
    share = F.round(F.lit(100.0) * count("supported_claims_count") / F.nullif(count("verifiable_claims_count").cast("double"), F.lit(0.0)), 1)
    return v.agg(F.count("*").alias("answers"), F.round(F.avg("verification.claims_count"), 2).alias("mean_claims"), share.alias("coverage"))


def critic_effect(traces: DataFrame) -> DataFrame:
    """Second attempts by risk before and after, with those that improved; and the risk before of those that were let pass.

    Columns action (regenerate or pass), before_risk, after_risk, n, improved.
    ``traces`` log before_risk, after_risk and regenerate_improved in critic.
    """
    c = traces.where("critic.invoked and critic.action_taken in ('regenerate', 'pass')").select("critic.*").where("action_taken = 'regenerate' or before_risk is not null")
    after = F.when(F.col("action_taken") == "regenerate", F.col("after_risk"))
    return c.groupBy(F.col("action_taken").alias("action"), "before_risk", after.alias("after_risk")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("regenerate_improved", F.lit(False))).alias("improved"))


def summary(traces: DataFrame) -> DataFrame:
    """All sections of the report in long form: section, name, metric, value."""

    def long(section: str, df: DataFrame, name: str | None, *metrics: str) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        return df.select(F.lit(section).alias("section"), (F.col(name) if name else F.lit("")).alias("name"), pairs.alias("p")).select("section", "name", "p.metric", "p.value")

    parts = [
        long("volume", volume(traces), "endpoint", "requests", "errors"), long("route", routes(traces).where("dimension = 'strategy'"), "name", "n"), long("query_type", routes(traces).where("dimension = 'query_type'"), "name", "n"),
        long("decomposition", decomposition(traces), "method", "n"), long("rerank", grouped_percentiles(top_scores(traces), [], "score"), None, "n", *[f"p{p}" for p in PERCENTS]),
        long("retry", retries(traces), None, "answers", "triggered", "improved", "mean_change", "still_below"), long("verification", risks(traces), "risk_level", "n", "claims", "groundedness"), long("claims", claim_coverage(traces), None, "answers", "mean_claims"),
        long("latency", latencies(traces), "span", "n", "p50", "p95"), long("errors", errors(traces), "type", "n"), long("critic", critic(traces).groupBy("failure_type").agg(F.sum("n").alias("n")), "failure_type", "n"),
        long("input_guard", input_guards(traces), "kind", "n"), long("output_guard", output_guards(traces), "kind", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluation_stats(results: DataFrame) -> DataFrame:
    """Basic figures of an evaluation run: questions, times, routing accuracy, retried and unanswered ones, and the first wrongly routed.

    ``results`` has question_no, question, elapsed_ms, answer, expected_type,
    predicted_type, crag_retries; questions without expected type are not judged.
    """
    wrong = F.col("expected_type").isNotNull() & ~F.col("expected_type").eqNullSafe(F.col("predicted_type"))
    first = F.slice(F.array_sort(F.collect_list(F.when(wrong & (F.col("_w") <= 5), F.struct("question_no", F.substring("question", 1, 40).alias("question"), "expected_type", "predicted_type")))), 1, 5)
    rows = results.withColumn("_w", F.row_number().over(Window.partitionBy(wrong).orderBy("question_no")))
    labelled = F.count("expected_type")
    right = F.count_if(F.col("expected_type") == F.col("predicted_type"))
    return rows.agg(
        F.count("*").alias("questions"), F.round(F.avg("elapsed_ms"), 0).alias("mean_ms"), F.min("elapsed_ms").alias("least_ms"), F.max("elapsed_ms").alias("most_ms"), labelled.alias("labelled"), right.alias("right"), rate(right, labelled, 3).alias("accuracy"),
        F.count_if(F.col("crag_retries") > 0).alias("retried"), F.count_if(F.contains(F.col("answer"), F.lit("확인되지 않음"))).alias("unanswered"), first.alias("wrong"),
    )


def status_durations(log: DataFrame, keys: list[str], status: str = "status_code", at: str = "created_at") -> DataFrame:
    """Time that each document spent in each status: keys, status, since, seconds (null while it lasts)."""
    then = F.lead(at).over(Window.partitionBy(*keys).orderBy(at, status))
    return log.select(*keys, F.col(status).alias("status"), F.col(at).alias("since"), (F.unix_micros(then.cast("timestamp")) / 1e6 - F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("seconds"))


def input_guards(traces: DataFrame) -> DataFrame:
    """Requests per kind of personal data that the input guard found, beside all guarded requests."""
    g = traces.where("input_guard is not null").select("input_guard.*")
    total = g.agg(F.count("*").alias("guarded"), F.count_if(F.col("pii_count") > 0).alias("flagged"))
    kinds = g.where("pii_count > 0").select(F.explode("pii_found").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.crossJoin(F.broadcast(total))


def output_guards(traces: DataFrame) -> DataFrame:
    """Threats that the output guard found, by kind: leak, profanity, other."""
    t = traces.select(F.explode("output_guard.threats").alias("t"))
    kind = F.when(F.col("t").startswith("output_leak:"), "leak").when(F.col("t").startswith("profanity:"), "profanity").otherwise("other")
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def one_per_trace(traces: DataFrame) -> DataFrame:
    """The line that counts for each trace_id: that of the oldest directory day, there the last; blank ids are dropped."""
    rows = traces.where("trim(trace_id) <> ''").withColumn("_day", F.datediff(F.to_date("dt"), F.lit("1970-01-01").cast("date")))
    order = F.struct(-F.col("_day"), F.col("line_no"))
    body = F.struct(*[c for c in traces.columns if c != "trace_id"])
    return rows.groupBy("trace_id").agg(F.max_by(body, order).alias("_b")).select("trace_id", "_b.*")


def feedback_signals(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Per valid signal: feedback, matched with a trace, rate, mean first score and answers at hard_fail."""
    lines = one_per_trace(traces.select("trace_id", "dt", "line_no", F.get("retrieval.rerank_scores", F.lit(0)).alias("score"), F.col("verification.risk_level").alias("risk")))
    f = feedback.where(F.col("signal").isin(*SIGNALS)).select("trace_id", "signal")
    j = f.join(lines.withColumn("_hit", F.lit(1)), "trace_id", "left")
    return j.groupBy("signal").agg(
        F.count("*").alias("total"), F.count("_hit").alias("matched"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("risk") == "hard_fail").alias("hard_fail"),
    ).withColumn("match_rate", rate(F.col("matched"), F.col("total"), 3))


def signal_risks(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Matched feedback by risk level (rows) and signal (columns)."""
    lines = one_per_trace(traces.select("trace_id", "dt", "line_no", F.col("verification.risk_level").alias("risk_level")))
    j = feedback.where(F.col("signal").isin(*SIGNALS)).select("trace_id", "signal").join(lines, "trace_id")
    table = j.groupBy(F.coalesce("risk_level", F.lit("none")).alias("risk_level")).pivot("signal", list(SIGNALS)).count()
    return table.select("risk_level", *[F.coalesce(s, F.lit(0)).alias(s) for s in SIGNALS])


def last_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Newest value per key by (order columns): keys, value, since."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias("since"))
