"""Filing tables: EPS and share facts, known_at resolution, tag diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import (
    EPS_TAGS, EPS_TAGS_EXPANDED, LEGACY_UTC_MIDNIGHT, PERIODIC_FORMS, SHARES_TAGS, STANDARD_NAMESPACES,
    EventStudyConfig,
)
from tidemark.operators.asof import asof_join
from tidemark.operators.eventstudy import choose_known_at, filed_instant, standardized_surprise, yyyymmdd
from tidemark.operators.gates import require_columns
from tidemark.operators.ordered import earliest

SUB_COLUMNS = ("adsh", "cik", "form", "period", "fy", "fp", "filed")
NUM_COLUMNS = ("adsh", "tag", "version", "ddate", "qtrs", "uom", "value")


def pad_cik(cik: Column) -> Column:
    """Ten digits, zero padded; longer input is left alone (unlike lpad)."""
    raw = cik.cast("string")
    return F.when(F.length(raw) >= 10, raw).otherwise(F.lpad(raw, 10, "0"))


def _rank_of(tag: Column, tags: Sequence[str]) -> Column:
    """Position in a short priority list, NULL when absent."""
    out = None
    for i, name in enumerate(tags):
        out = F.when(tag == name, F.lit(i)) if out is None else out.when(tag == name, F.lit(i))
    return out


def extract_eps(sub: DataFrame, num: DataFrame, tags: Sequence[str] = EPS_TAGS) -> DataFrame:
    """One quarterly EPS per (cik, date), best tag first, then as first filed.

    The tag and duration filters reach the scan of ``num`` before the join.
    """
    require_columns(sub, SUB_COLUMNS)
    require_columns(num, NUM_COLUMNS)
    facts = num.where(F.col("tag").isin(list(tags)) & (F.col("qtrs") == 1)).select("adsh", "tag", "ddate", "value")
    joined = facts.join(sub.select("adsh", "cik", "form", "filed"), "adsh")
    best = earliest(
        joined.withColumn("_rank", _rank_of(F.col("tag"), tags)),
        ["cik", "ddate"],
        ["_rank", "filed", "adsh", "value"],
        ["value", "tag", "form", "filed", "adsh"],
    )
    return best.select(
        pad_cik(F.col("cik")).alias("cik"), yyyymmdd(F.col("ddate")).alias("period_end"),
        F.col("value").alias("eps_value"), F.col("tag").alias("tag_used"), "form",
        yyyymmdd(F.col("filed")).alias("filed"), "adsh",
    )


def extract_shares(sub: DataFrame, num: DataFrame, tags: Sequence[str] = SHARES_TAGS) -> DataFrame:
    """Shares outstanding per (cik, date).

    Identical facts collapse, the best tag of each filing is chosen, its share
    classes are summed, and of several filings echoing one date the filing of
    that very period wins, else the earliest filed.
    """
    require_columns(sub, SUB_COLUMNS)
    require_columns(num, NUM_COLUMNS)
    identity = [c for c in ("adsh", "tag", "ddate", "coreg", "value") if c in num.columns]
    facts = num.where(F.col("tag").isin(list(tags)) & (F.col("qtrs") == 0)).select(*identity).dropDuplicates()
    # summing per tag first and picking the tag afterwards needs no window and combines map-side
    per_tag = facts.groupBy("adsh", "ddate", "tag").agg(F.sum("value").alias("shares_outstanding"))
    chosen = earliest(
        per_tag.withColumn("_rank", _rank_of(F.col("tag"), tags)), ["adsh", "ddate"], ["_rank"],
        ["shares_outstanding", "tag"],
    )
    joined = chosen.join(sub.select("adsh", "cik", "form", "filed", "period"), "adsh")
    own = F.coalesce(F.col("ddate") == F.col("period"), F.lit(False))
    best = earliest(
        joined.withColumn("own", own), ["cik", "ddate"], [(~F.col("own")).alias("echo"), "filed", "adsh"],
        ["shares_outstanding", "tag", "form", "filed", "adsh", "own"],
    )
    return best.select(
        pad_cik(F.col("cik")).alias("cik"), yyyymmdd(F.col("ddate")).alias("period_end"), "shares_outstanding",
        F.col("tag").alias("tag_used"), "form", yyyymmdd(F.col("filed")).alias("filed"), "adsh",
        F.col("own").alias("is_own_period"),
    )


def flag_jumps(shares: DataFrame, max_ratio: float = 5.0) -> DataFrame:
    """Mark values off by ``max_ratio`` from a neighbouring period; nothing is dropped."""
    w = Window.partitionBy("cik").orderBy("period_end")
    value = F.col("shares_outstanding")

    def off(neighbour: Column) -> Column:
        ratio = F.try_divide(value, F.when(neighbour != 0, neighbour))
        return F.coalesce((ratio >= max_ratio) | (ratio <= 1.0 / max_ratio), F.lit(False))

    both = off(F.lag(value).over(w)) | off(F.lead(value).over(w))
    return shares.withColumn("implausible_jump", both)


# ---------------------------------------------------------------- periodic filings


def periodic_filings(sub: DataFrame, forms: Sequence[str] = PERIODIC_FORMS) -> DataFrame:
    """Periodic reports with a usable period and filing date, CIK padded."""
    require_columns(sub, ("adsh", "cik", "form", "period", "filed"))
    kept = sub.where(F.col("form").isin(list(forms)) & F.col("period").isNotNull() & F.col("filed").isNotNull())
    return kept.withColumn("cik", pad_cik(F.col("cik")))


def only_ciks(df: DataFrame, ciks: DataFrame, column: str = "cik") -> DataFrame:
    """Keep whitelisted CIKs whatever their padding."""
    wanted = ciks.select(pad_cik(F.col(column)).alias(column)).distinct()
    return df.join(wanted, column, "left_semi")


def first_filings(periodic: DataFrame) -> DataFrame:
    """Earliest-filed original per (cik, period) and how many filings there were."""
    return (
        periodic.groupBy("cik", "period")
        .agg(
            F.min_by(F.struct("form", "filed", "adsh"), F.struct("filed", "adsh")).alias("_f"),
            F.count("*").alias("n_periodic_filings"),
        )
        .select("cik", "period", "_f.*", "n_periodic_filings")
    )


def amendment_only_periods(sub: DataFrame, forms: Sequence[str] = PERIODIC_FORMS) -> DataFrame:
    """Periods that appear only as an amendment."""
    base = list(forms)
    both = base + [f"{f}/A" for f in base]
    return (
        sub.where(F.col("form").isin(both))
        .groupBy(pad_cik(F.col("cik")).alias("cik"), "period")
        .agg(F.bool_or(F.col("form").isin(base)).alias("_base"))
        .where(~F.col("_base"))
        .drop("_base")
    )


def acceptance_or_filed(
    filings: DataFrame, acceptance: DataFrame | None, convention: str = LEGACY_UTC_MIDNIGHT
) -> DataFrame:
    """The real acceptance instant when known, else the date-only reading, with its source.

    ``acceptance`` has (cik, accession_number, acceptance_datetime) in UTC.
    """
    fallback = filed_instant(F.col("filed"), convention)
    if acceptance is None:
        filings = filings.withColumn("_acc", F.lit(None).cast("timestamp_ntz"))
    else:
        known = acceptance.groupBy(
            pad_cik(F.col("cik")).alias("cik"), F.col("accession_number").cast("string").alias("adsh")
        ).agg(F.min("acceptance_datetime").cast("timestamp_ntz").alias("_acc"))
        filings = filings.withColumn("adsh", F.col("adsh").cast("string")).join(known, ["cik", "adsh"], "left")
    return (
        filings.withColumn("disclosed_at", F.coalesce("_acc", fallback))
        .withColumn(
            "disclosure_source",
            F.when(F.col("_acc").isNotNull(), "submissions_acceptance_datetime").otherwise(
                f"sub_txt_filed_date:{convention}"
            ),
        )
        .drop("_acc")
    )


def latest_announcement(filings: DataFrame, item202: DataFrame, window_days: int = 5, out: str = "announced_at") -> DataFrame:
    """Latest announcement within ``window_days`` up to the disclosure instant."""
    said = item202.select(
        pad_cik(F.col("cik")).alias("cik"), F.col("acceptance_datetime").cast("timestamp_ntz").alias(out)
    ).withColumn("_at", F.col(out))
    return asof_join(
        filings, said, ["cik"], "disclosed_at", "_at", [out],
        tolerance=F.make_dt_interval(days=F.lit(window_days)),
    )


def resolve_known_at(
    sub: DataFrame, item202: DataFrame, config: EventStudyConfig = EventStudyConfig(),
    acceptance: DataFrame | None = None, ciks: DataFrame | None = None, forms: Sequence[str] = PERIODIC_FORMS,
    convention: str = LEGACY_UTC_MIDNIGHT,
) -> DataFrame:
    """One row per (cik, period) with the moment its earnings became known."""
    periodic = periodic_filings(sub, forms)
    if ciks is not None:
        periodic = only_ciks(periodic, ciks)
    chosen = first_filings(periodic).withColumn("period_end", yyyymmdd(F.col("period")))
    chosen = acceptance_or_filed(chosen.where(F.col("period_end").isNotNull()), acceptance, convention)
    chosen = latest_announcement(chosen, item202, config.fallback_days)
    known_at, source = choose_known_at(F.col("disclosed_at"), F.col("announced_at"), config.fallback_days)
    return chosen.select(
        "cik", "period_end", known_at.alias("known_at"), source.alias("event_source"),
        F.col("disclosed_at").alias("disclosure_filed"), F.col("form").alias("disclosure_form"),
        F.col("adsh").alias("disclosure_adsh"), F.col("disclosure_source").alias("disclosure_timestamp_source"),
        F.col("n_periodic_filings").alias("n_periodic_filings_for_period"),
    )


def period_diagnostics(sub: DataFrame, cik: str, period: int) -> DataFrame:
    """All filings of one period and of the periods within a year of it."""
    near = F.abs(F.col("period") - F.lit(period)) <= 10_000  # one year in YYYYMMDD coding
    return (
        sub.withColumn("cik", pad_cik(F.col("cik")))
        .where((F.col("cik") == cik.rjust(10, "0")) & near)
        .withColumn("same_period", F.col("period") == period)
        .select("cik", "adsh", "form", "period", "filed", "same_period")
    )


# ---------------------------------------------------------------- tags


def _eps_like(num: DataFrame) -> DataFrame:
    return num.where(F.lower("tag").contains("earningspershare"))


def custom_tag_rate(num: DataFrame, tags: Sequence[str] = EPS_TAGS) -> DataFrame:
    """Share of EPS-like facts outside the accepted tags."""
    standard = F.col("tag").isin(list(tags))
    return _eps_like(num).agg(
        F.count("*").alias("n_eps_like"),
        F.count_if(standard).alias("n_standard"),
        F.count_if(~standard).alias("n_custom"),
        F.avg((~standard).cast("double")).alias("custom_rate"),
    )


def namespace(version: Column) -> Column:
    return F.lower(F.split(version, "/")[0])


def tag_counts(num: DataFrame, tags: Sequence[str] = EPS_TAGS) -> DataFrame:
    """Facts per (tag, namespace) with acceptance and P11 category."""
    return (
        _eps_like(num)
        .groupBy("tag", namespace(F.col("version")).alias("namespace"))
        .agg(F.count("*").alias("n_facts"))
        .withColumn("accepted", F.col("tag").isin(list(tags)))
        .withColumn("category", classify_tag(F.col("tag")))
    )


def top_tags(counts: DataFrame, n: int = 20) -> DataFrame:
    """O2: the n most frequent tags (a take-ordered, no full sort)."""
    return counts.orderBy(F.desc("n_facts"), "tag", "namespace").limit(n)


def custom_examples(counts: DataFrame, n: int = 10) -> DataFrame:
    """Up to n distinct (tag, namespace) pairs that are not accepted."""
    return counts.where(~F.col("accepted")).select("tag", "namespace").orderBy("tag", "namespace").limit(n)


def tag_rates(counts: DataFrame) -> DataFrame:
    """Custom rate by tag name and by namespace, and whether they agree within 5 points."""
    odd = ~F.coalesce(F.col("namespace").isin(list(STANDARD_NAMESPACES)), F.lit(False))
    out = counts.agg(
        F.coalesce(F.sum("n_facts"), F.lit(0)).alias("n_eps_like"),
        F.sum(F.when(~F.col("accepted"), F.col("n_facts")).otherwise(0)).alias("_name"),
        F.sum(F.when(odd, F.col("n_facts")).otherwise(0)).alias("_space"),
    )
    out = out.withColumn("rate_by_name", F.try_divide("_name", "n_eps_like"))
    out = out.withColumn("rate_by_namespace", F.try_divide("_space", "n_eps_like")).drop("_name", "_space")
    return out.withColumn("agree_within_5pct", F.abs(F.col("rate_by_name") - F.col("rate_by_namespace")) <= 0.05)


# --- fixed values: (category, alternatives of substrings that must all be there), first match wins ---
TAG_CATEGORIES = (
    ("share_count_or_exclusion_not_an_eps_value", (("weightedaverage",), ("antidilutivesecurities",), ("securities", "excluded"))),
    ("pro_forma", (("proforma",),)),
    ("spac_redemption_pattern", (("redemption",), ("temporaryequity",))),
    ("combined_basic_and_diluted", (("basic", "diluted"),)),
    ("diluted_only", (("diluted",),)),
    ("basic_only", (("basic",),)),
)
OTHER_TAGS = "other_eps_related"
# ------------------------------------------------------------------------------------------------------


def classify_tag(tag: Column) -> Column:
    """Category of an EPS-like tag by TAG_CATEGORIES, ignoring case, blanks, hyphens and underscores."""
    plain = F.regexp_replace(F.lower(tag), "[_\\- ]", "")
    out = F.lit(OTHER_TAGS)
    for category, alternatives in reversed(TAG_CATEGORIES):
        tests = [reduce(and_, [plain.contains(part) for part in parts]) for parts in alternatives]
        out = F.when(reduce(or_, tests), category).otherwise(out)
    return out


def tag_classification(counts: DataFrame, covered: DataFrame) -> DataFrame:
    """Facts and share per category over ``covered`` tags, and their coverage of all facts."""
    total = counts.agg(F.sum("n_facts").alias("_all"))
    by_category = covered.groupBy("category").agg(F.sum("n_facts").alias("n_facts"))
    within = F.sum("n_facts").over(Window.partitionBy(F.lit(1)))  # one row per category
    return (
        by_category.withColumn("_in", within)
        .join(F.broadcast(total))
        .select(
            "category", "n_facts", F.try_divide("n_facts", "_in").alias("share"),
            F.try_divide("_in", "_all").alias("coverage"),
        )
    )


def compare_tag_lists(
    sub: DataFrame, num: DataFrame, ciks: DataFrame, base: Sequence[str] = EPS_TAGS,
    expanded: Sequence[str] = EPS_TAGS_EXPANDED, config: EventStudyConfig = EventStudyConfig(),
) -> DataFrame:
    """Is the latest quarter's surprise computable under each tag list, per CIK?"""

    def last_quarter(tags: Sequence[str], prefix: str) -> DataFrame:
        scored = standardized_surprise(only_ciks(extract_eps(sub, num, tags), ciks), config=config)
        return (
            scored.groupBy("cik")
            .agg(F.count("*").alias(f"{prefix}_n_quarters"), F.max_by(F.struct("sue", "sue_reason"), "period_end").alias("_l"))
            .select(
                "cik", f"{prefix}_n_quarters", F.col("_l.sue").alias(f"{prefix}_sue"),
                F.col("_l.sue_reason").alias(f"{prefix}_reason"),
            )
        )

    wanted = ciks.select(pad_cik(F.col("cik")).alias("cik")).distinct()
    out = wanted.join(last_quarter(base, "base"), "cik", "left").join(last_quarter(expanded, "expanded"), "cik", "left")
    for p in ("base", "expanded"):
        none = F.col(f"{p}_n_quarters").isNull()
        out = out.withColumn(f"{p}_reason", F.when(none, "no_eps_records_for_cik").otherwise(F.col(f"{p}_reason")))
        out = out.withColumn(f"{p}_n_quarters", F.coalesce(f"{p}_n_quarters", F.lit(0).cast("long")))
    return out.withColumn("newly_computable", F.col("base_sue").isNull() & F.col("expanded_sue").isNotNull())


def attempt_outcomes(
    attempts: DataFrame, eps: DataFrame, known: DataFrame, failed: DataFrame | None = None,
    config: EventStudyConfig = EventStudyConfig(),
) -> DataFrame:
    """Latest quarter of every attempted CIK, with the first reason it failed or NULL."""
    scored = standardized_surprise(eps, config=config)
    newest = scored.groupBy("cik").agg(
        F.max_by(F.struct("period_end", "eps_value", "sue", "sue_reason"), "period_end").alias("_l")
    ).select("cik", "_l.*")
    rows = attempts.select(pad_cik(F.col("cik")).alias("cik")).distinct().join(newest, "cik", "left")
    rows = rows.join(known.select("cik", "period_end", "known_at", "event_source"), ["cik", "period_end"], "left")
    if failed is None:
        rows = rows.withColumn("_failed", F.lit(False))
    else:
        marks = failed.select(pad_cik(F.col("cik")).alias("cik")).distinct().withColumn("_failed", F.lit(True))
        rows = rows.join(marks, "cik", "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    reason = (
        F.when(F.col("_failed"), "submission_fetch_failed")
        .when(F.col("period_end").isNull(), "no_eps_records_for_cik")
        .when(F.col("sue_reason").isNotNull(), F.col("sue_reason"))
        .when(F.col("known_at").isNull(), "no_10q_row_for_period_end")
    )
    return rows.withColumn("reason", reason).drop("_failed", "sue_reason")
