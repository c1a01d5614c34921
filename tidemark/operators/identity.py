"""Who was who when: ticker histories, name matching, holding-company footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.filings import pad_cik
from tidemark.operators.gates import Check, gate, require_columns
from tidemark.operators.ordered import earliest, latest, top_n
from tidemark.session import durable

OPEN_END = "9999-12-31"
HISTORY_COLUMNS = ("cik", "ticker", "valid_from", "valid_to", "company_name")


def prepare_history(history: DataFrame) -> DataFrame:
    """Padded CIKs and a far end date for open validity."""
    require_columns(history, HISTORY_COLUMNS)
    return (
        history.withColumn("cik", pad_cik(F.col("cik")))
        .withColumn("valid_from", F.to_date("valid_from"))
        .withColumn("valid_to", F.coalesce(F.to_date("valid_to"), F.to_date(F.lit(OPEN_END))))
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _binned(history: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """One row per interval and month of ``months`` (key, _bin) that it touches.

    An interval is copied to the months its own key was asked for and to no others, so a far horizon
    costs nothing. Each key's months are gathered first: there are as many as the calendar has.
    """
    asked = months.distinct().groupBy(key).agg(F.collect_list("_bin").alias("_bins"))
    from_bin, to_bin = _month(F.col("valid_from")), _month(F.col("valid_to"))
    touched = F.filter("_bins", lambda m: (m >= from_bin) & (m <= to_bin))
    return history.join(asked, key).withColumn("_bin", F.explode(touched)).drop("_bins")


def _covering(probes: DataFrame, history: DataFrame, key: str, as_of: str) -> DataFrame:
    """Distinct (key, day) probes joined to the intervals that cover them.

    Months turn the range condition into an equi-join, so an interval only
    meets probes of its own key and month.
    """
    wanted = probes.select(key, F.to_date(as_of).alias("_day")).distinct().withColumn("_bin", _month(F.col("_day")))
    hits = wanted.join(_binned(history, wanted.select(key, "_bin"), key), [key, "_bin"])
    return hits.where((F.col("valid_from") <= F.col("_day")) & (F.col("_day") <= F.col("valid_to")))


def _attach(probes: DataFrame, found: DataFrame, key: str, as_of: str) -> DataFrame:
    dated = probes.withColumn("_day", F.to_date(as_of))
    return dated.join(found, [key, "_day"], "left").drop("_day")


def _active(probes: DataFrame, history: DataFrame, key: str, code: Column, as_of: str) -> DataFrame:
    """Distinct (key, day) probes with ``n_matches`` covering intervals and ``_code``, the code of the one if it is one.

    A sweep: an interval counts from its first day and is taken off on the day after its last, so an
    interval is two rows at most, however long. Days are summed before they are ordered, so a key holds one row a
    day of the calendar. Codes are summed by exclusive or, in which an interval that has ended leaves no trace.
    """
    lasting = history.where((F.col("valid_from") <= F.col("valid_to")) & F.col(key).isNotNull())
    starts = lasting.select(key, F.col("valid_from").alias("_day"), F.lit(1).alias("_n"), code.alias("_c"), F.lit(False).alias("_asked"))
    ends = lasting.where(F.col("valid_to") < F.lit(OPEN_END).cast("date")).select(
        key, F.date_add("valid_to", 1).alias("_day"), F.lit(-1).alias("_n"), code.alias("_c"), F.lit(False).alias("_asked")
    )
    asked = probes.select(key, F.to_date(as_of).alias("_day"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_c"), F.lit(True).alias("_asked"))
    days = starts.unionByName(ends).unionByName(asked.dropna(subset=[key, "_day"])).groupBy(key, "_day").agg(
        F.sum("_n").alias("_n"), F.bit_xor("_c").alias("_c"), F.max("_asked").alias("_asked")
    )
    upto = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = days.select(key, "_day", "_asked", F.sum("_n").over(upto).alias("n_matches"), F.bit_xor("_c").over(upto).alias("_code"))
    return swept.where("_asked").drop("_asked")


def resolve_cik(probes: DataFrame, history: DataFrame, as_of: str = "as_of") -> DataFrame:
    """The CIK a ticker meant on a day, with status ok, none or ambiguous.

    Both ends of the validity count. An ambiguous ticker resolves to NULL; a missing ticker or day has no match.
    """
    h = prepare_history(history)
    code = F.xxhash64("cik")
    names = h.groupBy("ticker", code.alias("_code")).agg(F.min("cik").alias("_cik"))  # codes only need to differ within a ticker
    found = _active(probes, h, "ticker", code, as_of).join(names, ["ticker", "_code"], "left").drop("_code")
    out = _attach(probes, found, "ticker", as_of).withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long")))
    status = F.when(F.col("n_matches") == 0, "none").when(F.col("n_matches") == 1, "ok").otherwise("ambiguous")
    return out.withColumn("status", status).withColumn("cik", F.when(F.col("status") == "ok", F.col("_cik"))).drop("_cik")


def resolve_for_cik(probes: DataFrame, history: DataFrame, column: str, as_of: str = "as_of") -> DataFrame:
    """The ticker or company name of a CIK on a day; the earliest interval wins."""
    hits = _covering(probes.withColumn("cik", pad_cik(F.col("cik"))), prepare_history(history), "cik", as_of)
    found = hits.groupBy("cik", "_day").agg(
        F.min_by(column, F.struct("valid_from", "valid_to", column)).alias(column)
    )
    out = _attach(probes.withColumn("cik", pad_cik(F.col("cik"))), found, "cik", as_of)
    return out.withColumn("status", F.when(F.col(column).isNull(), "none").otherwise("ok"))


def require_resolved(resolved: DataFrame, name: str = "ticker_resolution") -> Check:
    """The strict reading of J9-J11: any unresolved probe stops the pipeline."""
    bad = resolved.agg(F.count_if(F.col("status") != "ok")).first()[0]
    return gate(name, bad == 0, bad, f"{bad} probes without exactly one match")


def find_conflicts(history: DataFrame) -> DataFrame:
    """One ticker on two CIKs at once, with the overlap.

    Tickers with a single CIK drop out by a plain aggregate. The rest is
    binned by month: the later-starting interval is looked up in the month it
    starts, so a pair meets once, and a long ticker history is spread over its
    months instead of being paired as a whole.
    """
    h = prepare_history(history)
    shared = h.groupBy("ticker").agg(F.min("cik").alias("_a"), F.max("cik").alias("_b"))
    shared = shared.where(F.col("_a") != F.col("_b")).select("ticker")
    # equal rows give one interval and a count
    suspects = h.join(shared, "ticker", "left_semi").groupBy("ticker", "cik", "valid_from", "valid_to").agg(
        F.count("*").alias("copies")
    )
    later = suspects.select(
        "ticker", F.col("cik").alias("cik_b"), F.col("valid_from").alias("from_b"), F.col("valid_to").alias("to_b"),
        F.col("copies").alias("copies_b"), _month(F.col("valid_from")).alias("_bin"),
    )
    earlier = _binned(suspects, later.select("ticker", "_bin"), "ticker").select(
        "ticker", "_bin", F.col("cik").alias("cik_a"), F.col("valid_from").alias("from_a"),
        F.col("valid_to").alias("to_a"), F.col("copies").alias("copies_a"),
    )
    ordered = (F.col("from_a") < F.col("from_b")) | (
        (F.col("from_a") == F.col("from_b")) & (F.col("cik_a") < F.col("cik_b"))
    )
    pairs = later.join(earlier, ["ticker", "_bin"]).where(
        (F.col("cik_a") != F.col("cik_b")) & ordered & (F.col("to_a") >= F.col("from_b"))
    )
    return pairs.select(
        "ticker", "cik_a", "cik_b", F.col("from_b").alias("overlap_start"),
        F.least("to_a", "to_b").alias("overlap_end"),
        (F.col("copies_a") * F.col("copies_b")).alias("n_pairs"),
    )


# ---------------------------------------------------------------- name matching

# fixed values: legal-form noise removed from institution names
NAME_NOISE = (
    ", national association", " national association", ", n.a.", " n.a.", ", fsb", " fsb", ", inc.", " inc.", "the ",
)


def normal_name(name: Column) -> Column:
    """lower case, legal forms dropped, blanks squeezed."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for noise in NAME_NOISE:
        out = F.replace(out, F.lit(noise), F.lit(" "))
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the blank-padded text."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(3))))


def similar_names(asked: DataFrame, known: DataFrame, min_similarity: float, block: Sequence[str] = ()) -> DataFrame:
    """Every pair of distinct texts whose trigram sets have a Dice share of at least ``min_similarity``.

    ``asked`` has the text column w, ``known`` has k; with ``block`` columns only texts that agree on them meet.
    Two sets above the bar must share one of their rarest trigrams (prefix filter) and cannot differ much in size,
    so candidates come from an equi-join on rare trigrams within sizes, and none is missed.
    """
    t, own = float(min_similarity), list(block)
    a = asked.select(*own, "w").distinct().withColumn("w_grams", trigrams(F.col("w")))
    b = known.select(*own, "k").distinct().withColumn("k_grams", trigrams(F.col("k")))
    every = a.select(*own, F.explode("w_grams").alias("gram")).unionAll(b.select(*own, F.explode("k_grams").alias("gram")))
    rarity = every.groupBy(*own, "gram").agg(F.count("*").alias("freq"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        """Rarest grams: ``short`` marks those enough when this text is the smaller of the two."""
        n = F.col(f"{side}_n")
        sized = df.select(*own, side, F.size(f"{side}_grams").alias(f"{side}_n"), F.explode(f"{side}_grams").alias("gram"))
        w = Window.partitionBy(*own, side).orderBy("freq", "gram")
        # a name has tens of grams, so this window is tiny per name
        ranked = sized.join(rarity, [*own, "gram"]).withColumn("_i", F.row_number().over(w))
        ranked = ranked.where(F.col("_i") <= n - F.ceil(n * t / (2 - t) - 1e-9) + 1)
        return ranked.withColumn(f"{side}_short", F.col("_i") <= n - F.ceil(n * t - 1e-9) + 1).drop("_i")

    smaller = (F.col("w_short") & (F.col("w_n") <= F.col("k_n"))) | (F.col("k_short") & (F.col("k_n") <= F.col("w_n")))
    near = F.least("w_n", "k_n") * (2 - t) >= F.greatest("w_n", "k_n") * t - 1e-9
    pairs = prefix(a, "w").join(prefix(b, "k"), [*own, "gram"]).where(smaller & near).select(*own, "w", "k").distinct()
    shared = F.size(F.array_intersect("w_grams", "k_grams"))
    dice = 2.0 * shared / (F.size("w_grams") + F.size("k_grams"))
    scored = pairs.join(a, [*own, "w"]).join(b, [*own, "k"]).withColumn("_dice", dice)
    return scored.where(F.col("_dice") >= t).select(*own, "w", "k", F.round("_dice", 3).alias("similarity"))


def match_names(
    wanted: DataFrame, known: DataFrame, min_similarity: float = 0.55, runners_up: int = 3
) -> DataFrame:
    """Best-named institution, in the expected state if any clears the bar there.

    ``wanted`` (key, name, state), ``known`` (cert, name, state). Normalised
    names are compared once each, however many rows carry them; of equal
    institutions the first counts. Names meet within their state first; only
    those without any match there look elsewhere. Runners-up come from where
    the match was found, and no more than those are built.
    """
    asked = wanted.select("name", "state").distinct().withColumn("w", normal_name(F.col("name")))
    listed = known.groupBy("name", "state").agg(F.min("cert").alias("k_id")).select(
        "k_id", F.col("name").alias("k_name"), F.col("state").alias("k_state"), normal_name(F.col("name")).alias("k")
    )
    order = [F.desc("similarity"), F.asc("k_id")]
    here = listed.withColumn("state", F.col("k_state"))
    close = similar_names(asked, here, min_similarity, ["state"])
    at_home = asked.join(close, ["state", "w"]).drop("w").join(here, ["state", "k"])
    at_home = durable(top_n(at_home, ["name", "state"], order, runners_up + 1).withColumn("same_state", F.lit(True)))
    rest = asked.join(at_home.select("name", "state").distinct(), ["name", "state"], "left_anti")
    first = top_n(listed, ["k"], ["k_id"], runners_up + 1, "_i").drop("_i")
    anywhere = rest.join(similar_names(rest, listed, min_similarity), "w").drop("w").join(first, "k")
    anywhere = top_n(anywhere, ["name", "state"], order, runners_up + 1).withColumn("same_state", F.lit(False))
    best = at_home.unionByName(anywhere)
    others = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.struct("rn", "k_name", "k_state")))),
        lambda r: F.concat(r["k_name"], F.lit("("), r["k_state"], F.lit(")")),
    )
    picked = best.groupBy("name", "state").agg(
        F.min_by(F.struct("k_id", "k_name", "k_state", "similarity", "same_state"), "rn").alias("_b"),
        F.array_join(others, "; ").alias("runners_up"),
    )
    matched = picked.withColumnsRenamed({"name": "_name", "state": "_state"})
    out = wanted.join(matched, (F.col("name") == F.col("_name")) & F.col("state").eqNullSafe(F.col("_state")), "left")
    status = F.when(F.col("_b").isNull(), "not_found").when(~F.col("_b.same_state"), "state_mismatch").otherwise("ok")
    return out.select(
        "key", "name", "state", F.col("_b.k_id").alias("cert"), F.col("_b.k_name").alias("matched_name"),
        F.col("_b.k_state").alias("matched_state"), F.col("_b.similarity").alias("similarity"), "runners_up",
        status.alias("status"),
    )


# ---------------------------------------------------------------- deposits and districts


def locality(deposits: DataFrame, hq: DataFrame) -> DataFrame:
    """Share of deposits in the headquarters state, per bank and year.

    ``deposits`` (ticker, year, state, deposits, cert), ``hq`` (ticker, hq_state).
    Branch rows shrink to one row per state before the yearly step.
    """
    by_state = deposits.groupBy("ticker", "year", "state").agg(
        F.sum("deposits").alias("_d"), F.count("*").alias("_b")
    )
    joined = by_state.join(hq, "ticker")
    home = F.sum(F.when(F.col("state") == F.col("hq_state"), F.col("_d")).otherwise(0.0))
    yearly = joined.groupBy("ticker", "year", "hq_state").agg(
        F.sum("_d").alias("total_deposits"),
        home.alias("hq_deposits"),
        F.count_if(F.col("_d") > 0).alias("n_states"),
        F.sum("_b").alias("n_branches"),
        F.min_by("state", F.struct((-F.col("_d")).alias("neg"), "state")).alias("top_state"),
        F.max("_d").alias("_top"),
    ).where(F.col("total_deposits") > 0)
    charters = deposits.groupBy("ticker", "year").agg(F.countDistinct("cert").alias("n_certs"))
    out = yearly.join(charters, ["ticker", "year"])
    return (
        out.withColumn("locality", F.col("hq_deposits") / F.col("total_deposits"))
        .withColumn("top_state_share", F.col("_top") / F.col("total_deposits"))
        .drop("_top")
    )


def holding_company_by_year(
    rows: DataFrame, seeds: DataFrame, first_year: int, last_year: int
) -> DataFrame:
    """Each bank's holding company per year.

    ``rows`` (ticker, year, hc) are the bank's own charter rows, ``seeds``
    (ticker, cert, seed). A year with rows keeps its most frequent non-blank
    value (ties: smallest) or blank when all are blank. A year without rows
    takes the last non-blank value before it, then the next one, then the seed.
    """
    counted = rows.groupBy("ticker", "year", F.coalesce("hc", F.lit("")).alias("hc")).agg(F.count("*").alias("_c"))
    mode = earliest(
        counted.withColumn("_blank", F.col("hc") == ""), ["ticker", "year"],
        ["_blank", (-F.col("_c")).alias("neg"), "hc"], ["hc"],
    )
    years = seeds.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))))
    spine = years.join(mode, ["ticker", "year"], "left")
    known = F.when(F.col("hc") != "", F.col("hc"))
    by_year = Window.partitionBy("ticker").orderBy("year")
    before = F.last(known, ignorenulls=True).over(by_year.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(by_year.rowsBetween(1, Window.unboundedFollowing))
    filled = F.coalesce(F.col("hc"), before, after, F.col("seed"), F.lit(""))
    return spine.withColumn("_f", filled).select("ticker", "cert", "year", F.col("_f").alias("hc"))


def footprint(deposits: DataFrame, hc_by_year: DataFrame) -> DataFrame:
    """All branch rows of that year's holding company, or of the own charter.

    ``deposits`` (cert, hc, year, state, deposits). A blank holding company, or
    one without rows that year, falls back to the charter. Equal rows collapse.
    """
    branch = deposits.select("year", "hc", F.col("cert").alias("branch_cert"), "state", "deposits")
    via_group = hc_by_year.where(F.col("hc") != "").join(branch, ["year", "hc"])
    covered = via_group.select("ticker", "year").distinct()
    alone = hc_by_year.join(covered, ["ticker", "year"], "left_anti").select("ticker", "cert", "year")
    own = alone.join(
        branch.withColumnRenamed("branch_cert", "cert"), ["year", "cert"]
    ).withColumn("branch_cert", F.col("cert"))
    columns = ["ticker", "year", "state", "deposits", "branch_cert", "hc"]
    return via_group.select(*columns).unionByName(own.select(*columns)).dropDuplicates()


def locality_summary(table: DataFrame, n_years: int) -> DataFrame:
    """First and last vintage, mean and counts per bank, with the fatal flags."""
    return table.groupBy("ticker").agg(
        F.min_by("hq_state", "year").alias("hq"),
        F.avg("locality").alias("loc_mean"),
        F.min_by("locality", "year").alias("loc_first"),
        F.max_by("locality", "year").alias("loc_last"),
        F.max_by("n_states", "year").alias("states_last"),
        F.max("n_certs").alias("max_certs"),
        F.min_by("top_state", "year").alias("top_first"),
        F.max_by("top_state", "year").alias("top_last"),
        F.count("*").alias("vintages"),
        F.count_if((F.col("locality") < 0) | (F.col("locality") > 1)).alias("n_outside"),
        F.count_if(F.col("hq_deposits") <= 0).alias("n_zero_hq"),
        (F.count("*") < n_years).alias("incomplete"),
    )


def locality_gates(summary: DataFrame, expected: DataFrame) -> list[Check]:
    """Stop on banks without home deposits, missing vintages or missing altogether."""
    zero, partial, outside = summary.agg(
        F.sum("n_zero_hq"), F.count_if("incomplete"), F.sum("n_outside")
    ).first()
    failed = expected.join(summary, "ticker", "left_anti").count()
    return [
        gate("no_bank_year_without_home_deposits", not zero, zero),
        gate("locality_within_unit_interval", not outside, outside),
        gate("all_vintages_present", partial == 0, partial),
        gate("all_banks_present", failed == 0, failed),
    ]


def latest_vintage(rows: DataFrame, key: str, year: str, keep: Sequence[str]) -> DataFrame:
    """Newest row per charter."""
    return latest(rows, [key], [year, *keep], [year, *keep])


def compare_assignment(hand: DataFrame, official: DataFrame, key: str, group: str) -> DataFrame:
    """Hand map against the authoritative one; NULL ``changed`` where the latter has no answer."""
    out = hand.withColumnRenamed(group, f"hand_{group}").join(
        official.withColumnRenamed(group, f"official_{group}"), key, "left"
    )
    differs = ~F.col(f"hand_{group}").eqNullSafe(F.col(f"official_{group}"))
    return out.withColumn("changed", F.when(F.col(f"official_{group}").isNotNull(), differs))


def emptied_groups(compared: DataFrame, group: str) -> DataFrame:
    """Groups of the hand map with no member after reassignment."""
    had = compared.select(F.col(f"hand_{group}").alias(group)).where(F.col(group).isNotNull()).distinct()
    has = compared.select(F.col(f"official_{group}").alias(group)).distinct()
    return had.join(has, group, "left_anti")


def map_tickers(rows: DataFrame, mapping: DataFrame, key: str = "cusip") -> DataFrame:
    """Dimension left join; unmapped rows keep a NULL ticker."""
    return rows.join(mapping, key, "left")


def apply_renames(rows: DataFrame, renames: dict[str, str], dropped: Sequence[str], key: str = "ticker") -> DataFrame:
    """Drop rejected series and give accepted successors their canonical name."""
    out = rows.where(~F.col(key).isin(list(dropped))) if dropped else rows
    if not renames:
        return out
    table = F.create_map(*[F.lit(v) for pair in renames.items() for v in pair])
    return out.withColumn(key, F.coalesce(F.try_element_at(table, F.col(key)), F.col(key)))


def source_waterfall(wanted: DataFrame, original: DataFrame, successor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Original series, else the successor's under a marked name, else not recovered.

    ``wanted`` (ticker, successor); the sources have (ticker, date, close).
    Returns the recovered rows and one report row per wanted ticker.
    """
    first = wanted.join(original, "ticker").withColumn("status", F.lit("recovered"))
    alt = successor.withColumnRenamed("ticker", "successor")
    second = (
        wanted.join(original.select("ticker").distinct(), "ticker", "left_anti").join(alt, "successor")
        .withColumn("status", F.lit("successor_only"))
    )
    rows = first.unionByName(second)
    spans = rows.groupBy("ticker", "status").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    report = wanted.join(spans, "ticker", "left").select(
        "ticker", F.coalesce("status", F.lit("not_recovered")).alias("status"),
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "first", "last",
        F.when(F.col("status") == "successor_only", F.col("successor")).alias("successor"),
    )
    marked = F.concat("successor", F.lit("_SUCCESSOR_OF_"), "ticker")
    series = rows.withColumn("ticker", F.when(F.col("status") == "successor_only", marked).otherwise(F.col("ticker")))
    return series.select("ticker", "date", "close"), report
