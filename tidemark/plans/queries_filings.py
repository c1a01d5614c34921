"""Filing queries: EPS, shares, known_at resolution, tag diagnostics, surprise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import EPS_TAGS, EPS_TAGS_EXPANDED, UniverseConfig
from tidemark.operators import eventstudy as es
from tidemark.operators import filings as fl
from tidemark.operators import reports
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text


def _eps(spark, sf, tags=EPS_TAGS):
    return fl.extract_eps(b.sub(spark, sf), b.num(spark, sf), tags)


def _shares(spark, sf):
    return fl.extract_shares(b.sub(spark, sf), b.num_shares(spark, sf))


def _known(spark, sf):
    return fl.resolve_known_at(b.sub(spark, sf), b.item202(spark, sf))


@query(
    "W7_extract_eps",
    f"WITH {q.EPS} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, eps_value, tag_used, form, CAST(filed AS VARCHAR) AS filed, adsh FROM eps",
)
def w7(spark, sf):
    return _eps(spark, sf).select("cik", text("period_end"), "eps_value", "tag_used", "form", text("filed"), "adsh")


@query(
    "J17_facts_filings",
    f"WITH {q.SUB}, {q.NUM} SELECT form, tag, count(*) AS n, sum(value) AS total FROM num JOIN sub USING (adsh) GROUP BY 1, 2",
)
def j17(spark, sf):
    joined = b.num(spark, sf).join(b.sub(spark, sf).select("adsh", "form"), "adsh")
    return joined.groupBy("form", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "A21_shares_outstanding",
    f"""WITH {q.SHARES_OUT} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, shares_outstanding, tag_used, form, CAST(filed AS VARCHAR) AS filed, adsh, is_own_period FROM shares""",
)
def a21(spark, sf):
    return _shares(spark, sf).select(
        "cik", text("period_end"), "shares_outstanding", "tag_used", "form", text("filed"), "adsh", "is_own_period"
    )


@query(
    "J18_chosen_tag",
    f"""WITH {q.SHARES}, f AS (SELECT DISTINCT adsh, tag, ddate, coreg, value FROM num
      WHERE qtrs = 0 AND tag IN ('CommonStockSharesOutstanding', 'EntityCommonStockSharesOutstanding'))
    SELECT adsh, ddate, tag, n FROM (SELECT adsh, ddate, tag, count(*) AS n FROM f GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY adsh, ddate ORDER BY tag) = 1""",
)
def j18(spark, sf):
    from tidemark.config import SHARES_TAGS
    from tidemark.operators.ordered import earliest

    facts = b.num_shares(spark, sf).where(F.col("tag").isin(list(SHARES_TAGS)) & (F.col("qtrs") == 0))
    per = facts.select("adsh", "tag", "ddate", "coreg", "value").distinct().groupBy("adsh", "ddate", "tag").agg(F.count("*").alias("n"))
    ranked = per.withColumn("_rank", F.when(F.col("tag") == SHARES_TAGS[0], 0).otherwise(1))
    return earliest(ranked, ["adsh", "ddate"], ["_rank"], ["tag", "n"])


@query(
    "W9_echo_collapse",
    f"WITH {q.SHARES_OUT} SELECT is_own_period, count(*) AS n, count(DISTINCT cik) AS n_ciks FROM shares GROUP BY 1",
)
def w9(spark, sf):
    return _shares(spark, sf).groupBy("is_own_period").agg(F.count("*").alias("n"), F.countDistinct("cik").alias("n_ciks"))


_JUMPS = f"""{q.SHARES_OUT}, nb AS (SELECT *, nullif(lag(shares_outstanding) OVER w, 0) AS p, nullif(lead(shares_outstanding) OVER w, 0) AS n
  FROM shares WINDOW w AS (PARTITION BY cik ORDER BY period_end)),
jumps AS (SELECT *, coalesce(shares_outstanding / p >= 5 OR shares_outstanding / p <= 1.0 / 5, false)
  OR coalesce(shares_outstanding / n >= 5 OR shares_outstanding / n <= 1.0 / 5, false) AS implausible_jump FROM nb)"""


@query(
    "W10_jump_flag",
    f"WITH {_JUMPS} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, shares_outstanding, implausible_jump FROM jumps",
)
def w10(spark, sf):
    return fl.flag_jumps(_shares(spark, sf)).select("cik", text("period_end"), "shares_outstanding", "implausible_jump")


@query(
    "W6_standardized_surprise",
    f"""WITH {q.EPS}, {q.sue('eps')} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, n_quarters, n_diffs, seasonal_diff, round(sue, 6) + 0 AS sue, sue_reason FROM sue""",
)
def w6(spark, sf):
    out = es.standardized_surprise(_eps(spark, sf))
    return out.select("cik", text("period_end"), "n_quarters", "n_diffs", "seasonal_diff", rnd("sue"), "sue_reason")


@query(
    "P6_periodic_filings",
    f"WITH {q.SUB} SELECT adsh, cik, form, period, filed FROM sub WHERE form IN ('10-K', '10-Q', '10-KT', '10-QT')",
)
def p6(spark, sf):
    return fl.periodic_filings(b.sub(spark, sf)).select("adsh", "cik", "form", "period", "filed")


@query(
    "P7_cik_whitelist",
    f"""WITH {q.SUB} SELECT adsh, cik FROM sub WHERE form IN ('10-K', '10-Q') AND CAST(cik AS BIGINT) IN
      (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def p7(spark, sf):
    wanted = b.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("cik"))
    return fl.only_ciks(fl.periodic_filings(b.sub(spark, sf)), wanted).select("adsh", "cik")


@query(
    "W8_first_filing",
    f"WITH {q.KNOWN} SELECT cik, period, form, adsh, filed, n_periodic AS n_periodic_filings FROM firsts",
)
def w8(spark, sf):
    out = fl.first_filings(fl.periodic_filings(b.sub(spark, sf)))
    return out.select("cik", "period", "form", "adsh", "filed", "n_periodic_filings")


@query(
    "A26_filings_per_period",
    f"WITH {q.KNOWN} SELECT n_periodic AS n_periodic_filings, count(*) AS n FROM firsts GROUP BY 1",
)
def a26(spark, sf):
    return fl.first_filings(fl.periodic_filings(b.sub(spark, sf))).groupBy("n_periodic_filings").agg(F.count("*").alias("n"))


@query(
    "A25_amendment_only",
    f"""WITH {q.SUB} SELECT cik, period FROM sub WHERE form IN ('10-K', '10-Q', '10-K/A', '10-Q/A') GROUP BY 1, 2
    HAVING NOT bool_or(form IN ('10-K', '10-Q'))""",
)
def a25(spark, sf):
    return fl.amendment_only_periods(b.sub(spark, sf))


@query(
    "O6_base_and_amended",
    f"WITH {q.SUB} SELECT form, count(*) AS n FROM sub WHERE form IN ('10-K', '10-Q', '10-K/A', '10-Q/A') GROUP BY 1",
)
def o6(spark, sf):
    from tidemark.config import PERIODIC_FORMS

    forms = [*PERIODIC_FORMS, *(f"{f}/A" for f in PERIODIC_FORMS)]
    return b.sub(spark, sf).where(F.col("form").isin(forms)).groupBy("form").agg(F.count("*").alias("n"))


@query(
    "P8_choose_known_at",
    f"""WITH {q.SUB}, {q.ITEM202}, p AS (SELECT s.adsh, CAST(s.filed_day AS TIMESTAMP) AS f, i.a FROM sub s
      LEFT JOIN (SELECT cik, max(acceptance_datetime) AS a FROM item202 GROUP BY 1) i ON i.cik = s.cik),
    g AS (SELECT *, floor(epoch(f - a) / 86400) AS gap FROM p)
    SELECT adsh, CAST(CASE WHEN gap BETWEEN 0 AND 5 THEN a ELSE f END AS VARCHAR) AS known_at,
      CASE WHEN gap BETWEEN 0 AND 5 THEN '8k_item202' ELSE '10q_fallback' END AS event_source FROM g""",
)
def p8(spark, sf):
    from tidemark.operators.filings import pad_cik

    last = b.item202(spark, sf).groupBy(pad_cik(F.col("cik")).alias("cik")).agg(F.max("acceptance_datetime").alias("a"))
    rows = b.sub(spark, sf).withColumn("cik", pad_cik(F.col("cik"))).join(last, "cik", "left")
    known, source = es.choose_known_at(es.filed_instant(F.col("filed")), F.col("a"))
    return rows.select("adsh", text(known, "known_at"), source.alias("event_source"))


@query(
    "J20_latest_announcement",
    f"WITH {q.KNOWN} SELECT f.cik, f.period, CAST(s.announced_at AS VARCHAR) AS announced_at FROM firsts f LEFT JOIN said s USING (cik, period)",
)
def j20(spark, sf):
    chosen = fl.acceptance_or_filed(fl.first_filings(fl.periodic_filings(b.sub(spark, sf))), None)
    return fl.latest_announcement(chosen, b.item202(spark, sf)).select("cik", "period", text("announced_at"))


@query(
    "J21_known_at_panel",
    f"""WITH {q.KNOWN} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, CAST(known_at AS VARCHAR) AS known_at, event_source,
      form AS disclosure_form, CAST(adsh AS VARCHAR) AS disclosure_adsh, n_periodic AS n_periodic_filings_for_period FROM known""",
)
def j21(spark, sf):
    return _known(spark, sf).select(
        "cik", text("period_end"), text("known_at"), "event_source", "disclosure_form", text("disclosure_adsh"),
        "n_periodic_filings_for_period",
    )


@query(
    "J19_acceptance_lookup",
    f"""WITH {q.KNOWN}, acc AS (SELECT o_orderkey AS adsh, o_orderdate + INTERVAL 21 HOUR AS t FROM orders WHERE o_orderstatus = 'F')
    SELECT f.cik, f.period, CAST(coalesce(t, CAST(filed_day AS TIMESTAMP)) AS VARCHAR) AS disclosed_at,
      CASE WHEN t IS NULL THEN 'sub_txt_filed_date:legacy_utc_midnight' ELSE 'submissions_acceptance_datetime' END AS disclosure_source
    FROM firsts f LEFT JOIN acc USING (adsh)""",
)
def j19(spark, sf):
    acc = b.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession_number"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(21))).alias("acceptance_datetime"),
    )
    out = fl.acceptance_or_filed(fl.first_filings(fl.periodic_filings(b.sub(spark, sf))), acc)
    return out.select("cik", "period", text("disclosed_at"), "disclosure_source")


@query(
    "P9_filed_end_of_day",
    f"""WITH {q.SUB} SELECT adsh, CAST(((CAST(filed_day AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS VARCHAR) AS filed_at FROM sub""".replace(
        "INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"
    ),
)
def p9(spark, sf):
    at = es.filed_instant(F.col("filed"), "eastern_end_of_day")
    return b.sub(spark, sf).select("adsh", text(at, "filed_at"))


# ---------------------------------------------------------------- tags

_CATEGORY = """CASE WHEN tag = 'EarningsPerShareDiluted' THEN 'diluted_only' WHEN tag = 'EarningsPerShareBasic' THEN 'basic_only'
  ELSE 'combined_basic_and_diluted' END"""
_COUNTS = f"""{q.NUM}, counts AS (SELECT tag, lower(split_part(version, '/', 1)) AS namespace, count(*) AS n_facts,
  tag IN ('EarningsPerShareDiluted', 'EarningsPerShareBasicAndDiluted') AS accepted, {_CATEGORY} AS category FROM num GROUP BY 1, 2)"""


def _counts(spark, sf):
    return fl.tag_counts(b.num(spark, sf))


@query(
    "A22_custom_tag_rate",
    f"""WITH {q.NUM} SELECT count(*) AS n_eps_like, count(*) FILTER (tag <> 'EarningsPerShareBasic') AS n_standard,
      count(*) FILTER (tag = 'EarningsPerShareBasic') AS n_custom, round(avg(CASE WHEN tag = 'EarningsPerShareBasic' THEN 1.0 ELSE 0 END), 8) AS custom_rate FROM num""",
)
def a22(spark, sf):
    return fl.custom_tag_rate(b.num(spark, sf)).withColumn("custom_rate", rnd("custom_rate", 8))


@query("A23_tag_counts", f"WITH {_COUNTS} SELECT tag, namespace, n_facts, accepted, category FROM counts")
def a23(spark, sf):
    return _counts(spark, sf)


@query(
    "A23_tag_rates",
    f"""WITH {_COUNTS}, r AS (SELECT CAST(sum(n_facts) AS BIGINT) AS n, sum(n_facts) FILTER (NOT accepted) / sum(n_facts) AS a,
      sum(n_facts) FILTER (namespace <> 'us-gaap') / sum(n_facts) AS b FROM counts)
    SELECT n AS n_eps_like, round(a, 8) AS rate_by_name, round(b, 8) AS rate_by_namespace, abs(a - b) <= 0.05 AS agree_within_5pct FROM r""",
)
def a23_rates(spark, sf):
    return fl.tag_rates(_counts(spark, sf)).select("n_eps_like", rnd("rate_by_name", 8), rnd("rate_by_namespace", 8), "agree_within_5pct")


@query("A23_custom_examples", f"WITH {_COUNTS} SELECT tag, namespace FROM counts WHERE NOT accepted ORDER BY 1, 2 LIMIT 10")
def a23_examples(spark, sf):
    return fl.custom_examples(_counts(spark, sf))


@query("O2_top_tags", f"WITH {_COUNTS} SELECT tag, namespace, n_facts FROM counts ORDER BY n_facts DESC, tag, namespace LIMIT 4")
def o2(spark, sf):
    return fl.top_tags(_counts(spark, sf), 4).select("tag", "namespace", "n_facts")


@query(
    "A24_tag_classification",
    f"""WITH {_COUNTS}, top AS (SELECT * FROM counts ORDER BY n_facts DESC, tag, namespace LIMIT 4)
    SELECT category, CAST(sum(n_facts) AS BIGINT) AS n_facts, round(sum(n_facts) / sum(sum(n_facts)) OVER (), 8) AS share,
      round(sum(sum(n_facts)) OVER () / (SELECT sum(n_facts) FROM counts), 8) AS coverage FROM top GROUP BY 1""",
)
def a24(spark, sf):
    counts = _counts(spark, sf)
    return fl.tag_classification(counts, fl.top_tags(counts, 4)).select("category", "n_facts", rnd("share", 8), rnd("coverage", 8))


@query(
    "P11_classify_tag",
    """SELECT n_custkey, CASE WHEN s = 0 THEN 'diluted_only' WHEN s = 1 THEN 'basic_only' WHEN s = 2 THEN 'combined_basic_and_diluted'
      WHEN s = 3 THEN 'pro_forma' WHEN s = 4 THEN 'spac_redemption_pattern' WHEN s = 5 THEN 'share_count_or_exclusion_not_an_eps_value'
      ELSE 'other_eps_related' END AS category FROM (SELECT o_orderkey AS n_custkey, o_custkey % 7 AS s FROM orders)""",
)
def p11(spark, sf):
    names = [
        "EarningsPerShareDiluted", "earnings_per_share_basic", "EarningsPerShare-Basic And Diluted", "EarningsPerShareProForma",
        "EarningsPerShareSubjectToPossibleRedemption", "AntidilutiveSecuritiesExcludedEarningsPerShare", "EarningsPerShareOther",
    ]
    tag = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("o_custkey", F.lit(7)) + 1).cast("int"))
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n_custkey"), fl.classify_tag(tag).alias("category"))


_BOTH = f"""{q.SUB}, {q.NUM}, {q.eps(list(EPS_TAGS), 'e1')}, {q.eps(list(EPS_TAGS_EXPANDED), 'e2')}, {q.sue('e1', 's1')}, {q.sue('e2', 's2')},
l1 AS (SELECT cik, count(*) AS n, arg_max(sue, period_end) FILTER (true) AS x, max(period_end) AS pe FROM s1 GROUP BY 1),
l2 AS (SELECT cik, count(*) AS n, max(period_end) AS pe FROM s2 GROUP BY 1),
f1 AS (SELECT l1.cik, l1.n, s1.sue, s1.sue_reason FROM l1 JOIN s1 ON s1.cik = l1.cik AND s1.period_end = l1.pe),
f2 AS (SELECT l2.cik, l2.n, s2.sue, s2.sue_reason FROM l2 JOIN s2 ON s2.cik = l2.cik AND s2.period_end = l2.pe)"""


@query(
    "A38_tag_list_comparison",
    f"""WITH {_BOTH} SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, coalesce(f1.n, 0) AS base_n_quarters, coalesce(f2.n, 0) AS expanded_n_quarters,
      round(f1.sue, 6) + 0 AS base_sue, round(f2.sue, 6) + 0 AS expanded_sue, CASE WHEN f1.n IS NULL THEN 'no_eps_records_for_cik' ELSE f1.sue_reason END AS base_reason,
      f1.sue IS NULL AND f2.sue IS NOT NULL AS newly_computable
    FROM customer LEFT JOIN f1 ON f1.cik = lpad(CAST(c_custkey AS VARCHAR), 10, '0') LEFT JOIN f2 ON f2.cik = lpad(CAST(c_custkey AS VARCHAR), 10, '0')""",
)
def a38(spark, sf):
    ciks = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("cik"))
    out = fl.compare_tag_lists(b.sub(spark, sf), b.num(spark, sf), ciks)
    return out.select(
        "cik", "base_n_quarters", "expanded_n_quarters", rnd("base_sue"), rnd("expanded_sue"), "base_reason", "newly_computable"
    )


_OUTCOME = f"""{q.KNOWN}, {q.NUM}, {q.eps(list(EPS_TAGS))}, {q.sue('eps')},
newest AS (SELECT * FROM sue QUALIFY row_number() OVER (PARTITION BY cik ORDER BY period_end DESC) = 1),
outcome AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, n.period_end, k.known_at, n.sue,
  CASE WHEN n.period_end IS NULL THEN 'no_eps_records_for_cik' WHEN n.sue_reason IS NOT NULL THEN n.sue_reason
       WHEN k.known_at IS NULL THEN 'no_10q_row_for_period_end' END AS reason
  FROM customer LEFT JOIN newest n ON n.cik = lpad(CAST(c_custkey AS VARCHAR), 10, '0')
  LEFT JOIN known k ON k.cik = n.cik AND k.period_end = n.period_end)"""


def _outcomes(spark, sf):
    attempts = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("cik"))
    return fl.attempt_outcomes(attempts, _eps(spark, sf), _known(spark, sf))


@query(
    "G6_attempt_outcomes",
    f"WITH {_OUTCOME} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, CAST(known_at AS VARCHAR) AS known_at, round(sue, 6) + 0 AS sue, reason FROM outcome",
)
def g6(spark, sf):
    return _outcomes(spark, sf).select("cik", text("period_end"), text("known_at"), rnd("sue"), "reason")


@query(
    "A34_probe_report",
    f"""WITH {_OUTCOME} SELECT (SELECT count(*) FROM customer) AS ciks_attempted, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS ciks_ticker_resolved,
      (SELECT count(*) FROM sub) AS filings_retrieved, (SELECT count(*) FROM item202) AS item202_filings, (SELECT count(*) FROM eps) AS eps_records,
      (SELECT round(avg(CASE WHEN tag <> 'EarningsPerShareBasic' THEN 1.0 ELSE 0 END), 8) FROM num) AS standard_tag_rate,
      (SELECT count(*) FROM outcome WHERE reason IS NULL) AS events_identified, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS resolution_failures""",
)
def a34(spark, sf):
    c = b.table(spark, sf, "customer")
    cik = fl.pad_cik(F.col("c_custkey")).alias("cik")
    item = b.item202(spark, sf).withColumn("cik", fl.pad_cik(F.col("cik")))
    out = reports.probe_report(
        c.select(cik), c.select(cik, F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("ticker")),
        b.sub(spark, sf), item, _eps(spark, sf), fl.custom_tag_rate(b.num(spark, sf)), _outcomes(spark, sf),
    )
    return out.drop("custom_tag_rate").withColumn("standard_tag_rate", rnd("standard_tag_rate", 8))


# ---------------------------------------------------------------- market-cap candidates

_CANDIDATES = f"""{_JUMPS}, {q.ITEM202}, firsts AS (
  SELECT cik, period, period_day, filed_day, adsh FROM sub WHERE form IN ('10-K', '10-Q', '10-KT', '10-QT')
  QUALIFY row_number() OVER (PARTITION BY cik, period ORDER BY filed, adsh) = 1
), said AS (
  SELECT f.cik, f.period, max(i.acceptance_datetime) AS a FROM firsts f JOIN item202 i ON i.cik = f.cik
    AND i.acceptance_datetime <= CAST(f.filed_day AS TIMESTAMP) AND i.acceptance_datetime >= CAST(f.filed_day AS TIMESTAMP) - INTERVAL 5 DAY GROUP BY 1, 2
), known AS (
  SELECT f.cik, f.period_day AS period_end, coalesce(a, CAST(filed_day AS TIMESTAMP)) AS known_at,
    CASE WHEN a IS NULL THEN '10q_fallback' ELSE '8k_item202' END AS event_source FROM firsts f LEFT JOIN said USING (cik, period)
), px AS (
  SELECT c_mktsegment || c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close, count(*) AS volume
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
), adv AS (
  SELECT ticker, date, CASE WHEN count(*) OVER w = 20 THEN quantile_cont(close * volume, 0.5) OVER w END AS adv
  FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), rows0 AS (
  SELECT s.cik, s.period_end, s.shares_outstanding, s.implausible_jump, k.known_at, k.event_source, c_mktsegment || c_nationkey AS ticker,
    CASE WHEN c_nationkey < 20 THEN 'NYSE' WHEN c_nationkey < 23 THEN 'OTC' END AS listing,
    CAST((k.known_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day,
    hour((k.known_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') >= 16 AS printed
  FROM jumps s LEFT JOIN known k USING (cik, period_end) JOIN customer ON lpad(CAST(c_custkey AS VARCHAR), 10, '0') = s.cik
), rows1 AS (
  SELECT r.*, p.close AS last_close FROM (SELECT *, CASE WHEN printed THEN day ELSE day - 1 END AS lim FROM rows0) r
  ASOF LEFT JOIN px p ON p.ticker = r.ticker AND r.lim >= p.date
), rows2 AS (
  SELECT r.*, p.close AS entry_close FROM (SELECT *, CASE WHEN printed THEN day + 1 ELSE day END AS lim2 FROM rows1) r
  ASOF LEFT JOIN px p ON p.ticker = r.ticker AND r.lim2 <= p.date
), rows3 AS (
  SELECT r.*, a.adv FROM rows2 r ASOF LEFT JOIN adv a ON a.ticker = r.ticker AND r.day > a.date
), cand AS (
  SELECT *, shares_outstanding * last_close AS cap, shares_outstanding * entry_close AS ecap FROM rows3
), judged AS (
  SELECT *, CASE WHEN listing <> 'NYSE' THEN 'listing_not_allowed' WHEN cap < 5000000 THEN 'market_cap_below_min' WHEN cap > 30000000 THEN 'market_cap_above_max' END AS r1,
    CASE WHEN listing <> 'NYSE' THEN 'listing_not_allowed' WHEN ecap < 5000000 THEN 'market_cap_below_min' WHEN ecap > 30000000 THEN 'market_cap_above_max' END AS r2,
    cap IS NOT NULL AND listing IS NOT NULL AS j1, ecap IS NOT NULL AND listing IS NOT NULL AS j2 FROM cand
), final AS (
  SELECT *, CASE WHEN j1 THEN r1 IS NULL END AS qualifies, coalesce(j1 AND j2 AND ((r1 IS NULL) <> (r2 IS NULL)), false) AS qualification_differs,
    CASE WHEN j1 THEN r1 WHEN known_at IS NULL THEN 'no_periodic_filing_for_period_end_so_no_known_at' ELSE 'market_cap_or_listing_unavailable' END AS disqualification_reason
  FROM judged)"""


def _candidates(spark, sf):
    c = b.table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    listings = c.select(
        fl.pad_cik(F.col("c_custkey")).alias("cik"), F.concat("c_mktsegment", nation.cast("string")).alias("ticker"), F.lit("").alias("sic_code"),
        F.when(nation < 20, "NYSE").when(nation < 23, "OTC").alias("listing_exchange"),
    )
    o = b.table(spark, sf, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.concat("c_mktsegment", nation.cast("string")).alias("ticker")), "o_custkey")
    prices = o.groupBy("ticker", F.to_date("o_orderdate").alias("date")).agg(
        F.max("o_totalprice").alias("close"), F.count("*").alias("volume")
    )
    shares = fl.flag_jumps(_shares(spark, sf))
    return es.market_cap_candidates(shares, _known(spark, sf), prices, listings, UniverseConfig(5e6, 3e7))


@query(
    "G5_market_cap_candidates",
    f"""WITH {_CANDIDATES} SELECT cik, CAST(period_end AS VARCHAR) AS period_end, CAST(known_at AS VARCHAR) AS known_at, event_source, round(cap, 2) AS market_cap,
      round(ecap, 2) AS entry_market_cap, round(adv, 4) AS adv_20d, implausible_jump, qualifies, qualification_differs, disqualification_reason FROM final""",
)
def g5(spark, sf):
    return _candidates(spark, sf).select(
        "cik", text("period_end"), text("known_at"), "event_source", rnd("market_cap", 2), rnd("entry_market_cap", 2),
        rnd("adv_20d", 4), "implausible_jump", "qualifies", "qualification_differs", "disqualification_reason",
    )


@query(
    "A45_probe_counters",
    f"""WITH {_CANDIDATES} SELECT count(*) AS n_rows, count(*) FILTER (known_at IS NULL) AS n_unresolved, count(cap) AS n_usable, count(*) FILTER (qualifies) AS n_qualifying,
      count(*) FILTER (implausible_jump) AS n_jump_flag, count(*) FILTER (qualification_differs) AS n_differs FROM final""",
)
def a45(spark, sf):
    return reports.probe_counters(_candidates(spark, sf)).drop("n_low_trading_days")


@query(
    "A45_source_breakdown",
    f"WITH {q.KNOWN} SELECT event_source, count(*) AS n_rows FROM known GROUP BY 1",
)
def a45_source(spark, sf):
    return reports.breakdown(_known(spark, sf), "event_source")


@query(
    "G7_period_diagnostics",
    f"""WITH {q.SUB} SELECT cik, adsh, form, period, filed, period = 19970630 AS same_period FROM sub
    WHERE cik = (SELECT min(cik) FROM sub WHERE period = 19970630) AND abs(period - 19970630) <= 10000""",
)
def g7(spark, sf):
    cik = b.sub(spark, sf).where(F.col("period") == 19970630).agg(F.min(fl.pad_cik(F.col("cik")))).first()[0]
    return fl.period_diagnostics(b.sub(spark, sf), cik or "", 19970630)
