"""The dataflows' input tables, derived by Spark from the given parquet tables.

Every frame here is a projection or aggregation of whole given tables, so the work of a
query grows with them.  ``SQL`` holds the same derivations for the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import text
from accountloom.sources.filings import number_documents

YEARS = [1996, 1997, 1998, 1999, 2000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index: Column) -> Column:
    """Constant list by zero-based index."""
    return F.element_at(text.constant_array(values), (index + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# -- filing index: one record per order, one entity per customer --------------------

def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    lei = F.concat(F.lit("C"), "o_custkey")
    country = pick(spec.EURO_AREA, F.col("c_nationkey") % 20)
    day = F.to_date("o_orderdate")
    index = F.when(k % 11 == 0, F.lit("malformed")).otherwise(
        F.concat_ws("-", lei, day.cast("string"), F.lit("ESEF"), country, (k % 5).cast("string")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        lei.alias("lei"), F.when(k % 7 == 0, "").otherwise(F.col("c_name")).alias("name"),
        country.alias("country"), day.alias("reporting_date"), index.alias("filing_index"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("error_count"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("u"), k)).alias("json_url"),
        k.alias("ord"))


FILINGS_SQL = f"""
filings AS (
  SELECT 'C' || o_custkey AS lei, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_name END AS name,
         {sql_list(spec.EURO_AREA)}[c_nationkey % 20 + 1] AS country,
         o_orderdate::DATE AS reporting_date, year(o_orderdate)::INT AS year,
         CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_orderkey % 5 END AS entry,
         substr(o_orderpriority, 1, 1)::INT AS error_count,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'u' || o_orderkey END AS json_url,
         o_orderkey AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey),
per_year AS (
  SELECT *, min(ord) OVER (PARTITION BY lei, year) AS first_ord FROM filings
  QUALIFY row_number() OVER (PARTITION BY lei, year ORDER BY entry DESC, ord) = 1),
monthly AS (
  SELECT lei, month(reporting_date)::INT AS m, count(*) AS n, min(first_ord) AS seen FROM per_year GROUP BY ALL),
cov AS (
  SELECT p.lei, coalesce(arg_min(name, first_ord) FILTER (name <> ''), '') AS name,
         arg_min(country, first_ord) AS country, list_sort(list(year)) AS years,
         (SELECT m FROM monthly WHERE monthly.lei = p.lei ORDER BY n DESC, seen LIMIT 1) AS fiscal_month,
         count(DISTINCT month(reporting_date)) <= 1 AS consistent_year_end,
         sum(error_count)::BIGINT AS error_count
  FROM per_year p GROUP BY p.lei),
done AS (
  SELECT *, len(list_filter({YEARS}, lambda y: list_contains(years, y)))::INT AS years_held,
         list_filter({YEARS}, lambda y: NOT list_contains(years, y)) AS missing FROM cov)
"""

# -- filing documents: two facts per line item, one filing per supplier and year -----

# Names the derived facts carry: listed elements, company extensions and decoys.
CONCEPTS = (
    ("annual", "ifrs-full:Revenue"), ("annual", "ifrs-full:RevenueFromContractsWithCustomers"),
    ("annual", "ifrs-full:ProfitLossFromOperatingActivities"), ("annual", "acme:EarningsBeforeInterestAndTaxesEbit"),
    ("annual", "ifrs-full:DepreciationAndAmortisationExpense"), ("annual", "ifrs-full:AdjustmentsForDepreciationExpense"),
    ("annual", "ifrs-full:AdjustmentsForAmortisationExpense"), ("annual", "acme:AmortissementsDepreciationsEtProvisions"),
    ("annual", "acme:DepreciationAccordingToPlan"), ("annual", "ifrs-full:InterestExpense"),
    ("annual", "ifrs-full:FinanceCosts"), ("annual", "acme:GrossInterestExpenseOnLoans"),
    ("annual", "acme:InterestIncomeOther"), ("annual", "ifrs-full:ProfitLossBeforeTax"),
    ("annual", "ifrs-full:IncomeTaxExpenseContinuingOperations"), ("annual", "ifrs-full:IncomeTaxExpenseBenefit"),
    ("annual", "ifrs-full:ProfitLossAttributableToOwnersOfParent"), ("annual", "ifrs-full:ProfitLoss"),
    ("annual", "ifrs-full:ProfitLossAttributableToNoncontrollingInterests"),
    ("annual", "ifrs-full:PurchaseOfPropertyPlantAndEquipment"),
    ("annual", "ifrs-full:PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities"),
    ("annual", "acme:InvestmentsInPropertyPlantAndEquipmentAndOther"),
    ("annual", "ifrs-full:ProceedsFromSalesOfPropertyPlantAndEquipment"),
    ("annual", "ifrs-full:CashFlowsUsedInObtainingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities"),
    ("annual", "ifrs-full:CashFlowsFromLosingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities"),
    ("annual", "ifrs-full:FinanceIncome"),
    ("annual", "ifrs-full:ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod"),
    ("annual", "ifrs-full:BasicEarningsLossPerShare"), ("annual", "ifrs-full:DilutedEarningsLossPerShare"),
    ("instant", "ifrs-full:CashAndCashEquivalents"), ("instant", "Cash"),
    ("instant", "ifrs-full:CurrentAssets"), ("instant", "ifrs-full:CurrentLiabilities"),
    ("instant", "ifrs-full:ShorttermBorrowings"), ("instant", "acme:CurrentLeaseLiabilities"),
    ("instant", "ifrs-full:NoncurrentPortionOfNoncurrentBorrowings"), ("instant", "ifrs-full:LongtermBorrowings"),
    ("instant", "ifrs-full:NoncurrentLeaseLiabilities"), ("instant", "ifrs-full:NoncontrollingInterests"),
    ("instant", "ifrs-full:Equity"), ("instant", "ifrs-full:Assets"), ("instant", "ifrs-full:NoncurrentAssets"),
    ("instant", "ifrs-full:NoncurrentLiabilities"), ("instant", "ifrs-full:Liabilities"),
    ("instant", "ifrs-full:InvestmentProperty"), ("instant", "ifrs-full:Inventories"),
)
N_CONCEPTS = len(CONCEPTS)
FACT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
DEALT = ["lei", "fiscal_year", "piece"]
"""What documents are partitioned by; see :func:`with_pieces`."""


DOCUMENTS_PER_TASK = 250_000
"""About how many documents a task builds, however many a setting for shuffles would give it."""


def with_pieces(rows: DataFrame) -> DataFrame:
    """Adds the piece of its filing a line item belongs to, ascending in the order of facts.

    A filing is one piece, unless it has more documents than a task builds: it is then cut by order keys.
    Such filings are at most as many as there are tasks, so they are broadcast.
    """
    filing, key, n = ["l_suppkey", "fiscal_year"], F.col("l_orderkey"), F.col("n")
    large = rows.groupBy(*filing).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last")) \
        .where(n > DOCUMENTS_PER_TASK).select(*filing, "first", F.ceil(
            (F.col("last") - F.col("first") + 1) / F.ceil(n / DOCUMENTS_PER_TASK)).alias("step"))
    piece = F.coalesce(F.floor((key - F.col("first")) / F.col("step")), F.lit(0)).cast("int")
    return rows.join(F.broadcast(large), filing, "left").withColumn("piece", piece).drop("first", "step")


def filing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small xBRL-JSON document per line item, numbered; documents of a filing share its key.

    The rows are dealt out before the documents are built, so that this is not the work of as few tasks
    as the table has row groups. They are dealt by filing and piece, and sorted in the order of facts: the
    documents of a piece are in one partition, so their facts are reduced there, and a filing of very many
    has several pieces and is still the work of several tasks.
    """
    rows = with_pieces(table(spark, sf_dir, "lineitem").withColumn("fiscal_year", F.year("l_shipdate"))) \
        .withColumn("lei", F.concat(F.lit("S"), F.col("l_suppkey")))
    documents = table(spark, sf_dir, "lineitem").count()
    li = number_documents(rows, [*DEALT, *FACT_ORDER], at_least=documents // DOCUMENTS_PER_TASK, whole=len(DEALT))
    y, line, q = F.col("fiscal_year"), F.col("l_linenumber"), F.col("l_quantity")
    jan = lambda year: F.concat(year.cast("string"), F.lit("-01-01T00:00:00"))
    year_of = F.when(line == 6, y - 1).otherwise(y)
    duration = F.when(line == 7, F.concat(jan(y), F.lit("/"), y.cast("string"), F.lit("-07-01T00:00:00"))) \
        .otherwise(F.concat(jan(year_of), F.lit("/"), jan(year_of + 1)))
    instant = F.when(line == 7, F.concat(y.cast("string"), F.lit("-07-01T12:00:00"))).otherwise(jan(year_of + 1))

    def fact(j: int) -> Column:
        idx = (F.col("l_partkey") + line * 7 + j * 13) % N_CONCEPTS
        amount = F.col("l_extendedprice") * (1 + j) * F.when(
            (F.col("l_returnflag") == "R") & (idx % 3 == 0), -1).otherwise(1)
        value = amount.cast("string")
        if j == 1:
            value = F.when(q == 11, "text block").when(q == 13, "").otherwise(value)
        dims = [pick([c for _, c in CONCEPTS], idx).alias("concept"),
                F.when(pick([k for k, _ in CONCEPTS], idx) == "annual", duration).otherwise(instant).alias("period"),
                F.lit("lei:X").alias("entity"),
                F.when(F.col("l_linestatus") == "O", "iso4217:EUR").otherwise("iso4217:USD").alias("unit")]
        if j == 0:
            dims.append(F.when(q.isin(7, 19, 33), "seg:A").alias("ifrs-full:SegmentsAxis"))  # null: not written
        return F.struct(value.alias("value"), F.struct(*dims).alias("dimensions"))

    body = F.to_json(F.struct(F.struct(fact(0).alias("f0"), fact(1).alias("f1")).alias("facts")))
    return li.select(*DEALT, "doc_no", body.alias("body"))


def filing_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hint, name, country and source_ref of every filing, without its documents."""
    held = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("fiscal_year")).distinct()
    k, y = F.col("l_suppkey"), F.col("fiscal_year")
    hint = F.when(k % 13 == 0, F.make_date(y, F.lit(6), F.lit(30))) \
        .when(k % 10 == 0, F.make_date(y, F.lit(11), F.lit(30))).otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    return held.join(table(spark, sf_dir, "supplier"), k == F.col("s_suppkey")).select(
        F.concat(F.lit("S"), k).alias("lei"), "fiscal_year", hint.alias("hint"),
        F.col("s_name").alias("name"), pick(spec.EURO_AREA, F.col("s_nationkey") % 20).alias("country"),
        F.concat(F.lit("S"), k, F.lit("-"), y).alias("source_ref"))


def _element_values() -> str:
    rows = []
    for item in spec.LINE_ITEMS:
        rows += [(item.kind, e, item.key, 1, 0, n, 1) for n, e in enumerate(item.elements)]
        for g, group in enumerate((*item.plus, *item.minus)):
            sign = 1 if g < len(item.plus) else -1
            rows += [(item.kind, e, item.key, 2, g, n, sign) for n, e in enumerate(group)]
    return ", ".join(str(r) for r in rows)


def _like(c: str, parts, op: str) -> str:
    return "(" + f" {op} ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def _patterns() -> str:
    out = []
    for item in spec.LINE_ITEMS:
        if item.must:
            cond = _like("plain", item.must, "AND")
            if item.any_of:
                cond += " AND " + _like("plain", item.any_of, "OR")
            cond += " AND NOT " + _like("plain", item.deny, "OR")
            liked = _like("plain", item.prefer, "AND") if item.prefer else "false"
            out.append(f"SELECT lei, fy, '{item.key}' AS field, value, concept, {liked} AS liked "
                       f"FROM best WHERE kind = '{item.kind}' AND {cond}")
    return " UNION ALL ".join(out)


FACTS_SQL = f"""
raw_facts AS (
  SELECT 'S' || l_suppkey AS lei, l_suppkey, year(l_shipdate)::INT AS fy, l_orderkey, l_linenumber, l_partkey,
         l_extendedprice, l_quantity, l_returnflag, l_linestatus, j,
         ((l_partkey + l_linenumber * 7 + j * 13) % {N_CONCEPTS})::INT AS idx
  FROM lineitem CROSS JOIN (VALUES (0), (1)) t(j)),
parsed AS (
  SELECT lei, fy, l_orderkey, l_linenumber, l_partkey, l_extendedprice, j,
         {sql_list(c for _, c in CONCEPTS)}[idx + 1] AS concept,
         {sql_list(k for k, _ in CONCEPTS)}[idx + 1] AS shape,
         CASE WHEN l_linenumber = 6 THEN fy - 1 ELSE fy END AS py, l_linenumber = 7 AS half,
         l_extendedprice * (1 + j) * CASE WHEN l_returnflag = 'R' AND idx % 3 = 0 THEN -1 ELSE 1 END AS value,
         l_linestatus = 'O' AS eur,
         CASE WHEN j = 0 AND l_quantity IN (7, 19, 33) THEN 'dimensional'
              WHEN j = 1 AND l_quantity = 11 THEN 'nonnumeric'
              WHEN j = 1 AND l_quantity = 13 THEN 'blank' ELSE 'numeric' END AS outcome
  FROM raw_facts),
facts AS (
  SELECT *, regexp_replace(concept, '^[^:]*:', '') AS local, concept LIKE 'ifrs%' AS ifrs,
         CASE WHEN shape = 'annual' THEN (CASE WHEN half THEN make_date(fy, 6, 30) ELSE make_date(py, 12, 31) END)
              ELSE (CASE WHEN half THEN make_date(fy, 7, 1) ELSE make_date(py, 12, 31) END) END AS "end",
         CASE WHEN shape = 'instant' THEN 'instant' WHEN NOT half THEN 'annual' END AS kind
  FROM parsed WHERE outcome = 'numeric')
"""

PERIOD_SQL = """
filing AS (
  SELECT DISTINCT 'S' || l_suppkey AS lei, year(l_shipdate)::INT AS fy,
         CASE WHEN l_suppkey % 13 = 0 THEN make_date(year(l_shipdate)::INT, 6, 30)
              WHEN l_suppkey % 10 = 0 THEN make_date(year(l_shipdate)::INT, 11, 30)
              ELSE make_date(year(l_shipdate)::INT, 12, 31) END AS hint,
         s_name AS name, COUNTRIES[s_nationkey % 20 + 1] AS country,
         'S' || l_suppkey || '-' || year(l_shipdate)::INT AS source_ref
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
ends AS (SELECT lei, fy, "end", count(*) AS n FROM facts WHERE kind = 'annual' GROUP BY ALL),
period AS (
  SELECT f.lei, f.fy, hint, coalesce((
    SELECT e."end" FROM ends e WHERE e.lei = f.lei AND e.fy = f.fy AND e.n >= 5
    ORDER BY abs(e."end" - hint) > 45,
             CASE WHEN abs(e."end" - hint) <= 45 THEN abs(e."end" - hint) END, e."end" DESC LIMIT 1), hint) AS pe
  FROM filing f)
""".replace("COUNTRIES", sql_list(spec.EURO_AREA))

EXTRACT_SQL = FACTS_SQL + "," + PERIOD_SQL + f""",
elements(kind, local, field, tier, grp, prio, direction) AS (VALUES {_element_values()}),
best AS (
  SELECT f.*, lower(regexp_replace(local, '[^a-zA-Z0-9]', '', 'g')) AS plain
  FROM facts f JOIN period USING (lei, fy) WHERE "end" = pe AND kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lei, fy, kind, local ORDER BY NOT ifrs, NOT eur, l_orderkey,
                             l_linenumber, l_partkey, l_extendedprice, j) = 1),
tier1 AS (
  SELECT lei, fy, field, value, concept, ifrs FROM best JOIN elements USING (kind, local) WHERE tier = 1
  QUALIFY row_number() OVER (PARTITION BY lei, fy, field ORDER BY prio) = 1),
hits2 AS (
  SELECT lei, fy, field, grp, concept, ifrs,
         direction * CASE WHEN field = 'acquisitions_net' THEN abs(value) ELSE value END AS v
  FROM best JOIN elements USING (kind, local) WHERE tier = 2
  QUALIFY row_number() OVER (PARTITION BY lei, fy, field, grp ORDER BY prio) = 1),
tier2 AS (SELECT lei, fy, field, sum(v) AS value, bool_and(ifrs) AS ifrs,
                 string_agg(concept, '|' ORDER BY grp) AS parts FROM hits2 GROUP BY ALL),
hits3 AS ({_patterns()}),
tier3 AS (SELECT lei, fy, field, CASE WHEN bool_or(liked) THEN max(value) FILTER (liked) ELSE max(value) END AS value,
                 CASE WHEN bool_or(liked) THEN max(concept) FILTER (liked) ELSE max(concept) END AS concept
          FROM hits3 GROUP BY ALL
          HAVING (count(*) FILTER (liked)) = 1 OR ((count(*) FILTER (liked)) = 0 AND count(*) = 1)),
open_lines AS (
  SELECT p.lei, p.fy, k.field,
         coalesce(t1.value, t2.value, t3.value) AS v0,
         CASE WHEN t1.value IS NOT NULL THEN (CASE WHEN t1.ifrs THEN 'reported' ELSE 'extension' END)
              WHEN t2.value IS NOT NULL THEN (CASE WHEN t2.ifrs THEN 'summed' ELSE 'extension' END)
              WHEN t3.value IS NOT NULL THEN 'extension' END AS derivation,
         CASE WHEN t1.value IS NOT NULL THEN t1.concept WHEN t2.value IS NOT NULL THEN NULL
  ELSE t3.concept END AS element,
         CASE WHEN t1.value IS NULL AND t2.value IS NOT NULL THEN t2.parts ELSE '' END AS parts
  FROM period p CROSS JOIN (SELECT unnest({sql_list(spec.LINE_ITEM_KEYS)}) AS field) k
  LEFT JOIN tier1 t1 ON (p.lei, p.fy, k.field) = (t1.lei, t1.fy, t1.field)
  LEFT JOIN tier2 t2 ON (p.lei, p.fy, k.field) = (t2.lei, t2.fy, t2.field)
  LEFT JOIN tier3 t3 ON (p.lei, p.fy, k.field) = (t3.lei, t3.fy, t3.field)),
signed AS (
  SELECT *, CASE WHEN field IN ('depreciation_amortisation', 'interest_expense', 'capex') THEN abs(v0)
  ELSE v0 END AS value,
         coalesce(field IN ('depreciation_amortisation', 'interest_expense', 'capex') AND v0 < 0, false) AS flipped
  FROM open_lines),
named AS (
  SELECT lei, fy, {", ".join(
      f"max(value) FILTER (kind = '{kind}' AND local = '{name}') AS {a}, "
      f"max(concept) FILTER (kind = '{kind}' AND local = '{name}') AS {a}_c"
      for a, kind, name in (("profit", "annual", "ProfitLoss"),
                            ("nci", "annual", "ProfitLossAttributableToNoncontrollingInterests"),
                            ("nca", "instant", "NoncurrentAssets"), ("ncl", "instant", "NoncurrentLiabilities"),
                            ("owed", "instant", "Liabilities"), ("fin", "annual", "FinanceIncome"),
                            ("assoc", "annual", "ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod"),
                            ("basic", "annual", "BasicEarningsLossPerShare"),
                            ("diluted", "annual", "DilutedEarningsLossPerShare"),
                            ("marker", "instant", "InvestmentProperty"), ("stock", "instant", "Inventories")))}
  FROM best GROUP BY ALL),
wide AS (
  SELECT p.lei, p.fy, {", ".join(f"max(value) FILTER (field = '{k}') AS {k}" for k in spec.LINE_ITEM_KEYS)}
  FROM period p JOIN signed USING (lei, fy) GROUP BY ALL),
step1 AS (
  SELECT w.* REPLACE (
      coalesce(net_income, profit - coalesce(nci, 0)) AS net_income,
      coalesce(pretax_income, profit + tax_expense) AS pretax_income,
      coalesce(total_current_assets, total_assets - nca) AS total_current_assets,
      coalesce(total_current_liabilities, CASE WHEN owed IS NOT NULL THEN owed - ncl
               ELSE total_assets - total_equity - ncl END) AS total_current_liabilities),
    n.* EXCLUDE (lei, fy), net_income IS NULL AS open_ni, pretax_income IS NULL AS open_pt,
    total_current_assets IS NULL AS open_ca, total_current_liabilities IS NULL AS open_cl
  FROM wide w LEFT JOIN named n ON (w.lei, w.fy) = (n.lei, n.fy)),
step2 AS (
  SELECT * REPLACE (coalesce(long_term_debt, CASE WHEN short_term_debt IS NULL AND interest_expense > 0 THEN
      coalesce(ncl, CASE WHEN total_assets - total_equity - total_current_liabilities > 0
                    THEN total_assets - total_equity - total_current_liabilities END) END) AS long_term_debt),
    long_term_debt IS NULL AS open_debt,
    coalesce(total_current_assets IS NULL AND total_current_liabilities IS NULL AND total_assets IS NOT NULL
      AND total_equity IS NOT NULL AND marker IS NOT NULL AND stock IS NULL, false) AS likely_financial
  FROM step1),
status AS (
  SELECT *, coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) AS debt,
    bool_and(likely_financial) OVER (PARTITION BY lei) AS is_financial,
    bool_or(likely_financial) OVER (PARTITION BY lei) AS any_financial,
    {" + ".join(f"({k} IS NULL)::INT" for k in spec.REQUIRED_KEYS)} AS n_missing
  FROM step2),
headers AS (
  SELECT s.*, s.fy AS fiscal_year, f.name, f.country, f.source_ref, p.pe,
    CASE WHEN is_financial THEN 'failed' WHEN n_missing > 0 OR (debt > 0 AND interest_expense IS NULL)
         OR (debt <= 0 AND coalesce(interest_expense, 0) > 0) THEN 'partial' ELSE 'complete' END AS status
  FROM status s JOIN filing f ON (s.lei, s.fy) = (f.lei, f.fy) JOIN period p ON (s.lei, s.fy) = (p.lei, p.fy)),
fact AS (
  SELECT s.lei, s.fy AS fiscal_year, s.field,
    CASE s.field WHEN 'net_income' THEN h.net_income WHEN 'pretax_income' THEN h.pretax_income
      WHEN 'total_current_assets' THEN h.total_current_assets
      WHEN 'total_current_liabilities' THEN h.total_current_liabilities
      WHEN 'long_term_debt' THEN coalesce(h.long_term_debt, 0)
      ELSE coalesce(s.value, CASE WHEN s.field IN ({", ".join(f"'{k}'" for k in spec.OPTIONAL_KEYS)})
  THEN 0 END) END AS value,
    CASE WHEN s.field = 'net_income' AND open_ni AND h.net_income IS NOT NULL THEN 'computed'
      WHEN s.field = 'pretax_income' AND open_pt AND h.pretax_income IS NOT NULL THEN 'computed'
      WHEN s.field = 'total_current_assets' AND open_ca AND h.total_current_assets IS NOT NULL THEN 'computed'
      WHEN s.field = 'total_current_liabilities' AND open_cl AND h.total_current_liabilities IS NOT NULL THEN 'computed'
      WHEN s.field = 'long_term_debt' AND open_debt AND h.long_term_debt IS NOT NULL THEN 'debt_proxy'
      WHEN s.derivation IS NOT NULL THEN s.derivation
      WHEN s.field IN ({", ".join(f"'{k}'" for k in spec.OPTIONAL_KEYS)}) THEN 'assumed_zero'
  ELSE 'reported' END AS derivation,
    CASE WHEN s.field = 'net_income' AND open_ni THEN h.profit_c
      WHEN s.field = 'pretax_income' AND open_pt AND h.pretax_income IS NOT NULL THEN h.profit_c
      WHEN s.field = 'total_current_assets' AND open_ca AND h.total_current_assets IS NOT NULL THEN h.nca_c
      WHEN s.field = 'total_current_liabilities' AND open_cl AND h.total_current_liabilities IS NOT NULL
        THEN coalesce(h.owed_c, 'Assets-Equity')
      WHEN s.field = 'long_term_debt' AND open_debt AND h.long_term_debt IS NOT NULL
        THEN coalesce(h.ncl_c, 'Assets-Equity-CurrentLiabilities')
      ELSE s.element END AS element,
    CASE WHEN s.field = 'net_income' AND open_ni AND h.net_income IS NOT NULL THEN coalesce(h.nci_c, '')
      WHEN s.field = 'total_current_assets' AND open_ca AND h.total_current_assets IS NOT NULL THEN 'Assets'
      WHEN s.field = 'total_current_liabilities' AND open_cl AND h.total_current_liabilities IS NOT NULL THEN h.ncl_c
      WHEN s.field = 'long_term_debt' AND open_debt AND h.long_term_debt IS NOT NULL
        THEN CASE WHEN h.ncl IS NULL THEN 'Assets|Equity|CurrentLiabilities' ELSE '' END
      ELSE s.parts END AS components, s.flipped AS sign_flipped
  FROM signed s JOIN headers h ON (s.lei, s.fy) = (h.lei, h.fy) WHERE h.status <> 'failed')
"""
