"""Data the dataflows are driven by: line items, name lists, venues, ladders, policy.

Everything here is a small constant.  Operators turn it into column expressions,
so none of it is ever joined or broadcast as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

REQUIRED = "required"
ZERO_IF_ABSENT = "zero_if_absent"
AS_REPORTED = "as_reported"
FORCE_POSITIVE = "force_positive"


@dataclass(frozen=True)
class LineItem:
    """One of the twenty statement lines and the ways it may be tagged."""

    key: str
    statement: str
    absence: str
    sign: str = AS_REPORTED
    elements: tuple[str, ...] = ()
    plus: tuple[tuple[str, ...], ...] = ()
    minus: tuple[tuple[str, ...], ...] = ()
    must: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    prefer: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        """Balance lines are read from instants, all others from annual durations."""
        return "instant" if self.statement == "balance" else "annual"


# --- fixed values: the twenty line items, their taxonomy elements and patterns ---
LINE_ITEMS: tuple[LineItem, ...] = (
    LineItem("revenue", "income", REQUIRED, elements=(
        "Revenue", "RevenueFromContractsWithCustomers", "RevenueAndOperatingIncome")),
    LineItem("ebit", "income", REQUIRED, elements=(
        "ProfitLossFromOperatingActivities", "EarningsBeforeInterestAndTaxesEbit",
        "OperatingProfitLoss")),
    LineItem(
        "depreciation_amortisation", "income", REQUIRED, FORCE_POSITIVE,
        elements=(
            "DepreciationAndAmortisationExpense",
            "AdjustmentsForDepreciationAndAmortisationExpense",
            "DepreciationAmortisationAndImpairmentLossReversalOfImpairmentLossRecognisedInProfitOrLoss",
            "AdjustmentsForDepreciationAmortisationExpenseAndImpairmentLossReversalOfImpairmentLossRecognisedInProfitOrLoss",
            "AdjustmentsForDepreciationAndAmortisationExpenseAndImpairmentLossReversalOfImpairmentLossRecognisedInProfitOrLoss",
        ),
        plus=(
            ("AdjustmentsForDepreciationExpense", "DepreciationExpense"),
            ("AdjustmentsForAmortisationExpense", "AmortisationExpense",
             "AdjustmentsForAmortisationExpenseAndImpairmentLossReversalOfImpairmentLossRecognisedInProfitOrLoss"),
        ),
        must=("depreciat",), prefer=("amorti",),
        deny=("amortisedcost", "amortizedcost", "financialasset", "investment",
              "rightofuseasset", "propertyplant")),
    LineItem(
        "interest_expense", "income", ZERO_IF_ABSENT, FORCE_POSITIVE,
        elements=("InterestExpense", "FinanceCosts", "InterestExpenseAndOtherFinanceCosts"),
        must=("interest",), prefer=("expense",),
        deny=("income", "received", "revenue", "receivable", "paid", "lease", "asset",
              "capitalised", "capitalized")),
    LineItem("pretax_income", "income", REQUIRED, elements=("ProfitLossBeforeTax",)),
    LineItem("tax_expense", "income", REQUIRED, elements=(
        "IncomeTaxExpenseContinuingOperations", "IncomeTaxExpenseBenefit")),
    LineItem("net_income", "income", REQUIRED, elements=(
        "ProfitLossAttributableToOwnersOfParent",)),
    LineItem("cash", "balance", REQUIRED, elements=("CashAndCashEquivalents", "Cash")),
    LineItem("short_term_investments", "balance", ZERO_IF_ABSENT, elements=(
        "OtherCurrentFinancialAssets", "CurrentInvestments")),
    LineItem("total_current_assets", "balance", REQUIRED, elements=("CurrentAssets",)),
    LineItem("total_current_liabilities", "balance", REQUIRED, elements=("CurrentLiabilities",)),
    LineItem("short_term_debt", "balance", ZERO_IF_ABSENT, plus=(
        ("ShorttermBorrowings", "CurrentBorrowings"),
        ("CurrentPortionOfLongtermBorrowings",),
        ("CurrentLeaseLiabilities", "LeaseLiabilitiesCurrent"))),
    LineItem("long_term_debt", "balance", ZERO_IF_ABSENT, plus=(
        ("NoncurrentPortionOfNoncurrentBorrowings", "LongtermBorrowings", "NoncurrentBorrowings"),
        ("NoncurrentLeaseLiabilities", "LeaseLiabilitiesNoncurrent"))),
    LineItem("preferred_stock", "balance", ZERO_IF_ABSENT, elements=(
        "PreferenceShares", "IssuedCapitalPreferenceShares")),
    LineItem("minority_interest", "balance", ZERO_IF_ABSENT, elements=(
        "NoncontrollingInterests", "EquityAttributableToNoncontrollingInterests")),
    LineItem("total_equity", "balance", REQUIRED, elements=("Equity",)),
    LineItem("equity_method_investments", "balance", ZERO_IF_ABSENT, elements=(
        "InvestmentAccountedForUsingEquityMethod",
        "InvestmentsInAssociatesAndJointVenturesAccountedForUsingEquityMethod",
        "InvestmentsInAssociatesAccountedForUsingEquityMethod")),
    LineItem("total_assets", "balance", REQUIRED, elements=("Assets",)),
    LineItem(
        "capex", "cashflow", REQUIRED, FORCE_POSITIVE,
        elements=(
            "PurchaseOfPropertyPlantAndEquipmentIntangibleAssetsOtherThanGoodwillInvestmentPropertyAndOtherNoncurrentAssets",
            "PurchaseOfPropertyPlantAndEquipmentAndPurchaseOfIntangibleAssetsClassifiedAsInvestingActivities",
            "PurchaseOfPropertyPlantAndEquipmentAndIntangibleAssetsClassifiedAsInvestingActivities",
            "AcquisitionOfPropertyPlantAndEquipmentAndIntangibleAssets",
        ),
        plus=(
            ("PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",
             "PurchaseOfPropertyPlantAndEquipment",
             "AcquisitionOfPropertyPlantAndEquipment"),
            ("PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities",
             "PurchaseOfIntangibleAssetsOtherThanGoodwill"),
            ("PurchaseOfInvestmentProperty",),
            ("PurchaseOfOtherLongtermAssetsClassifiedAsInvestingActivities",),
        ),
        must=("propertyplantandequipment",),
        any_of=("purchase", "acquisition", "addition", "investment", "payment", "expenditure"),
        deny=("proceeds", "disposal", "sale", "depreciat", "impairment", "carryingamount",
              "revaluation", "revenue", "profit")),
    LineItem(
        "acquisitions_net", "cashflow", ZERO_IF_ABSENT,
        plus=(("CashFlowsUsedInObtainingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities",),),
        minus=(("CashFlowsFromLosingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities",),)),
)

# --- fixed values: helper elements that are not line items themselves ---
NONCURRENT_ASSETS = ("NoncurrentAssets",)
NONCURRENT_LIABILITIES = ("NoncurrentLiabilities",)
TOTAL_LIABILITIES = ("Liabilities",)
TOTAL_PROFIT = ("ProfitLoss",)
MINORITY_PROFIT = ("ProfitLossAttributableToNoncontrollingInterests",)
FINANCE_INCOME = ("FinanceIncome", "InvestmentIncome", "InterestIncomeOnFinancialAssets")
ASSOCIATE_PROFIT = ("ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod",)
BASIC_EPS = ("BasicEarningsLossPerShare",)
DILUTED_EPS = ("DilutedEarningsLossPerShare",)
FINANCIAL_MARKERS = (
    "LoansAndAdvancesToCustomers", "LoansAndAdvancesToBanks",
    "DepositsFromCustomers", "DepositsFromBanks",
    "InterestRevenueCalculatedUsingEffectiveInterestMethod",
    "FinancialAssetsAtAmortisedCost", "FinancialAssetsAtFairValueThroughProfitOrLoss",
    "InsuranceContractLiabilities", "InsuranceRevenue",
    "LiabilitiesUnderInsuranceContractsAndReinsuranceContractsIssued",
    "InvestmentProperty", "RentalIncomeFromInvestmentProperty",
)
INVENTORY_MARKERS = ("Inventories", "CurrentInventories")

# --- fixed values: dimensions every undimensioned fact may carry ---
CORE_DIMENSIONS = ("concept", "entity", "period", "unit", "language", "noteId")

# --- fixed values: names of business types the valuation does not fit ---
EXCLUDED_NAME_PARTS = (
    "bank", "banca", "banque", "bancaire", "sparkasse", "raiffeisen",
    "kreditbank", "hypo", "bausparkasse", "landesbank", "volksbank",
    "insurance", "assicura", "assurance", "versicherung", "verzekering",
    "reinsurance", "rückversicherung", "rueckversicherung", "leasing",
    "immobilien", "immobiliare", "immobiliere", "real estate", "reit",
    "vastgoed", "properties", "property",
    "sicav", "sicaf", "investment fund", "capital partners",
    "sporitel", "zavarovaln", "rockcastle", "pension", "pankki",
    "asset management", "credito", "credit mutuel", "mediobanca",
    "paribas", "natixis", "bpce", "amundi", "coface", "allfunds",
    "euronext", "tikehau", "eurazeo", "osuuskunta", "finnvera", "taaleri",
    "capman", "aegon", "sampo", "kommunalkredit", "bpifrance", "hsbc",
    "klepierre", "gecina", "icade", "covivio", "unibail", "mercialys",
    "citycon", "kojamo", "vastned", "retail estates", "ascencio",
    "wereldhave", "plaza centers", "paref", "tour eiffel", "s immo",
    "finanzierungs", "funding", "finance b.v", "finance bv",
)
EXCLUDED_INDUSTRY_PARTS = (
    "bank", "insur", "brokerage", "investment", "reit", "real estate", "financial",
)

# --- fixed values: euro-area countries and the venue codes of their home markets ---
EURO_AREA = (
    "AT", "BE", "CY", "DE", "EE", "ES", "FI", "FR", "GR", "HR",
    "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PT", "SI", "SK",
)
HOME_VENUES = {
    "AT": ("AV",), "BE": ("BB",), "CY": ("CY",), "DE": ("GY", "GR"),
    "EE": ("ET",), "ES": ("SM", "SQ"), "FI": ("FH",), "FR": ("FP",),
    "GR": ("GA",), "HR": ("CZ",), "IE": ("ID",), "IT": ("IM",),
    "LT": ("LH",), "LU": ("LX",), "LV": ("LR",), "MT": ("MV",),
    "NL": ("NA",), "PT": ("PL",), "SI": ("SV",), "SK": ("SK",),
}
CROSS_LISTING_VENUES = ("GY", "GR")
CURRENCY_SUFFIXES = ("EUR", "USD", "GBP", "GBX", "CHF", "SEK", "NOK", "DKK",
                     "PLN", "CZK", "HUF", "BGN", "RON", "JPY")
EQUITY_SECTOR = "Equity"
EQUITY_TYPES = ("Common Stock", "Depositary Receipt", "REIT", "Preference")
VENUE_TO_MIC = {
    "AV": "XWBO", "BB": "XBRU", "CY": "XCYS", "CZ": "XZAG", "ET": "XTAL",
    "FH": "XHEL", "FP": "XPAR", "GA": "XATH", "GR": "XFRA", "GY": "XETR",
    "ID": "XDUB", "IM": "XMIL", "LH": "XLIT", "LR": "XRIS", "LX": "XLUX",
    "MV": "XMAL", "NA": "XAMS", "PL": "XLIS", "SK": "XBRA", "SM": "XMAD",
    "SQ": "XMAD", "SV": "XLJU",
}
VENUE_TO_SUFFIX = {
    "AV": ".VI", "BB": ".BR", "ET": ".TL", "FH": ".HE", "FP": ".PA",
    "GA": ".AT", "GR": ".F", "GY": ".DE", "ID": ".IR", "IM": ".MI",
    "LH": ".VS", "LR": ".RG", "NA": ".AS", "PL": ".LS", "SM": ".MC",
    "SQ": ".MC", "LX": ".LU", "SV": ".LJ", "CZ": ".ZA",
}
COUNTRY_ALIASES = {
    "austria": "AT", "belgium": "BE", "cyprus": "CY", "germany": "DE",
    "estonia": "EE", "spain": "ES", "finland": "FI", "france": "FR",
    "greece": "GR", "croatia": "HR", "ireland": "IE", "italy": "IT",
    "lithuania": "LT", "luxembourg": "LU", "latvia": "LV", "malta": "MT",
    "netherlands": "NL", "netherlands (the)": "NL", "the netherlands": "NL",
    "portugal": "PT", "slovenia": "SI", "slovakia": "SK",
    "slovak republic": "SK", "slovakia (slovak republic)": "SK",
}

# --- fixed values: closed vocabularies of the fact store ---
DERIVATIONS = ("reported", "summed", "extension", "computed", "debt_proxy",
               "assumed_zero", "manual")
SOURCES = ("esef", "factset", "manual")
STATUSES = ("complete", "partial", "failed")
EXTRACTOR_VERSION = "esef-1.1.0"
FINANCIAL_REASON = "liquidity-ordered balance sheet with financial-institution markers"

# --- fixed values: thresholds ---
MIN_ANNUAL_DAYS, MAX_ANNUAL_DAYS = 350, 380
MIN_PERIOD_FACTS, HINT_DAYS = 5, 45
SCALE = 1_000_000
VERDICT_BAND, WATCH_BAND = 0.25, 0.20
CAP_REVENUE_MIN, CAP_REVENUE_MAX = 0.05, 30.0
SHARES_MIN, SHARES_MAX = 1e5, 1e11
QUOTE_MAX_AGE = 7
STAKE = 100.0
EXIT_UPSIDE = 0.0
ROLL_SHARE = 0.80
CREDIT_CUTOFF = 4300.0
THIN_BUCKET = 5
LADDER_BLOCK_DAYS = 425
COST_OF_DEBT_CAP = 0.25
FISCAL_YEARS = 5
SIZE_BUCKETS = (
    ("micro   < 300m", 0.0, 300.0),
    ("small   300m - 2bn", 300.0, 2000.0),
    ("mid     2bn - 4.3bn", 2000.0, 4300.0),
    ("large   > 4.3bn", 4300.0, None),
)
STAGE_REFRESH_DAYS = {
    "coverage": 180, "extract": 365, "identity": 365, "prices": 7, "shares": 365,
    "parameters": 365, "tables": 400, "industries": None, "screen": 92,
}
STAGE_PARENT = {
    "extract": "coverage", "identity": "extract", "prices": "identity",
    "shares": "identity", "industries": "identity", "screen": "prices",
}
CONVENTIONS = {"B63": 5.0, "B64": 5.0, "B65": 0.12, "B66": 0.40, "B67": 0.02,
               "B68": 0.90, "B69": 1.0, "B70": 0.005}

# --- fixed values: verdict texts and their short labels ---
UNDERVALUED = "UNDERVALUED - investigate"
OVERVALUED = "OVERVALUED - screen out"
FAIRLY_VALUED = "FAIRLY VALUED - no action"
VOID = "VOID - failed validation"
EXIT_AT_FAIR_VALUE = "PRICE AT FAIR VALUE - exited between screens"
SHORT_VERDICTS = {UNDERVALUED: "UNDERVALUED", OVERVALUED: "OVERVALUED",
                  FAIRLY_VALUED: "FAIRLY VALUED", VOID: "VOID"}
PROCESS_CHECKS = ("D121", "D122")
CHECK_SEVERITIES = ("OK", "FAIL", "WARNING", "NOTE")


@dataclass(frozen=True)
class Policy:
    """The research policy; defaults are the published ones."""

    require_verdict: str = UNDERVALUED
    suppress_on: tuple[str, ...] = ("WARNING",)
    exempt: tuple[str, ...] = ("D103",)
    graded: dict[str, float] = field(default_factory=lambda: {"D104": 3.0})


# --- fixed values: interest cover to rating and spread, one ladder per company size ---
LADDERS = {
    "LARGE": (
        (-100000.0, "D", "D2/D", 0.1900), (0.2, "C", "C2/C", 0.1600),
        (0.65, "CC", "Ca2/CC", 0.1261), (0.8, "CCC", "Caa/CCC", 0.0885),
        (1.25, "B-", "B3/B-", 0.0509), (1.5, "B", "B2/B", 0.0321),
        (1.75, "B+", "B1/B+", 0.0275), (2.0, "BB", "Ba2/BB", 0.0184),
        (2.25, "BB+", "Ba1/BB+", 0.0138), (2.5, "BBB", "Baa2/BBB", 0.0111),
        (3.0, "A-", "A3/A-", 0.0089), (4.25, "A", "A2/A", 0.0078),
        (5.5, "A+", "A1/A+", 0.0070), (6.5, "AA", "Aa2/AA", 0.0055),
        (8.5, "AAA", "Aaa/AAA", 0.0040),
    ),
    "SMALL": (
        (-100000.0, "D", "D2/D", 0.1400), (0.5, "C", "C2/C", 0.1050),
        (0.8, "CC", "Ca2/CC", 0.0800), (1.25, "CCC", "Caa/CCC", 0.0650),
        (1.5, "B-", "B3/B-", 0.0550), (2.0, "B", "B2/B", 0.0450),
        (2.5, "B+", "B1/B+", 0.0375), (3.0, "BB", "Ba2/BB", 0.0300),
        (3.5, "BB+", "Ba1/BB+", 0.0250), (4.0, "BBB", "Baa2/BBB", 0.0160),
        (4.5, "A-", "A3/A-", 0.0125), (6.0, "A", "A2/A", 0.0110),
        (7.5, "A+", "A1/A+", 0.0100), (9.5, "AA", "Aa2/AA", 0.0080),
        (12.5, "AAA", "Aaa/AAA", 0.0060),
    ),
}
LADDER_ROWS = 15

# --- fixed values: which sheet column feeds which industry parameter ---
INDUSTRY_COLUMNS = {
    "betaEurope": ("unlevered_beta", ("unlevered", "beta"), ("corrected", "cash")),
    "EVAEurope": ("roic", ("roc",), ("cost", "-", "bv", "eva", "capital")),
    "capexEurope": ("sales_to_capital", ("sales", "capital"), ("net", "cap ex", "/sales")),
    "marginEurope": ("ebit_margin", ("pre-tax", "unadjusted", "operating"), ()),
}

LINE_ITEM_KEYS = tuple(item.key for item in LINE_ITEMS)
REQUIRED_KEYS = tuple(i.key for i in LINE_ITEMS if i.absence == REQUIRED)
OPTIONAL_KEYS = tuple(i.key for i in LINE_ITEMS if i.absence == ZERO_IF_ABSENT)
BY_KEY = {item.key: item for item in LINE_ITEMS}


def fiscal_window(last_year: int) -> list[int]:
    """Five consecutive fiscal years, oldest first, ending at ``last_year``."""
    return list(range(last_year - FISCAL_YEARS + 1, last_year + 1))


def check_window(years: list[int]) -> list[int]:
    """Reject anything but five consecutive ascending years."""
    if len(years) != FISCAL_YEARS or years != list(range(years[0], years[0] + FISCAL_YEARS)):
        raise ValueError(f"need {FISCAL_YEARS} consecutive ascending years, got {years}")
    return years
