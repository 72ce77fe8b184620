"""Which reported tags serve which concept, in order of preference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. One concept per line: name, period (d = duration, i = instant), unit, how quarters combine, tags by preference.
CONCEPTS = """
revenue                   d USD        sum  RevenueFromContractWithCustomerExcludingAssessedTax RevenueFromContractWithCustomerIncludingAssessedTax Revenues SalesRevenueNet SalesRevenueGoodsNet SalesRevenueServicesNet RevenuesNetOfInterestExpense TotalRevenuesAndOtherIncome RegulatedAndUnregulatedOperatingRevenue
cost_of_revenue           d USD        sum  CostOfGoodsAndServicesSold CostOfRevenue CostOfGoodsSold CostOfServices
gross_profit              d USD        sum  GrossProfit
operating_income          d USD        sum  OperatingIncomeLoss IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest
operating_expenses        d USD        sum  OperatingExpenses CostsAndExpenses
sga                       d USD        sum  SellingGeneralAndAdministrativeExpense GeneralAndAdministrativeExpense
rnd                       d USD        sum  ResearchAndDevelopmentExpense
pretax_income             d USD        sum  IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic
tax_expense               d USD        sum  IncomeTaxExpenseBenefit
net_income                d USD        sum  NetIncomeLoss ProfitLoss
net_income_to_common      d USD        sum  NetIncomeLossAvailableToCommonStockholdersBasic
interest_expense          d USD        sum  InterestExpenseNonoperating InterestExpenseDebt InterestExpense InterestAndDebtExpense
depreciation_amortization d USD        sum  DepreciationDepletionAndAmortization DepreciationAmortizationAndAccretionNet DepreciationAndAmortization Depreciation
depreciation_only         d USD        sum  Depreciation
amortization_intangibles  d USD        sum  AmortizationOfIntangibleAssets
share_based_comp          d USD        sum  ShareBasedCompensation AllocatedShareBasedCompensationExpense ShareBasedCompensationArrangementByShareBasedPaymentAwardCompensationCost
eps_diluted               d USD/shares sum  EarningsPerShareDiluted IncomeLossFromContinuingOperationsPerDilutedShare
eps_basic                 d USD/shares sum  EarningsPerShareBasic IncomeLossFromContinuingOperationsPerBasicShare
shares_diluted            d shares     last WeightedAverageNumberOfDilutedSharesOutstanding
shares_basic              d shares     last WeightedAverageNumberOfSharesOutstandingBasic
dividends_per_share       d USD/shares sum  CommonStockDividendsPerShareDeclared CommonStockDividendsPerShareCashPaid
operating_cash_flow       d USD        sum  NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations
capex                     d USD        sum  PaymentsToAcquirePropertyPlantAndEquipment PaymentsToAcquireProductiveAssets PaymentsForCapitalImprovements PaymentsToAcquireOtherPropertyPlantAndEquipment PaymentsToExploreAndDevelopOilAndGasProperties PaymentsToAcquireOilAndGasProperty PaymentsToAcquireOilAndGasPropertyAndEquipment
acquisitions              d USD        sum  PaymentsToAcquireBusinessesNetOfCashAcquired
buyback                   d USD        sum  PaymentsForRepurchaseOfCommonStock
stock_issued              d USD        sum  ProceedsFromIssuanceOfCommonStock ProceedsFromStockOptionsExercised ProceedsFromIssuanceOfSharesUnderIncentiveAndShareBasedCompensationPlans
dividends_paid            d USD        sum  PaymentsOfDividendsCommonStock PaymentsOfDividends PaymentsOfDistributionsToAffiliates
debt_issued               d USD        sum  ProceedsFromIssuanceOfLongTermDebt
debt_repaid               d USD        sum  RepaymentsOfLongTermDebt
interest_paid             d USD        sum  InterestPaidNet InterestPaid
taxes_paid                d USD        sum  IncomeTaxesPaidNet IncomeTaxesPaid
assets                    i USD        last Assets
current_assets            i USD        last AssetsCurrent
liabilities               i USD        last Liabilities
current_liabilities       i USD        last LiabilitiesCurrent
equity                    i USD        last StockholdersEquity
equity_incl_nci           i USD        last StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest
minority_interest         i USD        last MinorityInterest
preferred_equity          i USD        last PreferredStockValue PreferredStockLiquidationPreferenceValue
cash                      i USD        last CashAndCashEquivalentsAtCarryingValue CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents
short_term_investments    i USD        last ShortTermInvestments MarketableSecuritiesCurrent AvailableForSaleSecuritiesDebtSecuritiesCurrent OtherShortTermInvestments
debt_long                 i USD        last LongTermDebtNoncurrent LongTermDebt LongTermDebtAndCapitalLeaseObligations
debt_current              i USD        last LongTermDebtCurrent DebtCurrent ShortTermBorrowings LongTermDebtAndCapitalLeaseObligationsCurrent CommercialPaper OtherShortTermBorrowings
operating_lease_liability i USD        last OperatingLeaseLiability OperatingLeaseLiabilityNoncurrent
inventory                 i USD        last InventoryNet
receivables               i USD        last AccountsReceivableNetCurrent ReceivablesNetCurrent
payables                  i USD        last AccountsPayableCurrent AccountsPayableAndAccruedLiabilitiesCurrent
ppe_net                   i USD        last PropertyPlantAndEquipmentNet
goodwill                  i USD        last Goodwill
intangibles               i USD        last IntangibleAssetsNetExcludingGoodwill FiniteLivedIntangibleAssetsNet
retained_earnings         i USD        last RetainedEarningsAccumulatedDeficit
shares_outstanding        i shares     last dei:EntityCommonStockSharesOutstanding CommonStockSharesOutstanding
interest_income           d USD        sum  InterestAndDividendIncomeOperating InterestIncomeOperating
net_interest_income       d USD        sum  InterestIncomeExpenseNet InterestIncomeExpenseAfterProvisionForLoanLoss
noninterest_income        d USD        sum  NoninterestIncome
noninterest_expense       d USD        sum  NoninterestExpense
credit_provision          d USD        sum  ProvisionForLoanLeaseAndOtherLosses ProvisionForLoanLossesExpensed ProvisionForCreditLossesExpensed
loans                     i USD        last LoansAndLeasesReceivableNetReportedAmount NotesReceivableNet FinancingReceivableExcludingAccruedInterestBeforeAllowanceForCreditLoss
deposits                  i USD        last Deposits
premiums_earned           d USD        sum  PremiumsEarnedNet PremiumsEarnedNetPropertyAndCasualty
policy_benefits           d USD        sum  PolicyholderBenefitsAndClaimsIncurredNet BenefitsLossesAndExpenses LiabilityForClaimsAndClaimsAdjustmentExpenseClaimsIncurredNet
real_estate_gross         i USD        last RealEstateInvestmentPropertyAtCost RealEstateInvestmentPropertyNet
real_estate_accum_dep     i USD        last RealEstateInvestmentPropertyAccumulatedDepreciation
"""


def catalogue_rows() -> list[tuple[str, str, str, int, str, str]]:
    """(concept, tag, unit, tag_rank, period_type, aggregation) per tag."""
    out = []
    for line in CONCEPTS.strip().splitlines():
        concept, period, unit, aggregation, *tags = line.split()
        kind = "duration" if period == "d" else "instant"
        out += [(concept, tag, unit, rank, kind, aggregation) for rank, tag in enumerate(tags)]
    return out


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a small frame, ready to broadcast."""
    return spark.createDataFrame(
        catalogue_rows(), "concept string, tag string, unit string, tag_rank int, period_type string, aggregation string"
    )
