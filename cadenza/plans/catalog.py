"""The catalogue: every factor as a formula over the datasets' columns.

``t`` is the month; x[t - n] is the value n calendar months earlier.
"""

from __future__ import annotations

from functools import cache

from cadenza.plans.expr import Expr, parse

#: Short names of the tables.
DATASETS = {
    "C": "stock_month",
    "A": "statement_month",
    "AA": "statement_year",
    "Q": "statement_quarter",
    "IU": "estimates",
    "IA": "estimates_adjusted",
    "IR": "recommendations",
    "IX": "actuals",
    "D": "distributions",
}

# Formulas that others refer to, then the factors.
# fmt: off
SHARED = {
    'm_ret_span0': 'span_fill(C.ret, value=0.0)',
    'm_ret_smt0': 'smt_fill(C.ret, value=0.0)',
    'sic_pit': 'coalesce(A.sich, A.sic)',
    'avg_at': 'average(A.at, A.at[t-12])',
    'nwc_ratio': '(A.act - A.che - (A.lct - A.dlc)) / positive_only(A.at)',
    'net_noncurrent_operating_assets': '(A.at - A.act - A.ivao - (A.lt - A.dlc - A.dltt)) / A.at',
    'current_operating_assets': 'A.act - A.che',
    'current_operating_liabilities': 'A.lct - A.dlc',
    'operating_assets': 'A.at - A.che',
    'operating_liabilities': 'A.at - A.dltt - A.mib - A.dc - A.ceq',
    'financial_liabilities': 'A.dltt + A.dlc + fillna(A.pstk, value=0)',
    'net_financial_assets': 'A.ivst + A.ivao - financial_liabilities',
    'total_assets_soliman': 'A.rect + A.invt + A.aco + ffill(A.ppent) + A.intan - (A.ap + A.lco + A.lo)',
    'asset_turnover': 'negative_to_null(A.sale / average(total_assets_soliman, total_assets_soliman[t-12]))',
    'enterprise_adjustment': 'A.che - A.dltt - A.dlc - A.dc + A.tstkp - A.dvpa',
    'enterprise_bm': '(A.ceq + enterprise_adjustment) / (C.mve_permco + enterprise_adjustment)',
    'book_to_price': '(A.ceq - A.dvpa + A.tstkp) / C.mve_permco',
    'real_estate_ratio': 'coalesce((A.fatb + A.fatl) / A.ppegt, (A.ppenb + A.ppenls) / A.ppent)',
    'capx_filled': 'coalesce(A.capx, delta(A.ppent, n=12))',
    'avg_lag_capx': 'average(capx_filled[t-12], capx_filled[t-24])',
    'pchcapx': 'coalesce((capx_filled - avg_lag_capx) / zero_to_null(avg_lag_capx), (capx_filled - capx_filled[t-12]) / zero_to_null(capx_filled[t-12]))',
    'capx_smt': 'smt_only(A.capx)',
    'ppent_smt': 'smt_only(A.ppent)',
    'capx_filled_smt': 'coalesce(capx_smt, delta(ppent_smt, n=12))',
    'avg_lag_capx_smt': 'average(capx_filled_smt[t-12], capx_filled_smt[t-24])',
    'pchcapx_smt': 'coalesce((capx_filled_smt - avg_lag_capx_smt) / zero_to_null(avg_lag_capx_smt), (capx_filled_smt - capx_filled_smt[t-12]) / zero_to_null(capx_filled_smt[t-12]))',
    'grcapx_age': 'firm_age(smt_only(A.at), require_compustat_row=True)',
    'grcapx_capx': 'coalesce(smt_only(A.capx), delta(smt_only(A.ppent), n=12) + 0.0*positive_only(grcapx_age - 23.5))',
    'book_equity': 'coalesce(A.seq, A.ceq + coalesce(A.pstk, A.pstkrv, A.pstkl), A.at - A.lt) + fillna(A.txditc, value=0) - coalesce(A.pstk, A.pstkrv, A.pstkl)',
}

FORMULAS = {
    'Accruals': '(delta(A.act, n=12) - delta(A.che, n=12) - (delta(A.lct, n=12) - delta(A.dlc, n=12) - delta(fillna(A.txp, value=0), n=12)) - A.dp) / average(A.at, A.at[t-12])',
    'AdExp': 'positive_only(A.xad / C.mve_permco)',
    'AM': 'A.at / C.mve_permco',
    'AssetGrowth': '(A.at - A.at[t-12]) / zero_to_null(A.at[t-12])',
    'BrandInvest': 'brand_invest_signal(AA.xad, AA.xad0, AA.at, AA.sic)',
    'BM': 'smt_only(log(A.ceqt / market_equity_matched_to_datadate(C.mve_permco, A.datadate, lag_months=6)))',
    'BMdec': 'crsp_only(bmdec_signal(A.ceq, A.txditc, A.seq, A.at, A.lt, A.pstk, A.pstkrv, A.pstkl, C.prc, C.shrout))',
    'BookLeverage': 'A.at / zero_to_null(coalesce(A.seq, A.ceq + coalesce(A.pstk, A.pstkrv, A.pstkl), A.at - A.lt) + fillna(A.txditc, value=0) - coalesce(A.pstk, A.pstkrv, A.pstkl))',
    'Cash': 'cash_rdq_signal()',
    'CashProd': '(C.mve_permco - A.at) / A.che',
    'CBOperProf': 'smt_only(nonfinancial_only((smt_fill(A.revt, value=0) - smt_fill(A.cogs, value=0) - (smt_fill(A.xsga, value=0) - smt_fill(A.xrd, value=0)) - delta(smt_fill(A.rect, value=0), n=12) - delta(smt_fill(A.invt, value=0), n=12) - delta(smt_fill(A.xpp, value=0), n=12) + delta(smt_fill(A.drc, value=0) + smt_fill(A.drlt, value=0), n=12) + delta(smt_fill(A.ap, value=0), n=12) + delta(smt_fill(A.xacc, value=0), n=12)) / A.at, C.sicCRSP) + 0.0*negative_to_null(11.0 - C.shrcd) + 0.0*C.mve_c + 0.0*negative_to_null(A.ceq / C.mve_permco))',
    'CF': '(A.ib + A.dp) / C.mve_permco',
    'cfp': 'smt_only(coalesce(A.oancf, A.ib - (delta(smt_only(A.act), n=12) - delta(smt_only(A.che), n=12) - (delta(smt_only(A.lct), n=12) - delta(smt_only(A.dlc), n=12) - delta(smt_only(A.txp), n=12) - A.dp))) / C.mve_permco)',
    'ChInvIA': 'industry_adjusted_mean(pchcapx_smt, C.sicCRSP)',
    'ChAssetTurnover': 'delta(asset_turnover, n=12)',
    'ChEQ': 'positive_only(A.ceq) / positive_only(A.ceq[t-12])',
    'ChInv': 'delta(A.invt, n=12) / avg_at',
    'ChNNCOA': 'delta(net_noncurrent_operating_assets, n=12)',
    'ChNWC': 'delta(nwc_ratio, n=12)',
    'ChTax': 'delta(Q.txtq, n=12) / A.at[t-12]',
    'CompEquIss': 'span_only(log(smt_only(C.mve_c) / smt_only(C.mve_c)[t-60]) - compound_return(m_ret_span0, lags=[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59]) + 0.0*smt_only(C.ret) + 0.0*smt_only(C.ret)[t-60])',
    'CompositeDebtIssuance': 'log((A.dltt + A.dlc) / (A.dltt + A.dlc)[t-60])',
    'ConvDebt': 'convertible_debt_indicator(A.dc, A.cshrc)',
    'DebtIssuance': 'smt_only(shrcd_le11(bm_defined_gate(positive_indicator(A.dltis), A.ceq, smt_only(C.mve_permco)), C.shrcd))',
    'DelCOA': 'delta(current_operating_assets, n=12) / avg_at',
    'DelCOL': 'delta(current_operating_liabilities, n=12) / avg_at',
    'DelDRC': 'deldrc_sample_filter(delta(A.drc, n=12) / avg_at, A.drc, A.ceq, A.sale, A.sic)',
    'DelEqu': 'delta(A.ceq, n=12) / avg_at',
    'DelFINL': 'delta(financial_liabilities, n=12) / avg_at',
    'DelLTI': 'delta(A.ivao, n=12) / avg_at',
    'DelNetFin': 'delta(net_financial_assets, n=12) / avg_at',
    'dNoa': 'delta(operating_assets - (A.at - fillna(A.dltt, value=0) - fillna(A.mib, value=0) - fillna(A.dlc, value=0) - fillna(A.pstk, value=0) - A.ceq), n=12) / zero_to_null(A.at[t-12])',
    'EntMult': 'smt_only(enterprise_multiple(C.mve_permco, A.dltt, A.dlc, A.dc, A.che, A.oibdp, A.ceq))',
    'EBM': 'enterprise_bm',
    'BPEBM': 'book_to_price - enterprise_bm',
    'EP': 'smt_only(negative_to_null(A.ib / smt_only(C.mve_permco)[t-6]))',
    'ForecastDispersion': "smt_only(IU.stdev.where(fpi='1', fpedats='*') / abs(IU.meanest.where(fpi='1', fpedats='*')))",
    'Frontier': 'frontier_signal(A.at, A.ceq, A.dltt, A.capx, A.sale, A.xrd, A.xad, A.ppent, A.ebitda, C.mve_permco, industry48(C.sicCRSP))',
    'GP': 'nonfinancial_only((A.revt - A.cogs) / A.at, sic=sic_pit)',
    'GrAdExp': 'size_decile_filtered(threshold_min(delta(log(A.xad), n=12), A.xad, min_value=0.1), smt_only(C.mve_c))',
    'GrLTNOA': 'gr_ltnoa(A.rect, A.invt, A.ppent, A.aco, A.intan, A.ao, A.ap, A.lco, A.lo, A.at, A.dp)',
    'GrSaleToGrInv': 'coalesce((A.sale - average(A.sale[t-12], A.sale[t-24])) / zero_to_null(average(A.sale[t-12], A.sale[t-24])) - (A.invt - average(A.invt[t-12], A.invt[t-24])) / zero_to_null(average(A.invt[t-12], A.invt[t-24])), (A.sale - A.sale[t-12]) / zero_to_null(A.sale[t-12]) - (A.invt - A.invt[t-12]) / zero_to_null(A.invt[t-12]))',
    'GrSaleToGrOverhead': 'coalesce((A.sale - average(A.sale[t-12], A.sale[t-24])) / zero_to_null(average(A.sale[t-12], A.sale[t-24])) - (A.xsga - average(A.xsga[t-12], A.xsga[t-24])) / zero_to_null(average(A.xsga[t-12], A.xsga[t-24])), (A.sale - A.sale[t-12]) / zero_to_null(A.sale[t-12]) - (A.xsga - A.xsga[t-12]) / zero_to_null(A.xsga[t-12]))',
    'grcapx': 'smt_only((grcapx_capx - grcapx_capx[t-24]) / grcapx_capx[t-24])',
    'grcapx3y': 'smt_only(3*grcapx_capx / (grcapx_capx[t-12] + grcapx_capx[t-24] + grcapx_capx[t-36]))',
    'hire': 'year_filtered(hire_growth(A.emp), min_year=1965)',
    'Investment': 'investment_to_sales_scaled(A.capx, A.revt, window_months=36, min_obs=24)',
    'Leverage': 'A.lt / C.mve_permco',
    'LRreversal': 'smt_only(compound_return(m_ret_smt0, lags=[13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36]))',
    'Mom6m': 'span_only(compound_return(m_ret_smt0, lags=[1, 2, 3, 4, 5]))',
    'Mom12m': 'span_only(compound_return(m_ret_smt0, lags=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]))',
    'Mom12mOffSeason': 'span_only(mean_of_lags(m_ret_span0, lags=[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]))',
    'MomSeason': 'span_only(mean_of_lags(m_ret_smt0, lags=[23, 35, 47, 59]))',
    'MomSeason06YrPlus': 'span_only(mean_of_lags(m_ret_smt0, lags=[71, 83, 95, 107, 119]))',
    'MomSeason11YrPlus': 'span_only(mean_of_lags(m_ret_smt0, lags=[131, 143, 155, 167, 179]))',
    'MomSeason16YrPlus': 'span_only(mean_of_lags(m_ret_smt0, lags=[191, 203, 215, 227, 239]))',
    'MomSeasonShort': 'span_only(m_ret_smt0[t-11])',
    'MomOffSeason': 'span_only(mean_of_lags(m_ret_span0, lags=[12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58]))',
    'MomOffSeason06YrPlus': 'span_only(mean_of_lags(m_ret_span0, lags=[60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 84, 85, 86, 87, 88, 89, 90, 91, 92, 93, 94, 96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 108, 109, 110, 111, 112, 113, 114, 115, 116, 117, 118]))',
    'MomOffSeason11YrPlus': 'span_only(mean_of_lags(m_ret_span0, lags=[120, 121, 122, 123, 124, 125, 126, 127, 128, 129, 130, 132, 133, 134, 135, 136, 137, 138, 139, 140, 141, 142, 144, 145, 146, 147, 148, 149, 150, 151, 152, 153, 154, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165, 166, 168, 169, 170, 171, 172, 173, 174, 175, 176, 177, 178]))',
    'MomOffSeason16YrPlus': 'span_only(mean_of_lags(m_ret_span0, lags=[180, 181, 182, 183, 184, 185, 186, 187, 188, 189, 190, 192, 193, 194, 195, 196, 197, 198, 199, 200, 201, 202, 204, 205, 206, 207, 208, 209, 210, 211, 212, 213, 214, 216, 217, 218, 219, 220, 221, 222, 223, 224, 225, 226, 228, 229, 230, 231, 232, 233, 234, 235, 236, 237, 238]))',
    'MRreversal': 'smt_only(require_any_lag(compound_return(m_ret_span0, lags=[13, 14, 15, 16, 17, 18], fill_missing=0), C.ret, lags=[13, 14, 15, 16, 17, 18]))',
    'NetDebtFinance': '(A.dltis - A.dltr + fillna(A.dlcch, value=0)) / average(A.at, A.at[t-12]) + 0.0*negative_to_null(1.0 - abs((A.dltis - A.dltr + fillna(A.dlcch, value=0)) / average(A.at, A.at[t-12])))',
    'NetDebtPrice': 'smt_only(monthly_fastxtile_exclude(nonfinancial_only((A.dltt + A.dlc + A.pstk + A.dvpa - (A.tstkp + A.che)) / C.mve_permco, sic=A.sic) + 0.0*(A.at + A.ib + A.csho + A.ceq + A.prcc_f), smt_only(log(A.ceq / C.mve_permco)), n=5, max_excluded=2))',
    'NetEquityFinance': 'abs_cap_to_null((A.sstk - A.prstkc - A.dv) / average(A.at, A.at[t-12]), max_abs=1.0)',
    'NetPayoutYield': 'netpayout_yield_signal(A.dvc, A.prstkc, A.sstk, C.mve_permco, A.sic, A.ceq)',
    'NOA': '(operating_assets - operating_liabilities) / A.at[t-12]',
    'OperProf': 'smt_only(size_filtered((A.revt - A.cogs - A.xsga - A.xint) / A.ceq, compustat_rows_only(smt_only(C.mve_c)), min_tercile=2))',
    'OperProfRD': 'smt_only(shrcd_le11(financial_excluded((A.revt - A.cogs - A.xsga + fillna(A.xrd, value=0)) / A.at + 0.0*A.ceq + 0.0*C.mve_c, C.sicCRSP), C.shrcd))',
    'OPLeverage': '(fillna(A.xsga, value=0) + A.cogs) / A.at',
    'OrderBacklog': 'zero_to_null(A.ob / avg_at)',
    'OrderBacklogChg': 'delta(zero_to_null(A.ob / avg_at), n=12)',
    'PayoutYield': 'payout_yield_signal(A.dvc, A.prstkc, A.pstkrv, C.mve_permco, A.sic, A.ceq)',
    'PctAcc': 'coalesce(A.ib - A.oancf, delta(A.act, n=12) - delta(A.che, n=12) - (delta(A.lct, n=12) - delta(A.dlc, n=12) - delta(A.txp, n=12) - A.dp)) / (fillna(zero_to_null(abs(A.ib)), 0.01) + 0.0*A.ib)',
    'PctTotAcc': '(A.ni - (A.prstkcc - A.sstk + A.dvt + A.oancf + A.fincf + A.ivncf)) / abs(A.ni)',
    'Price': 'log(abs(C.prc))',
    'Size': 'smt_only(log(C.mve_c))',
    'STreversal': 'smt_fill(C.ret, value=0.0)',
    'ShareIss1Y': 'smt_only((time_lagged_value(smt_only(C.shrout*C.cfacshr), months=6) - time_lagged_value(smt_only(C.shrout*C.cfacshr), months=18)) / time_lagged_value(smt_only(C.shrout*C.cfacshr), months=18))',
    'ShareIss5Y': 'smt_only((time_lagged_value(smt_only(C.shrout*C.cfacshr), months=5) - time_lagged_value(smt_only(C.shrout*C.cfacshr), months=65)) / time_lagged_value(smt_only(C.shrout*C.cfacshr), months=65))',
    'AnalystRevision': "smt_only(smt_only(IU.meanest.where(fpi='1')) / smt_only(IU.meanest.where(fpi='1'))[t-1])",
    'ChNAnalyst': 'IU.numest / IU.numest[t-1] - 1',
    'FEPS': 'feps_signal(IU.meanest)',
    'FirmAge': 'firm_age(C.prc)',
    'FirmAgeMom': 'smt_only(firm_age_momentum(C.ret, C.prc))',
    'REV6': 'sum_scaled_revisions(IU.meanest, IA.price, months=6)',
    'RD': 'A.xrd / C.mve_permco',
    'RDAbility': 'rd_ability_signal(AA.xrd, AA.sale)',
    'realestate': 'industry_adjusted_mean(smt_only(real_estate_ratio + 0.0*A.at), C.sicCRSP, smt_only(A.at), min_industry_obs=5)',
    'roaq': 'smt_only(Q.ibq / Q.atq[t-3])',
    'RoE': 'A.ni / A.ceq',
    'ShareRepurchase': 'positive_indicator(A.prstkc)',
    'ShareVol': 'share_volume_signal(smt_only(C.vol), smt_only(C.shrout))',
    'SP': 'A.sale / C.mve_permco',
    'Tax': 'piecewise_tax_ratio(A.txfo, A.txfed, A.txt, A.txdi, A.ib)',
    'tang': 'manufacturing_only((A.che + 0.715*A.rect + 0.547*A.invt + 0.535*A.ppegt) / A.at, sic=sic_pit)',
    'TotalAccruals': 'total_accruals_signal(A.ivao, A.ivst, A.dltt, A.dlc, A.pstk, A.sstk, A.prstkc, A.dv, A.act, A.che, A.lct, A.at, A.lt, A.ni, A.oancf, A.ivncf, A.fincf)',
    'XFIN': '(A.sstk - A.dv - A.prstkc + A.dltis - A.dltr + fillna(A.dlcch, value=0)) / A.at',
    'ConsRecomm': 'binary_recommendation_level(IR.ireccd, low_threshold=1.5, high_threshold=3.0)',
    'DownRecomm': "recommendation_change_indicator(IR.ireccd, direction='down', lag_months=1)",
    'UpRecomm': "recommendation_change_indicator(IR.ireccd, direction='up', lag_months=1)",
    'AOP': 'analyst_optimism_ratio(A.ceq, A.ibcom, A.sale, IU.meanest, C.prc)',
    'AccrualsBM': 'accruals_bm_signal(smt_only(log(A.ceq / C.mve_permco)), smt_only((delta(A.act, n=12) - delta(A.che, n=12) - (delta(A.lct, n=12) - delta(A.dlc, n=12) - delta(A.txp, n=12))) / avg_at), A.ceq)',
    'AbnormalAccruals': 'abnormal_accruals_signal(AA.oancf, AA.fopt, AA.act, AA.che, AA.lct, AA.dlc, AA.ib, AA.sale, AA.ppegt, AA.ni, AA.at, AA.sic, C.exchcd)',
    'AnalystValue': 'analyst_value_signal(A.ceq, A.ibcom, A.sale, IU.meanest, C.prc, C.shrout, A.dvc, A.at)',
    'PredictedFE': 'predicted_forecast_error(A.sale, A.ceq, IU.meanest, horizon_months=12)',
    'ChForecastAccrual': 'chforecast_accrual_signal(IU.meanest, A.act, A.che, A.lct, A.dlc, A.txp, A.at)',
    'ChangeInRecommendation': 'change_in_recommendation_signal(IR.ireccd)',
    'Beta': "monthly_rolling_beta(x_dataset='market_month', x_column='ewretd', window=60, min_obs=20, y_excess=True, x_excess=True)",
    'BetaLiquidityPS': "monthly_rolling_multibeta(regressors=['liquidity_month:ps_innov_pit', 'factors_month:mktrf', 'factors_month:hml', 'factors_month:smb'], keep=0, window=60, min_obs=36)",
    'ResidualMomentum': 'residual_momentum(reg_window=36, mom_window=11)',
    'PriceDelayRsq': "price_delay(stat='rsq')",
    'PriceDelaySlope': "price_delay(stat='slope')",
    'PriceDelayTstat': "price_delay(stat='tstat')",
    'RealizedVol': "daily_monthly_stat(stat='std', min_obs=15)",
    'High52': 'high52_signal()',
    'Illiquidity': "((daily_monthly_stat(stat='mean', derive='amihud', min_obs=1) + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-1] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-2] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-3] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-4] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-5] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-6] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-7] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-8] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-9] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-10] + daily_monthly_stat(stat='mean', derive='amihud', min_obs=1)[t-11])) / 12",
    'IndMom': 'smt_only(industry_weighted_momentum(m_ret_smt0, smt_only(C.mve_c), C.sicCRSP))',
    'IndRetBig': 'industry_big_return(C.ret, C.mve_c, industry48(C.sicCRSP))',
    'IntanBM': 'intangible_residual(log(A.ceq / C.mve_permco), C.ret)',
    'IntanCFP': 'intangible_residual((A.ib + A.dp) / C.mve_permco, C.ret)',
    'IntanEP': 'intangible_residual(A.ni / C.mve_permco, C.ret)',
    'IntanSP': 'intangible_residual(A.sale / C.mve_permco, C.ret)',
    'IntMom': 'smt_only(compound_return(m_ret_smt0, lags=[7, 8, 9, 10, 11, 12]))',
    'MaxRet': "daily_monthly_stat(stat='max', min_obs=1)",
    'IdioVol3F': "ff3_idio_stat(stat='std')",
    'ReturnSkew3F': "ff3_idio_stat(stat='skew')",
    'IdioVolAHT': 'rolling_market_rmse(window=252, min_obs=100)',
    'Coskewness': "coskew_signal(variant='monthly')",
    'CoskewACX': "coskew_signal(variant='daily')",
    'BetaFP': 'betafp_signal()',
    'BetaTailRisk': 'betatailrisk_signal()',
    'TrendFactor': 'trendfactor_signal()',
    'AnnouncementReturn': 'announcement_return_signal()',
    'MeanRankRevGrowth': 'weighted_lagged_rank_growth(A.revt)',
    'MS': 'ms_signal(A.at, A.ceq, A.ni, A.oancf, A.fopt, A.wcapch, A.ib, A.dp, A.xrd, A.capx, A.xad, A.revt, C.mve_permco, C.sicCRSP, Q.niq, Q.atq, Q.saleq, Q.oancfy, Q.capxy, Q.xrdq, Q.fqtr)',
    'MomRev': 'momentum_reversal_signal(C.ret)',
    'MomVol': 'momentum_volume_signal(C.ret, C.vol)',
    'NumEarnIncrease': 'earnings_increase_streak(Q.ibq)',
    'ReturnSkew': "daily_monthly_stat(stat='skew', min_obs=15, min_obs_mode='rows')",
    'EarningsConsistency': 'earnings_consistency(A.epspx)',
    'EarningsForecastDisparity': 'earnings_forecast_disparity_signal(IU.meanest, IX.fy0a)',
    'EarningsSurprise': 'smt_only(seasonal_surprise_zscore(smt_only(Q.epspxq)))',
    'EarnSupBig': 'smt_only(industry_big_mean(seasonal_surprise_zscore(smt_only(Q.epspxq), min_sd=1e-08), smt_only(C.mve_c), industry48(smt_only(C.sicCRSP))))',
    'EarningsStreak': 'earnings_streak_signal(IA.actual, IA.meanest, IA.price)',
    'EquityDuration': 'equity_duration_signal(AA.ceq, AA.ib, AA.sale, AA.prcc_f, AA.csho)',
    'Herf': 'rolling_industry_herfindahl(A.sale, C.sicCRSP, C.shrcd, window_months=36, min_obs=12, min_year=1951)',
    'HerfAsset': 'rolling_industry_herfindahl(A.at, C.sicCRSP, C.shrcd, window_months=36, min_obs=12, require_compustat_row=True)',
    'HerfBE': 'rolling_industry_herfindahl(book_equity, C.sicCRSP, C.shrcd, window_months=36, min_obs=12, require_compustat_row=True)',
    'InvestPPEInv': '(delta(A.ppegt, n=12) + delta(A.invt, n=12)) / zero_to_null(A.at[t-12])',
    'ExclExp': 'excluded_expenses_signal(IX.int0a, Q.epspiq)',
    'DivInit': 'span_only(dividend_initiation_flag(D.divamt, D.distcd, lookback_months=12))',
    'DivOmit': 'span_only(dividend_omission_flag(D.divamt, D.distcd, lookback_months=12))',
    'DivSeason': 'seasonal_dividend_indicator(D.divamt, D.distcd, lag_months=12)',
    'DivYieldST': 'smt_only(divyieldst_signal(D.divamt, D.distcd, C.prc))',
    'DolVol': 'log((C.vol*abs(C.prc))[t-2])',
    'RDcap': 'size_filtered(year_filtered((compustat_span_fill(A.xrd, value=0.0) + 0.8*compustat_span_fill(A.xrd, value=0.0)[t-12] + 0.6*compustat_span_fill(A.xrd, value=0.0)[t-24] + 0.4*compustat_span_fill(A.xrd, value=0.0)[t-36] + 0.2*compustat_span_fill(A.xrd, value=0.0)[t-48]) / A.at, min_year=1980), compustat_rows_only(smt_only(C.mve_c)), min_tercile=None, max_tercile=1, drop_missing_size=True)',
    'PS': 'piotroski_score(A.fopt, A.oancf, A.ib, A.at, A.dltt, A.act, A.lct, A.txt, A.xint, A.sale, A.ceq, C.mve_permco, C.shrout)',
    'RevenueSurprise': 'seasonal_surprise_zscore(smt_gvkey_only(Q.revtq / Q.cshprq), min_sd=1e-08)',
    'SurpriseRD': 'surprise_rd_indicator(A.xrd, A.revt, A.at)',
    'fgr5yrLag': 'fgr5yr_lag_signal(IU.meanest)',
    'sfe': 'sfe_signal(IU.medest, IU.numest, C.prc)',
    'VolMkt': 'rolling_mean(abs(C.prc)*C.vol, window_months=12, min_obs=10) / (C.shrout*abs(C.prc))',
    'VolumeTrend': 'trim_global(crsp_only(rolling_trend_slope_scaled(C.vol, window_months=60, min_obs=30)), lower_q=0.01, upper_q=0.99)',
    'VolSD': 'crsp_only(rolling_std(C.vol, window_months=36, min_obs=24))',
    'std_turn': 'crsp_only(size_filtered(rolling_std(C.vol / C.shrout, window_months=36, min_obs=24), C.shrout*abs(C.prc), min_tercile=None, max_quintile=3))',
    'VarCF': 'span_only(rolling_std(smt_only((A.ib + A.dp) / C.mve_permco), window_months=60, min_obs=24)**2)',
    'ExchSwitch': 'smt_only(exchange_switch_indicator(smt_only(C.exchcd), lookback_months=12))',
    'zerotrade1M': 'zerotrade_signal(window=1, deflator=480000.0)',
    'zerotrade6M': 'zerotrade_signal(window=6, deflator=11000.0)',
    'zerotrade12M': 'zerotrade_signal(window=12, deflator=11000.0)',
}
# fmt: on


@cache
def shared() -> dict[str, Expr]:
    found: dict[str, Expr] = {}
    for name, formula in SHARED.items():
        found[name] = parse(formula, found, DATASETS)
    return found


def factor(name: str) -> Expr:
    return parse(FORMULAS[name], shared(), DATASETS)


def catalogue() -> dict[str, Expr]:
    return {name: factor(name) for name in FORMULAS}
