"""Money over time, returns and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import running


def future_value(present: Column, rate: Column, periods: Column) -> Column:
    return present * F.pow(1 + rate, periods)


def present_value(future: Column, rate: Column, periods: Column) -> Column:
    return future / F.pow(1 + rate, periods)


def payment(principal: Column, rate: Column, periods: Column) -> Column:
    """Of an annuity, at the end of each period; without interest, equal shares."""
    return F.when(rate == 0, principal / periods).otherwise(principal * rate / (1 - F.pow(1 + rate, -periods)))


def sharpe(returns: str, risk_free: float = 0.0) -> Column:
    return F.try_divide(F.avg(returns) - risk_free, F.stddev_samp(returns))


def value_at_risk(df: DataFrame, returns: str, level: float = 0.95) -> DataFrame:
    """(value_at_risk): the loss not exceeded with the given share, by the exact quantile."""
    return running.quantile_row(df, [returns], [1 - level]).select((-F.col(returns)[0]).alias("value_at_risk"))


def net_present_value(flow: str, period: str, rate: float) -> Column:
    """Of rows that each hold a flow and its period, as an aggregate."""
    return F.sum(F.col(flow) / F.pow(F.lit(1 + rate), F.col(period)))


def growth_rate(first: Column, last: Column, periods: Column) -> Column:
    """The compound rate that leads from first to last."""
    return F.when((first > 0) & (last > 0) & (periods > 0), F.pow(last / first, 1 / periods) - 1)


def sortino(returns: str, target: float = 0.0) -> Column:
    below = F.least(F.col(returns) - target, F.lit(0.0))
    return F.try_divide(F.avg(returns) - target, F.sqrt(F.avg(below * below)))


def black_scholes_call(spot: Column, strike: Column, rate: Column, volatility: Column, years: Column) -> Column:
    from gridloom.functions.statistics import normal_cdf

    spread = volatility * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + volatility * volatility / 2) * years) / spread
    return spot * normal_cdf(d1) - strike * F.exp(-rate * years) * normal_cdf(d1 - spread)


def _d(spot: Column, strike: Column, rate: Column, volatility: Column, years: Column) -> tuple[Column, Column]:
    spread = volatility * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + volatility * volatility / 2) * years) / spread
    return d1, d1 - spread


def black_scholes_put(spot: Column, strike: Column, rate: Column, volatility: Column, years: Column) -> Column:
    from gridloom.functions.statistics import normal_cdf

    d1, d2 = _d(spot, strike, rate, volatility, years)
    return strike * F.exp(-rate * years) * normal_cdf(-d2) - spot * normal_cdf(-d1)


def greeks(spot: Column, strike: Column, rate: Column, volatility: Column, years: Column) -> dict[str, Column]:
    """delta, gamma, vega, theta and rho of a call."""
    from gridloom.functions.distributions import normal_density
    from gridloom.functions.statistics import normal_cdf

    d1, d2 = _d(spot, strike, rate, volatility, years)
    later, root = strike * F.exp(-rate * years), F.sqrt(years)
    return {
        "delta": normal_cdf(d1),
        "gamma": normal_density(d1) / (spot * volatility * root),
        "vega": spot * normal_density(d1) * root,
        "theta": -spot * normal_density(d1) * volatility / (2 * root) - rate * later * normal_cdf(d2),
        "rho": later * years * normal_cdf(d2),
    }


def annuity_present(payment_: Column, rate: Column, periods: Column) -> Column:
    return F.when(rate == 0, payment_ * periods).otherwise(payment_ * (1 - F.pow(1 + rate, -periods)) / rate)


def annuity_future(payment_: Column, rate: Column, periods: Column) -> Column:
    return F.when(rate == 0, payment_ * periods).otherwise(payment_ * (F.pow(1 + rate, periods) - 1) / rate)


def bond_price(face: Column, coupon: Column, rate: Column, periods: Column) -> Column:
    """Of a coupon rate paid each period and the face at the end."""
    return annuity_present(face * coupon, rate, periods) + face / F.pow(1 + rate, periods)


def duration(flow: str, period: str, rate: float) -> Column:
    """Macaulay's: the mean period, weighted by the flows' present values, as an aggregate."""
    now = F.col(flow) / F.pow(F.lit(1 + rate), F.col(period))
    return F.try_divide(F.sum(now * F.col(period)), F.sum(now))


def internal_rate(df, keys: list[str], flow: str, period: str, low: float = -0.9, high: float = 10.0, steps: int = 60):
    """(keys, rate): where each key's net present value is 0, by halving; null if its sign is the same at both ends.

    Flows of a period are summed first, so a key holds one number a period.
    """
    sums = df.groupBy(*keys, period).agg(F.sum(flow).cast("double").alias("f")).groupBy(*keys).agg(F.collect_list(F.struct(F.col(period).cast("double").alias("t"), "f")).alias("__s"))
    value = lambda r: F.aggregate("__s", F.lit(0.0), lambda acc, s: acc + s["f"] / F.pow(1 + r, s["t"]))
    begun = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"))

    def halved(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        same = F.signum(value(middle)) == F.signum(value(F.lit(float(low))))
        return F.struct(F.when(same, middle).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(middle).alias("b"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begun, halved)
    found = sums.withColumn("__e", ends)
    crossed = F.signum(value(F.lit(float(low)))) != F.signum(value(F.lit(float(high))))
    return found.select(*keys, F.when(crossed, (F.col("__e.a") + F.col("__e.b")) / 2).alias("rate"))


def shortfall(df, returns: str, level: float = 0.95):
    """(shortfall): the mean loss of the returns at or below the value at risk."""
    edge = running.quantile_row(df, [returns], [1 - level]).select(F.col(returns)[0].alias("__q"))
    return df.join(F.broadcast(edge)).where(F.col(returns) <= F.col("__q")).agg((-F.avg(returns)).alias("shortfall"))


def normal_value_at_risk(returns: str, z: float = 1.6448536269514722) -> Column:
    """By the mean and the population deviation."""
    return -(F.avg(returns) - z * F.stddev_pop(returns))


def beta(returns: str, market: str) -> Column:
    return F.try_divide(F.covar_pop(returns, market), F.var_pop(market))


def straight_line(cost: Column, salvage: Column, life: Column) -> Column:
    return F.try_divide(cost - salvage, life)


def declining_balance(cost: Column, factor: Column, life: Column, year: Column) -> Column:
    """The depreciation of one year, from 1."""
    rate = factor / life
    return cost * rate * F.pow(1 - rate, year - 1)


def compound(principal: Column, rate: Column, times: Column, years: Column) -> Column:
    return principal * F.pow(1 + rate / times, times * years)


def effective_rate(rate: Column, times: Column) -> Column:
    return F.pow(1 + rate / times, times) - 1
