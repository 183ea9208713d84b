"""Execution and risk arithmetic as column functions; exact amounts are decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import once, repeated

MONEY = "decimal(38,10)"


def capped_fill(wanted: Column, price: Column, volume: Column, share: float, lot: float = 1) -> Column:
    """min(wanted, whole lots within the share of the quoted volume); nothing without volume."""
    lots = F.floor(volume * share / (price * lot)) * lot
    return F.when(volume.isNull() | (volume <= 0) | (price <= 0), 0.0).otherwise(F.least(wanted, lots.cast("double")))


def impact(notional: Column, traded: Column, sigma: Column, y: float = 1.0) -> Column:
    """Square-root cost as a share; null without traded volume."""
    return y * sigma * F.sqrt(notional / F.when(traded > 0, traded))


def impact_status(notional: Column, traded: Column) -> Column:
    part = notional / F.when(traded > 0, traded)
    return F.when(part.isNull(), "unassessable").when(part > 0.05, "blocked").when(part > 0.01, "warn").otherwise("ok")


def funding(quantity: Column, mark: Column, rate: Column) -> Column:
    return -quantity * mark * rate


def accrual(balance: Column, rate: Column, days: Column, basis: int) -> Column:
    """Simple interest to the day count, exact to ten places."""
    return F.round(balance.cast("decimal(18,4)") * rate.cast("decimal(9,6)") * days.cast("decimal(5,0)") / basis, 10).cast("decimal(28,10)")



def financing(cash: Column, short_value: Column, credit: Column, debit: Column, collateral: Column, days: Column, basis: Column) -> dict[str, Column]:
    """The bases of a book's cash and the signed payment, exact to six places each. Positive cash up to the value of
    shorts is segregated and earns collateral, the rest earns credit, negative cash pays debit; simple interest by days
    over basis. status is halted, and the payment null, where an amount, a rate, the days or the basis is missing: no
    rate is carried forward and none is taken for zero."""
    held, owed = F.greatest(cash, F.lit(0)), F.greatest(-cash, F.lit(0))
    segregated = F.least(held, F.greatest(short_value, F.lit(0)))
    known = F.lit(True)
    for x in (cash, short_value, credit, debit, collateral, days, basis):
        known = known & x.isNotNull()

    def interest(amount: Column, rate: Column) -> Column:
        exact = amount.cast("decimal(18,2)") * rate.cast("decimal(9,6)") * days.cast("decimal(5,0)")
        return F.round(F.try_divide(exact, basis.cast("decimal(5,0)")), 6).cast("decimal(28,6)")

    free = held - segregated
    payment = interest(free, credit) + interest(segregated, collateral) - interest(owed, debit)
    return {"segregated": segregated, "free": free, "owed": owed, "payment": F.when(known, payment), "status": F.when(known, "accrued").otherwise("halted")}


def locate(wanted: Column, available: Column) -> Column:
    """Shares granted: never more than wanted or available, none if availability is not known."""
    return F.least(wanted, F.greatest(F.coalesce(available, F.lit(0.0)), F.lit(0.0)))


def recall(outstanding: Column, recalled: Column) -> Column:
    """Shares to cover."""
    return F.greatest(F.lit(0.0), F.least(recalled, outstanding))


def borrow_fee(shares: Column, price: Column, rate: Column, days: Column) -> Column:
    """Simple, actual days over 365."""
    return shares * price * rate * days / 365


def variation_margin(contracts: Column, multiplier: float, before: Column, now: Column) -> Column:
    """What a change of the settlement price pays; contracts are negative for a short position."""
    return contracts * multiplier * (now - before)


def limits(checks: list[tuple[str, Column, float]], reduces: Column | None = None) -> tuple[Column, Column]:
    """status and reasons for metrics with upper limits: unassessable if a metric is missing, else blocked if one is
    over its limit; the reasons name them. Where reduces is true the order only lowers risk: it is reduce_only whatever
    the metrics are, and the reasons stay."""
    missing = F.array_compact(F.array(*(F.when(m.isNull(), F.lit(f"{n} missing")) for n, m, _ in checks)))
    over = F.array_compact(F.array(*(F.when(m > limit, F.lit(f"{n} over limit")) for n, m, limit in checks)))
    status = F.when(F.size(missing) > 0, "unassessable").when(F.size(over) > 0, "blocked").otherwise("ok")
    if reduces is not None:
        status = F.when(reduces & (status != "ok"), "reduce_only").otherwise(status)
    return status, F.array_join(F.concat(missing, over), ",")


def stressed_days(days: Column, haircut: Column) -> Column:
    return days / (1 - F.when(haircut < 1, haircut))


def roll(now: Column, first_notice: Column, last_trade: Column, window: int) -> Column:
    """roll within window days before the earlier deadline, expired after it, else hold; fails closed without one."""
    left = F.date_diff(F.least(first_notice, last_trade), now)
    known = first_notice.isNotNull() & last_trade.isNotNull() & now.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), "blocked").when(left < 0, "expired").when(left <= window, "roll").otherwise("hold")


def package_units(legs: DataFrame, package: str, size: str, ratio: str, wanted: str, kind: str, debit: str | None = None, most: float = 0.0) -> DataFrame:
    """package and filled: whole units that every leg's size allows, up to wanted; all or none for kind FOK. With debit,
    what one unit of a leg's ratio costs (negative: brings in), nothing is filled where a unit's net debit is not known
    or over most."""
    units = F.min(F.floor(F.col(size) / F.col(ratio)))
    net = F.when(F.bool_and(F.col(debit).isNotNull()), F.sum(F.col(ratio) * F.col(debit))) if debit else F.lit(most)
    out = legs.groupBy(package).agg(units.alias("_u"), F.max(wanted).alias("_w"), F.max(kind).alias("_k"), net.alias("_d"))
    fill = F.when(F.col("_d") <= most, F.least("_u", "_w")).otherwise(0)
    return out.select(package, F.when((F.col("_k") == "FOK") & (fill < F.col("_w")), 0).otherwise(fill).cast("long").alias("filled"))


def worst_scenario(cells: DataFrame, account: str, scenario: str, pnl: str, n_scenarios: int) -> DataFrame:
    """account, margin and complete: the largest loss over scenarios of the netted result; null unless all are there."""
    netted = cells.groupBy(account, scenario).agg(F.sum(pnl).alias("_p"))
    out = netted.groupBy(account).agg(F.count("*").alias("_n"), F.min("_p").alias("_worst"))
    complete = F.col("_n") == n_scenarios
    return out.select(account, F.when(complete, F.greatest(F.lit(0.0), -F.col("_worst"))).alias("margin"), complete.alias("complete"))


def fee(notional: Column, rate: Column, minimum: Column, cap: Column) -> Column:
    """Rounded to cents first, then raised to the minimum, then lowered to the cap; exact decimals throughout."""
    raw = F.round(notional.cast("decimal(18,2)") * rate.cast("decimal(9,6)"), 2).cast("decimal(18,2)")
    return F.least(F.greatest(raw, minimum.cast("decimal(18,2)")), cap.cast("decimal(18,2)"))


def replay(holdings: DataFrame, actions: DataFrame, key: str, at: str) -> DataFrame:
    """holdings (key, at, shares, price) with adjusted shares and price: all splits (ratio) of the key after at, in any
    order, and cash: dividends (per share as of then) times the shares held before that day's actions. Late actions (announced after they take
    effect) fail and are named in status, as are ratios of 0 or less."""
    a = actions.select(F.col(key).alias("_key"), F.col("effective").alias("_e"), "ratio", "dividend", (F.col("announced") > F.col("effective")).alias("late"))
    own = Window.partitionBy(*holdings.columns)
    line = own.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)  # what took effect on earlier days
    joined = once(holdings).join(a, (F.col(key) == F.col("_key")) & (F.col("_e") > F.col(at)), "left").withColumn("_day", F.dense_rank().over(own.orderBy("_e")))
    factor = F.coalesce(F.col("ratio"), F.lit(1.0))
    before = F.coalesce(F.product(factor).over(line), F.lit(1.0))
    paid = joined.withColumn("_cash", F.coalesce(F.col("dividend"), F.lit(0.0)) * F.col("shares") * before)
    out = paid.groupBy(*holdings.columns, "_times").agg(
        F.product(factor).alias("_f"), F.sum("_cash").alias("cash"), F.bool_or(F.coalesce("late", F.lit(False))).alias("_late"), F.bool_or(factor <= 0).alias("_bad")
    )
    return repeated(out).select(
        *holdings.columns, (F.col("shares") * F.col("_f")).alias("adjusted_shares"), F.try_divide("price", "_f").alias("adjusted_price"), "cash",
        F.when(F.col("_bad"), "invalid_ratio").when(F.col("_late"), "late_action").otherwise("ok").alias("status"),
    )


def chain_checks(chain: DataFrame, series: list[str], quoted: str | None = None, at: str | None = None, oldest: int = 60, currency: str | None = None) -> DataFrame:
    """chain (strike, bid, ask of calls) with crossed, monotone and convex: asks not below bids, mid prices that do not
    rise with the strike, and slopes between strikes, evenly spaced or not, that do not fall. With quoted and at also
    stale: not quoted within so many seconds before the time at, or after it; with currency also one_currency: the whole
    series has one, none missing."""
    line = Window.partitionBy(*series).orderBy("strike")
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = chain.withColumn("_m", mid)
    before = (F.col("_m") - F.lag("_m").over(line)) / (F.col("strike") - F.lag("strike").over(line))
    after = (F.lead("_m").over(line) - F.col("_m")) / (F.lead("strike").over(line) - F.col("strike"))
    checked = rows.withColumns({
        "crossed": F.coalesce(F.col("bid") > F.col("ask"), F.lit(True)),
        "monotone": F.coalesce(before <= 0, F.lit(True)),
        "convex": F.coalesce(after >= before - 1e-12, F.lit(True)),
    })
    if quoted and at:
        age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(quoted).cast("timestamp"))
        checked = checked.withColumn("stale", ~F.coalesce(age.between(0, oldest * 1_000_000), F.lit(False)))
    if currency:
        whole = Window.partitionBy(*series)
        same = (F.min(currency).over(whole) == F.max(currency).over(whole)) & (F.count(currency).over(whole) == F.count("*").over(whole))
        checked = checked.withColumn("one_currency", F.coalesce(same, F.lit(False)))
    return checked.drop("_m")


def deliverable(right: Column, position: Column, strike: Column, spot: Column, multiplier: int = 100) -> tuple[Column, Column]:
    """shares and cash that an option position delivers at expiry: a long call or short put takes shares."""
    in_money = F.when(right == "C", spot > strike).otherwise(spot < strike)
    sign = F.when(right == "C", 1).otherwise(-1)
    shares = F.when(in_money, sign * position * multiplier).otherwise(0)
    return shares, F.when(in_money, -sign * position * multiplier * strike).otherwise(0.0)
